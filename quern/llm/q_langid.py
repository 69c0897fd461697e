"""op4: the language of every whole text, by profiles of the documents that aren't held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import langid
from quern.llm.common import documents, fold
from pyspark.sql import functions as F


def op4_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 4) == 2
    profiles = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).drop("text")


QUERIES = {"op4_rank_order_language": op4_rank_order_language}

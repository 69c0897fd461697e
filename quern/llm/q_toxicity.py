"""op8: the toxicity of every whole text, by a model of the labels that aren't held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import toxicity
from quern.llm.common import documents, fold


def op8_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op8_boosted_toxicity": op8_boosted_toxicity}

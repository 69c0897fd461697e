"""op10: near-duplicate groups of all documents at a similarity of 85 percent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import minhash
from quern.llm.common import documents


def op10_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(documents(spark, sf_dir), percent=85)


QUERIES = {"op10_hamming_join": op10_hamming_join}

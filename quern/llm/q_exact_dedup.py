"""op2: which document of each group of equal texts stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup
from quern.llm.common import documents


def op2_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark(documents(spark, sf_dir).select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""

QUERIES = {"op2_trie_dedup": op2_trie_dedup}
ORACLE = {"op2_trie_dedup": SQL}

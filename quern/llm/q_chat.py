"""op1: the maximal conversations, rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat
from quern.llm.common import documents


def op1_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The SQL has no n_snapshots.
    return chat.render(documents(spark, sf_dir, "conversations")).drop("n_snapshots").withColumn("chat_sha256", F.sha2(F.col("chat").cast("binary"), 256))


SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line FROM conversations),
p AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS turns,
         string_agg(md5(role || chr(0) || text), ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
k AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_copies, any_value(turns) AS n_turns FROM p WHERE place = turns
  AND prefix NOT IN (SELECT prefix FROM p WHERE place < turns) GROUP BY prefix),
c AS (SELECT conv_id, string_agg(line, '' ORDER BY turn, role, text) AS chat FROM r GROUP BY conv_id)
SELECT k.conv_id, k.n_turns, k.n_copies, c.chat, sha256(c.chat) AS chat_sha256 FROM k JOIN c ON k.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {"op1_snapshot_collapse": op1_snapshot_collapse}
ORACLE = {"op1_snapshot_collapse": SQL}

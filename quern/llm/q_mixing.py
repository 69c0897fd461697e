"""op9: how many words of each document a mix of all sources takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing
from quern.llm.common import documents


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT >> 2 AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS seen
  FROM r WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (
  SELECT *, (SELECT seen FROM l WHERE seen <= ratio ORDER BY ratio, source ASC NULLS LAST LIMIT 1) AS level FROM l),
g AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM t),
h AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 2 END AS whole FROM g),
k AS (SELECT *, CASE WHEN whole < 2 THEN target - whole * source_size ELSE 0 END AS rest FROM h),
c AS (
  SELECT d.doc_id, d.size, d.place, d.source, k.source_size, k.target, k.whole, k.rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, place) AS here
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source),
b AS (SELECT *, min(CASE WHEN upto >= rest THEN place END) OVER (PARTITION BY source) AS edge FROM c)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND (place < edge OR place = edge AND 2 * (rest - (upto - here)) > here) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""

QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLE = {"op9_mix_sources": SQL}

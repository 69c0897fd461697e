"""op7: which records of a damaged replica of all pages differ, and where they lie.

The second replica is the first with damage to about one record of thirty, as the md5 of the page's id says: another last byte, another
last digit of the version, lost, with a record more under the same id, or longer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import warc
from quern.llm.common import documents

#: First two digits of the md5 that mean damage.
CHANGED, LOST, GAINED, LONGER = ("00", "01", "02", "03", "04"), "05", "06", "07"


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages")
    record = warc.record(F.col("page_id"), F.col("url"), F.col("html"))
    code = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")).alias("code")
    whole = pages.select(F.col("page_id").alias("key"), "url", record.alias("bytes"), code)
    tail = F.concat(F.expr("substring(bytes, 1, length(bytes) - 1)"), F.lit("?").cast("binary"))
    head = F.concat(F.lit("WARC/1.1").cast("binary"), F.expr("substring(bytes, 9)"))
    start = F.substring("code", 1, 2)
    bytes_of = (
        F.when(start.isin(*CHANGED), F.array(F.when(F.substring("code", 3, 1) < "8", tail).otherwise(head)))
        .when(start == LOST, F.array().cast("array<binary>"))
        .when(start == GAINED, F.array("bytes", warc.record(F.col("key"), F.col("url"), F.lit("gained"))))
        .when(start == LONGER, F.array(F.concat("bytes", F.lit("\r\n").cast("binary"))))
        .otherwise(F.array("bytes"))
    )
    hurt = whole.select("key", F.explode(bytes_of).alias("bytes"))
    return warc.audit(warc.leaves(whole), warc.leaves(hurt)).withColumnRenamed("key", "page_id")


SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(page_id::VARCHAR, '')) AS code,
         chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) ||
         'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
         strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) AS rest
  FROM pages),
a AS (SELECT page_id, 'WARC/1.0' || head || rest || chr(10) AS body FROM p),
b AS (
  SELECT page_id, CASE WHEN substr(code, 1, 2) <= '04' AND substr(code, 3, 1) < '8' THEN 'WARC/1.0' || head || rest || '?'
                       WHEN substr(code, 1, 2) <= '04' THEN 'WARC/1.1' || head || rest || chr(10)
                       WHEN substr(code, 1, 2) = '07' THEN 'WARC/1.0' || head || rest || chr(10) || chr(13) || chr(10)
                       ELSE 'WARC/1.0' || head || rest || chr(10) END AS body
  FROM p WHERE substr(code, 1, 2) <> '05'
  UNION ALL
  SELECT page_id, 'WARC/1.0' || head || 6 || chr(13) || chr(10) || chr(13) || chr(10) || 'gained' || chr(13) || chr(10) || chr(13) || chr(10) FROM p WHERE substr(code, 1, 2) = '06'),
oa AS (
  SELECT page_id, sha256(body) AS sha, row_number() OVER w - 1 AS no, sum(strlen(body)) OVER w AS stop, strlen(body) AS size
  FROM a WINDOW w AS (ORDER BY page_id NULLS FIRST, sha256(body) ROWS UNBOUNDED PRECEDING)),
ob AS (
  SELECT page_id, sha256(body) AS sha, row_number() OVER w - 1 AS no, sum(strlen(body)) OVER w AS stop, strlen(body) AS size
  FROM b WINDOW w AS (ORDER BY page_id NULLS FIRST, sha256(body) ROWS UNBOUNDED PRECEDING)),
la AS (SELECT * FROM oa WHERE NOT EXISTS (FROM ob WHERE ob.page_id IS NOT DISTINCT FROM oa.page_id AND ob.sha = oa.sha)),
lb AS (SELECT * FROM ob WHERE NOT EXISTS (FROM oa WHERE ob.page_id IS NOT DISTINCT FROM oa.page_id AND ob.sha = oa.sha))
SELECT coalesce(la.page_id, lb.page_id) AS page_id, la.no AS record_no_a, (la.stop - la.size)::BIGINT AS range_start_a, la.stop::BIGINT AS range_stop_a, la.sha AS sha256_a,
       lb.no AS record_no_b, (lb.stop - lb.size)::BIGINT AS range_start_b, lb.stop::BIGINT AS range_stop_b, lb.sha AS sha256_b
FROM la FULL JOIN lb ON la.page_id IS NOT DISTINCT FROM lb.page_id
"""

QUERIES = {"op7_merkle_fixity": op7_merkle_fixity}
ORACLE = {"op7_merkle_fixity": SQL}

"""op3: every whole text as the payload of an ISO media container, read back and probed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import media
from quern.llm.common import documents


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    stored = media.pack(docs, "text", drop=True)
    read = media.unpack(media.probe(stored))
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"], k["length"])), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "codec", "handler", "timescale", "duration", "n_samples", ranges).alias("feature"),
    )


QUERIES = {"op3_media_columns": op3_media_columns}

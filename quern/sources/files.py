"""JSON and text files as rows of values, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import variants as V
from quern.functions.text import trim


def _numbered(df: DataFrame) -> DataFrame:
    """`row_idx` from 0 in file and line order, without bringing rows together: rows of a partition follow the counts of those
    before it."""
    dealt = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").count()  # a row a partition, as is what is broadcast
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(starts), "_part").withColumn("row_idx", (F.col("_start") + within).cast("long")).drop("_part", "_at", "_start")


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """row_idx, doc: a row a line that isn't blank. A line that isn't JSON fails the read, or gives NULL unless `strict`."""
    lines = spark.read.text(path).where(trim(F.col("value")) != "")
    return _numbered(lines).select("row_idx", V.from_json(F.col("value"), strict).alias("doc"))


def read_json_rows(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """row_idx, doc: the elements of the array that a file holds; with `single` an object is one row. Anything else is an error.

    A file is one value and is read whole; large inputs belong in lines.
    """
    whole = spark.read.text(path, wholetext=True).select(V.from_json(F.col("value"), True).alias("v"))
    kind = V.kind(F.col("v"))
    wrong = F.raise_error(F.concat(F.lit("expected an array of rows, got "), kind)).cast("array<variant>")
    rows = F.when(kind == "array", V.elements(F.col("v")))
    if single:
        rows = rows.when(kind == "object", F.array("v"))
    return whole.select(F.posexplode(rows.otherwise(wrong)).alias("row_idx", "doc")).select(F.col("row_idx").cast("long"), "doc")


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of texts, for the CSV source hint; no types are guessed."""
    return spark.read.csv(path, header=True, inferSchema=False, **options)


def rows_of(df: DataFrame, order: str | None = None) -> DataFrame:
    """row_idx, doc of any DataFrame: each row as an object. With `order`, a column of the numbers from 0, that is the index."""
    doc = V.from_row(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    if order:
        return df.select(F.col(order).cast("long").alias("row_idx"), doc.alias("doc"))
    return _numbered(df.select(doc.alias("doc"))).select("row_idx", "doc")


def write_json(df: DataFrame, doc: str, path: str, mode: str = "errorifexists") -> None:
    """A JSON text column, or values, as lines."""
    kind = df.schema[doc].dataType.simpleString()
    text = F.col(doc) if kind == "string" else F.to_json(doc)
    df.select(text.alias("value")).write.mode(mode).text(path)

"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Targets: the mix holds `share` times all words; sources share it by weight, none above `most` times its own words, and what a
source can't take is shared again by weight until no target is above. That end state is min(most * size, level * weight)
for one level, which running sums over the sources in order of most * size / weight give at once.

Documents: a source takes each document floor(target / size) times, and the rest of its target once more by a threshold on a 50-bit hash of
the key. A histogram of words by source and the hash's first ten bits gives the bucket in which the running sum
passes the rest; only that bucket's documents are counted again by the next ten bits, and so on five times. The last
bucket is one hash value: it is taken if that brings the source nearer to its target. Documents are then filtered by
comparing hashes; they are never sorted.

Results: size counts runs of anything but the space and the bytes 9 to 13; a null text has 0. A null source is a source, the last.
A null key is hashed as an empty text; rows with equal keys share a hash and are taken or left together. Documents of a
source without words are taken 0 words. Other columns aren't looked at, whatever their names. An empty frame gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import col, materialise

#: Hash bits that a level looks at, and levels.
BITS, LEVELS = 10, 5
#: Weights by place of the source, repeating; share of all words; most times that a document may be taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column) -> Column:
    """The 50-bit hash of a key."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.shiftright(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), 52 - BITS * LEVELS)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> the same with `target`. One row a source: sums over all of them are windows of that small table."""
    n = len(weights)
    everything = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(everything) - 1) % n + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    known = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(every) - (F.sum("cap").over(upto) - F.col("cap"))
    among = F.sum("weight").over(every) - (F.sum("weight").over(upto) - F.col("weight"))
    # The level as seen from each source if all before it are at their caps: the first that stays below its cap sets it.
    seen = known.withColumn("seen", left / among)
    first = F.min(F.when(F.col("seen") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "seen"))).over(every)
    level = first["seen"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return seen.select("source", "source_size", target.alias("target"))


def limits(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST
) -> tuple[DataFrame, DataFrame]:
    """The narrow table key, source, size, place of `df`, and a row a source: of, source_size, target, whole, limit.

    A document comes `whole` times in the mix, and once more if its place is below `limit`.
    """
    slim = df.select(col(key).alias("key"), col(source).alias("source"), words(col(text)).alias("size"), place(col(key)).alias("place"))
    slim = materialise(slim, "mix-sizes")  # texts are read once; what follows works on four narrow columns
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(most))
    rest = F.when(F.col("whole") < most, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)
    zero = F.lit(0).cast("long")
    state = goal.withColumn("whole", whole.cast("long"))
    state = state.select("source", "source_size", "target", "whole", rest.alias("rest"), zero.alias("prefix"), zero.alias("below"))
    for k in range(1, LEVELS + 1):
        state = materialise(_refine(slim, state, BITS * (LEVELS - k)), f"mix-level{k}")
    # prefix is now a whole hash, below the words before it, and bucket the words at it.
    nearer = 2 * (F.col("rest") - F.col("below")) > F.col("bucket")
    limit = F.col("prefix") + F.when((F.col("rest") > 0) & nearer, 1).otherwise(0)
    return slim, state.select(F.col("source").alias("of"), "source_size", "target", "whole", limit.alias("limit"))


def _times() -> Column:
    return F.col("whole") + F.when(F.col("place") < F.col("limit"), 1).otherwise(0)


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """A row for each row of `df`: its key and source with size, source_size, target, times and taken.

    `times` is how often the document comes in the mix, `taken` that many times its words. Options are those of `limits`.
    """
    slim, found = limits(df, key, source, **options)
    out = slim.join(found, F.col("source").eqNullSafe(F.col("of"))).withColumn("times", _times())
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: each row of `df` as often as it is taken."""
    _, found = limits(df, key, source, **options)
    row = df.select(F.struct(*(col(c) for c in df.columns)).alias("row"), col(source).alias("source"), place(col(key)).alias("place"))
    taken = row.join(found, F.col("source").eqNullSafe(F.col("of"))).where(_times() > 0)
    again = taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), _times())).alias("time"))
    return again.select("row.*")


def _refine(slim: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """`state` one level down: in each source's bucket, the sub-bucket where the running sum of words passes the rest."""
    inside = (F.shiftright("place", shift + BITS) == F.col("prefix")) & F.col("source").eqNullSafe(F.col("of"))
    counted = slim.join(state.select(F.col("source").alias("of"), "prefix"), inside)
    bucket = F.shiftright("place", shift).alias("bucket_no")
    counted = counted.groupBy(F.col("source").alias("of"), bucket).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("of").orderBy("bucket_no")
    summed = counted.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = state.join(summed, F.col("source").eqNullSafe(F.col("of")), "left")
    passing = F.col("below") + F.col("upto") >= F.col("rest")
    first = F.min(F.when(passing, F.struct("bucket_no", "upto", "words")))
    kept = ["source", "source_size", "target", "whole", "rest", "prefix", "below"]
    found = joined.groupBy(*kept).agg(first.alias("first"))
    return found.select(
        *kept[:5],
        # A source without documents in the bucket, or whose words end before the rest by rounding, takes the bucket's end.
        F.coalesce(F.col("first.bucket_no"), F.shiftleft("prefix", BITS) + ((1 << BITS) - 1)).alias("prefix"),
        (F.col("below") + F.coalesce(F.col("first.upto") - F.col("first.words"), F.lit(0))).alias("below"),
        F.coalesce(F.col("first.words"), F.lit(0)).alias("bucket"),
    )

"""Merkle fixity audit of WARC replicas.

Records lie one after the other in order of their key. A leaf is a record: its offset range and the sha256 of its bytes. A node above
hashes the ordered ranges (relative to its own start) and digests of its children, up to one root. Replicas are compared by their roots;
where nodes differ only their children are compared, so what is looked at follows the damage and not the archive.

Which leaves are a node's is told by the leaves alone: a hash of key and digest decides whether a leaf opens a node at the first level
(one in FANOUT does), at the second (one in FANOUT squared), and so on, and a node is named by the leaf that opens it. So a record that one
replica lost, gained or has in another length changes the nodes above it and no others, wherever it lies; records behind it have other
offsets, which are reported but not compared.

Equal records are one leaf with a number of copies, so a key or record with a share of all rows is summed up before anything is sorted.
Trees are aggregations of a table a level, each about a FANOUT-th of the one below; a node has FANOUT children on average, k times as
many with a probability of e^-k.

Results: null keys come first, equal keys are ordered by digest; a null url or body counts as empty. A row for each record that differs,
with its number, range and digest in both replicas, nulls where it is in one only. Of a key that is left over more than once on a
side each record is a row of its own, as nothing tells which became which. Equal replicas, and empty ones, give no rows. Bytes of any
length are hashed where they are read and go no further. Other columns aren't looked at.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise

#: Children of a node on average.
FANOUT = 16


def record(key: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC resource record."""
    content = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), content, F.lit("\r\n\r\n").cast("binary"))


def leaves(records: DataFrame) -> DataFrame:
    """key, bytes -> key, digest, n (copies), size, node (the first one's number in the archive), start. Bytes are read once."""
    slim = records.select("key", F.length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("digest"))
    slim = materialise(slim.groupBy("key", "digest", "size").agg(F.count("*").alias("n")), "warc-digests")
    dealt = materialise(slim.repartitionByRange("key", "digest").withColumn("part", F.spark_partition_id()), "warc-order")
    before = Window.partitionBy("part").orderBy("key", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("n_own", F.sum("n").over(before)).withColumn("bytes_own", F.sum(F.col("n") * F.col("size")).over(before))
    # A row for each partition: what lies in the partitions before it.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("n").alias("n_part"), F.sum(F.col("n") * F.col("size")).alias("bytes_part"))
    parts = parts.select("part", F.sum("n_part").over(earlier).alias("n_before"), F.sum("bytes_part").over(earlier).alias("bytes_before"))
    known = lambda *names: sum((F.coalesce(n, F.lit(0).cast("long")) for n in names), F.lit(0).cast("long"))
    both = placed.join(parts, "part")
    return both.select("key", "digest", "n", "size", known("n_before", "n_own").alias("node"), known("bytes_before", "bytes_own").alias("start"), "part")


def rooted(leaf: DataFrame, levels: int) -> DataFrame:
    """Leaves with up0, their own name, and up1 to up`levels`, the names of the nodes above: the last leaf up to here that opens a node there;
    before the first it is null."""
    own = F.xxhash64("key", "digest")
    named = leaf.withColumn("up0", own)
    opens = lambda k: F.pmod(F.xxhash64(F.lit("opens"), "key", "digest"), F.lit(FANOUT**k)) == 0 if k < levels else F.lit(False)
    inside = Window.partitionBy("part").orderBy("key", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ups = range(1, levels + 1)  # the last level is one root, which no leaf opens
    named = named.withColumns({f"in{k}": F.last(F.when(opens(k), F.col("up0")), ignorenulls=True).over(inside) for k in ups})
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = named.groupBy("part").agg(*(F.max_by(f"in{k}", "node").alias(f"end{k}") for k in ups))  # a row for each partition
    ends = ends.select("part", *(F.last(f"end{k}", ignorenulls=True).over(earlier).alias(f"before{k}") for k in ups))
    digest = F.sha2(F.concat_ws(":", "digest", "n").cast("binary"), 256).alias("sum")
    stop = (F.col("start") + F.col("n") * F.col("size")).alias("stop")
    return named.join(ends, "part").select(
        *("key", "digest", "n", "size", "node", "start", "up0"), *(F.coalesce(f"in{k}", f"before{k}").alias(f"up{k}") for k in ups), stop, digest
    )


def level_up(level: DataFrame, k: int, levels: int) -> DataFrame:
    """The nodes of level `k` from those below: node (its first leaf's number), start, stop, sum, and the names up`k` and above."""
    children = F.array_sort(F.collect_list(F.struct("node", "start", "stop", "sum")))
    above = [F.first(f"up{j}").alias(f"up{j}") for j in range(k + 1, levels + 1)]
    grown = level.groupBy(f"up{k}").agg(F.min("node").alias("node"), F.min("start").alias("start"), F.max("stop").alias("stop"), children.alias("children"), *above)
    text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["start"] - F.col("start"), c["stop"] - F.col("start"), c["sum"])), ";")
    return grown.select("node", "start", "stop", F.sha2(text.cast("binary"), 256).alias("sum"), *(f"up{j}" for j in range(k, levels + 1)))


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Leaves and the nodes of each level, the root last."""
    out = [materialise(rooted(leaf, levels), "warc-leaves")]
    for k in range(1, levels + 1):
        out.append(materialise(level_up(out[-1], k, levels), f"warc-level{k}"))
    return out


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves of two replicas -> the records that differ: key and, of each replica, record_no, start, stop and sha256."""
    a, b = materialise(a, "warc-placed"), materialise(b, "warc-placed")
    most = max(x.count() for x in (a, b))
    levels = max(1, ceil(log(max(most, 2), FANOUT)))
    trees, wrong = (tree(a, levels), tree(b, levels)), None

    def suspect(k: int) -> list[DataFrame]:
        """The nodes of level `k` of both replicas below nodes that differ."""
        if wrong is None:
            return [t[k] for t in trees]
        return [t[k].join(wrong, F.col(f"up{k + 1}").eqNullSafe(F.col("name")), "left_semi") for t in trees]

    for k in range(levels, 0, -1):
        sides = [x.select(F.col(f"up{k}").alias(f"name_{s}"), F.col("sum").alias(f"sum_{s}")) for s, x in zip("ab", suspect(k), strict=True)]
        both = sides[0].join(sides[1], F.col("name_a").eqNullSafe(F.col("name_b")) & (F.col("sum_a") == F.col("sum_b")), "full")
        differ = both.where(F.col("sum_a").isNull() | F.col("sum_b").isNull()).select(F.coalesce("name_a", "name_b").alias("name"))
        wrong = materialise(differ.distinct(), f"warc-wrong{k}")
        if wrong.isEmpty():
            break
    sides = suspect(0)
    if wrong.isEmpty():
        sides = [x.limit(0) for x in sides]
    # Equal records cancel out, whichever node they are in.
    sides = [x.select(*(F.col(c).alias(f"{c}_{s}") for c in ("key", "digest", "n", "size", "node", "start"))) for s, x in zip("ab", sides, strict=True)]
    both = sides[0].join(sides[1], F.col("key_a").eqNullSafe(F.col("key_b")) & (F.col("digest_a") == F.col("digest_b")), "full")
    left = []
    for s, t in ("ab", "ba"):
        rest = both.where(F.col(f"n_{s}") > F.coalesce(f"n_{t}", F.lit(0)))
        copy = F.explode(F.sequence(F.coalesce(f"n_{t}", F.lit(0)), F.col(f"n_{s}") - 1)).alias("copy")
        rest = rest.select(F.lit(s).alias("side"), F.col(f"key_{s}").alias("key"), F.col(f"digest_{s}").alias("digest"), F.col(f"size_{s}").alias("size"), F.col(f"node_{s}").alias("node"), F.col(f"start_{s}").alias("start"), copy)
        start = F.col("start") + F.col("copy") * F.col("size")
        fact = F.struct((F.col("node") + F.col("copy")).alias("record_no"), start.alias("range_start"), (start + F.col("size")).alias("range_stop"), F.col("digest").alias("sha256"))
        left.append(rest.select("key", "side", fact.alias("fact")))
    every = materialise(left[0].unionByName(left[1]), "warc-differing")
    side = lambda s: F.when(F.col("side") == s, F.col("fact"))
    count = lambda s: F.count(F.when(F.col("side") == s, 1)).alias(f"n_{s}")
    keys = every.groupBy("key").agg(count("a"), count("b"), F.min(side("a")).alias("a"), F.min(side("b")).alias("b"))
    single = (F.col("n_a") <= 1) & (F.col("n_b") <= 1)
    several = keys.where(~single).select(F.col("key").alias("of"))
    each = every.join(several, F.col("key").eqNullSafe(F.col("of")), "left_semi").select("key", side("a").alias("a"), side("b").alias("b"))
    rows = keys.where(single).select("key", "a", "b").unionByName(each)
    return rows.select("key", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("record_no", "range_start", "range_stop", "sha256")))

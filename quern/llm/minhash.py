"""Near-duplicates: minwise signatures and a multi-index Hamming join.

A document is the set of its shingles of words; documents whose sets have the same 128-bit hash are one node, named by
the least of its rows (rows are numbered once, in the table that holds their texts and signatures). A signature has positions of 16 bits,
each the hash of a set's minimum under one permutation, so the distance of two signatures (positions that differ) follows the
sets' similarity. The whole signature is split into m chunks. By the pigeonhole principle two signatures at most 2m - 1
positions apart have a chunk with at most one error, so a chunk is entered once for each position that may be wrong, with
that position left out: every pair within the distance meets in a bucket. m is the least for which a pair at the similarity
threshold is farther apart with a probability below MISS. Pairs within the distance are confirmed, and no others.

Buckets are worked through in two rounds, so that a group of near copies costs a star, not all its pairs:
1. each node of a bucket is paired with the bucket's least node; pairs within the distance are confirmed on the full
   shingle sets; confirmed links make components;
2. in the buckets that still hold several components, near pairs across components are confirmed as well, in the task that
   holds the bucket: components are joined as it goes, and only the links that joined some leave it. Large buckets are
   dealt out as pairs of blocks.
After that every near pair of a bucket is either in one component or was tested. Texts are fetched only for nodes that have a
partner, by the number of a row, so keys may be null or repeated. Those of the stars meet in a grid of cells, so that a node is sent to as
many cells as hold pairs of it. Blocks and cells are bounded in nodes and in shingles, whichever is met first.

Results: a null text counts as empty; a document without words has no shingle and is linked with nothing; one with fewer words than
a shingle has one shingle, its whole sequence; a text of any length is one set. The component's name is its least key that isn't null.
Rows with equal keys are separate rows. `groups` returns key, n_shingles, component_id and kept, whatever other columns are called;
`representatives` returns the columns of the table. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import append_columns, col, materialise, settled, texts

#: Words of a shingle, positions of a chunk, most probable miss of a pair at the threshold.
WORDS, CHUNK, MISS = 5, 4, 1e-6
#: Nodes of a block of a large bucket, nodes of a side of a cell, and shingles of either.
BLOCK, SIDE, MOST = 1000, 1500, 2_000_000
#: Distinct words remembered by a worker.
MEMORY = 100_000
M = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; only A to Z are lower-cased, only ASCII white space parts words."""
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(ids))
    out = np.full(len(ids) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ ids[i : len(ids) - width + 1 + i]) * M
        out ^= out >> np.uint64(29)
    return np.unique(mixed(out))


class Plan(NamedTuple):
    """Chunks, the positions in them (all of a signature), and the distance up to which pairs meet in a bucket and are confirmed."""

    chunks: int
    positions: int
    far: int


def plan(percent: int) -> Plan:
    """The least signature for a similarity threshold in percent: a pair there is missed with MISS at most."""
    p = 1 - percent / 100
    for chunks in range(4, 200):
        k, far = chunks * CHUNK, 2 * chunks - 1
        if sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(far + 1, k + 1)) < MISS:
            return Plan(chunks, k, far)
    raise ValueError(f"no signature for {percent} percent")


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * k + 1, dtype=np.uint64) * M)
    return seeds[:k, None] | np.uint64(1), seeds[k:, None]


def signature(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits a position."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 4096):
        least = np.minimum(least, (a * sets[None, at : at + 4096] + b).min(1))
    return (mixed(least) >> np.uint64(48)).astype("<u2")


def digest(sets: np.ndarray) -> bytes:
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()


def halves(sets: np.ndarray) -> tuple[int, int]:
    """The 128 bits that name a set."""
    found = digest(sets)
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def signed(df: DataFrame, text: str, k: int, words: int) -> DataFrame:
    """`df` with h1, h2, n_shingles and sig."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        a, b = permutations(k)
        one, two, counts, sigs = [], [], [], []
        for t in texts(part, text):
            s = shingles(t, words)
            h1, h2 = halves(s)
            one.append(h1)
            two.append(h2)
            counts.append(len(s))
            sigs.append(signature(s, a, b).tobytes() if len(s) else b"")
        return [pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())]

    return append_columns(df, "h1 long, h2 long, n_shingles long, sig binary", compute)


def stacked(sigs: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), "<u2").reshape(-1, k)


def bucket_keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """(nodes, chunks * CHUNK) keys: each chunk with each of its positions left out."""
    four = sig.reshape(len(sig), chunks, CHUNK).astype(np.uint64)
    out = np.empty((len(sig), chunks, CHUNK), np.uint64)
    for gap in range(CHUNK):
        value = np.zeros((len(sig), chunks), np.uint64)
        for i in range(CHUNK):
            if i != gap:
                value = value << np.uint64(16) | four[:, :, i]
        out[:, :, gap] = mixed(value ^ mixed(np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(gap + 1)))
    return out.reshape(len(sig), -1).view(np.int64)


def entries(nodes: DataFrame, p: Plan) -> DataFrame:
    """node, sig, n -> key, node, n: a row for each bucket that a node is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = bucket_keys(stacked(part.column(1), p.positions), p.chunks)
                owner, n = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), keys.shape[1]) for i in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(owner), pa.array(n)], names=["key", "node", "n"])

    return nodes.select("node", "sig", "n").mapInArrow(run, "key long, node long, n long")


def near(pairs: DataFrame, nodes: DataFrame, p: Plan, percent: int) -> DataFrame:
    """The pairs (x, y) whose signatures are near and whose sizes allow the similarity."""
    facts = nodes.select("node", "n", "sig")
    both = pairs.join(facts.select(F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("sig").alias("sig_x")), "x")
    both = both.join(facts.select(F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("sig").alias("sig_y")), "y")
    both = both.where(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")).select("x", "y", "sig_x", "sig_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = (stacked(batch.column(2), p.positions) != stacked(batch.column(3), p.positions)).sum(1)
            keep = pa.array(apart <= p.far)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    return both.mapInArrow(run, "x long, y long")


class Group:
    """The nodes of a bucket, or of a pair of its blocks, by their number of shingles."""

    def __init__(self, rows: pa.Table, p: Plan, percent: int):
        get = lambda c: rows.column(c).to_numpy()
        self.plan = p
        self.key, self.mixed = get("key")[0], get("i")[0] != get("j")[0]
        order = np.argsort(get("n"), kind="stable")
        self.order, self.n = order, get("n")[order]
        self.mine, self.node, self.comp = (get(c)[order] for c in ("mine", "node", "comp"))
        self.sig = stacked(rows.column("sig").combine_chunks(), p.positions)[order]
        self.top = np.searchsorted(self.n, self.n * 100 // percent, side="right")  # partners are at most so large

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each node's later near ones in other components, as far as this is the first bucket that the two share."""
        for at in range(len(self.node)):
            other = np.arange(at + 1, self.top[at])
            fit = self.comp[other] != self.comp[at]
            if self.mixed:
                fit &= self.mine[other] != self.mine[at]
            other = other[fit]
            if not len(other):
                continue
            differ = self.sig[other] != self.sig[at]
            close = differ.sum(1) <= self.plan.far
            other, differ = other[close], differ[close]
            if not len(other):
                continue
            # The first bucket of two: the first chunk with one error at most, left out where it is.
            wrong = differ.reshape(len(other), self.plan.chunks, CHUNK)
            errors = wrong.sum(2)
            chunk, rows = (errors <= 1).argmax(1), np.arange(len(other))
            gap = np.where(errors[rows, chunk] == 1, wrong[rows, chunk].argmax(1), 0)
            other = other[bucket_keys(self.sig[at : at + 1], self.plan.chunks)[0][chunk * CHUNK + gap] == self.key]
            if len(other):
                yield at, other


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with the same key, i and j; rows come in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        name = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")], 1)
        cuts = np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if held and tuple(name[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(name[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


GROUP = "key long, i int, j int, mine int, node long, comp long, n long, sig binary"


def across(buckets: DataFrame, nodes: DataFrame, known: DataFrame, p: Plan, percent: int, words: int) -> DataFrame:
    """key, node, n, comp -> links (x, y) that join components within a bucket.

    Near pairs aren't written out: a first pass keeps the nodes that have a partner in their bucket, these get their
    texts, and a second pass confirms the pairs where they meet. A task joins components as it goes and skips what is joined
    already, so what leaves it is a forest.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n_bucket"), F.sum("n").alias("n_all"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    blocks = F.ceil(F.greatest(F.col("n_bucket") / BLOCK, F.least(F.col("n_all") / MOST, F.col("n_bucket")))).cast("int").alias("blocks")
    sizes = sizes.where(F.col("low") < F.col("high")).select("key", blocks)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = buckets.join(sizes, "key").select("key", "node", "comp", mine.alias("mine"), other)
    rows = rows.join(nodes.select("node", "n", "sig"), "node")
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    rows = rows.select("key", low.alias("i"), high.alias("j"), "mine", "node", "comp", "n", "sig")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches):
            group = Group(table, p, percent)
            used = np.zeros(len(group.node), bool)
            for at, partners in group.partners():
                used[at] = True
                used[partners] = True
            if used.any():
                yield from table.take(pa.array(np.sort(group.order[used]))).to_batches()

    some = materialise(dealt.mapInArrow(paired, GROUP), "partners")
    # The nodes asked for grow with the input, so they aren't broadcast, small tables or not.
    found = some.select("node").distinct().join(known.select(F.col("row").alias("of"), "text").hint("merge"), F.col("node") == F.col("of")).select("of", "text")
    full = some.join(found, F.col("node") == F.col("of")).drop("of").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_group(batches):
            sets: dict[int, np.ndarray] = {}
            rows: dict[int, int] = {}
            for at, (node, t) in enumerate(zip(table.column("node").to_pylist(), table.column("text").to_pylist(), strict=True)):
                if node not in sets:
                    sets[node], rows[node] = shingles(t or "", words), at
            group = Group(table.take(pa.array(sorted(rows.values()))), p, percent)
            above: dict[int, int] = {}

            def root(c: int, above: dict[int, int] = above) -> int:
                while (up := above.get(c, c)) != c:
                    above[c] = above.get(up, up)
                    c = up
                return c

            x, y = [], []
            for at, partners in group.partners():
                for q in partners.tolist():
                    a, b = root(int(group.comp[at])), root(int(group.comp[q]))
                    if a != b and alike(sets[int(group.node[at])], sets[int(group.node[q])], percent):
                        above[max(a, b)] = min(a, b)
                        x.append(int(group.node[at]))
                        y.append(int(group.node[q]))
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return full.mapInArrow(linked, "x long, y long")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity."""
    if len(a) > len(b):
        a, b = b, a
    where = np.searchsorted(b, a)
    where[where == len(b)] = 0
    same = int((b[where] == a).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def confirmed(pairs: DataFrame, nodes: DataFrame, known: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (x, y) that are linked on their full shingle sets."""
    paired = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(nodes.select("node", "n"), "node")
    n, total = paired.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    grid = max(1, -(-n // SIDE), -(-total // MOST))
    spot = lambda c: F.pmod(F.xxhash64(F.lit("cell"), c), F.lit(grid)).cast("int")
    placed = pairs.select("x", "y", spot("x").alias("i"), spot("y").alias("j"))
    asked = placed.select("i", "j", F.explode(F.array("x", "y")).alias("node")).distinct()
    found = asked.join(known.select(F.col("row").alias("node"), "text").hint("merge"), "node").select(F.col("i").alias("of_i"), F.col("j").alias("of_j"), "node", "text")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {node: shingles(t or "", words) for node, t in zip(right.column("node").to_pylist(), right.column("text").to_pylist(), strict=True)}
        x, y = left.column("x").to_numpy(), left.column("y").to_numpy()
        keep = np.zeros(len(x), bool)
        for at, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            keep[at] = alike(sets[p], sets[q], percent)
        return pa.table({"x": x[keep], "y": y[keep]})

    return placed.groupBy("i", "j").cogroup(found.groupBy("of_i", "of_j")).applyInArrow(run, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) of every node in a link, by alternating large and small stars."""
    edges, before = materialise(links.where("x <> y").select("x", "y").distinct(), "edges"), None
    while True:
        for large in (True, False):
            both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
            if not large:
                both = both.where("y < x")
            least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
            joined = both.join(least, "x")
            if large:
                new = joined.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
            else:
                new = joined.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y")))
            new = new.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
            edges = materialise(new, "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.bit_xor(F.xxhash64("y"))).first())
        if now == before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("comp")).union(edges.select(F.col("y").alias("node"), F.col("y").alias("comp")).distinct())
        before = now


def numbered(df: DataFrame, key: str, text: str, p: Plan, words: int, carry: bool) -> DataFrame:
    """The table that everything is looked up in: row (a number), key, text, h1, h2, n_shingles, sig, and with `carry` all columns as c0, c1..."""
    own = [col(c).alias(f"c{i}") for i, c in enumerate(df.columns)] if carry else []
    rows = df.select(F.monotonically_increasing_id().alias("row"), col(key).alias("key"), col(text).alias("text"), *own)
    return materialise(signed(rows, "text", p.positions, words), "signatures")


def component_of(known: DataFrame, p: Plan, percent: int, words: int) -> DataFrame:
    """h1, h2, comp, least_key of every set that isn't empty."""
    nodes = known.where("n_shingles > 0").groupBy("h1", "h2")
    nodes = nodes.agg(F.min("row").alias("node"), F.min("key").alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = materialise(nodes, "nodes")

    entered = entries(nodes, p)
    pivots = entered.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("key", "pivot")
    shared = materialise(entered.join(pivots, "key"), "buckets")
    stars = shared.where("node <> pivot").select(F.col("pivot").alias("x"), F.col("node").alias("y")).distinct()
    tested = materialise(near(stars, nodes, p, percent), "stars")
    links = materialise(confirmed(tested, nodes, known, percent, words), "links")
    comps = settled(lambda: components(links), "components")

    named = shared.select("key", "node", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    more = settled(lambda: across(named, nodes, known, p, percent, words), "more-links")
    if not more.isEmpty():
        comps = settled(lambda: components(links.union(more)), "components")

    joined = nodes.select("node", "h1", "h2", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = joined.groupBy("comp").agg(F.min("least").alias("least_key"))
    return joined.join(names, "comp").select("h1", "h2", "comp", "least_key")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, words: int = WORDS) -> DataFrame:
    """A row for each row of `df`: its key, n_shingles, component_id, kept. Links: similarity of `percent` or more."""
    p = plan(percent)
    known = numbered(df, key, text, p, words, carry=False)
    found = settled(lambda: component_of(known, p, percent, words), "sets")
    out = known.select("key", "n_shingles", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("key")).otherwise(F.col("least_key"))
    out = out.select("key", "n_shingles", component.alias("component_id"))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, words: int = WORDS) -> DataFrame:
    """The rows of `df` that stay, one for each component: of its least key (null last), and of that key's rows the first by a hash of its set.
    Rows without shingles stay."""
    p = plan(percent)
    known = numbered(df, key, text, p, words, carry=True)
    found = settled(lambda: component_of(known, p, percent, words), "sets")
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col("h1"), F.col("h2"), F.col("row"))
    best = known.select("row", "key", "h1", "h2").join(found, ["h1", "h2"]).groupBy("comp").agg(F.min(order)["row"].alias("row")).select("row")
    stays = best.union(known.where("n_shingles = 0").select("row"))
    return known.join(stays, "row", "left_semi").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))

"""Exact deduplication by Patricia-trie owners.

Texts are dealt out by length and content hash. Each partition inserts the full byte strings into compressed radix tries; the node
where a string ends stores its owner (the identifier that stays) and its count. Two strings are equal only if they end in the same
node. Before the shuffle every input partition builds such tries of its own and passes on one row a distinct text, so a text with a
third of all rows arrives as one row a partition.

Tries that outgrow their budget spill by subtree: the largest goes to a scratch file, with what arrives for it later, and is
rebuilt on its own at the end. If it is still too large it is split where its strings part, and so on down.

`mark` names the owner of every row: rows find their text's owner by the SHA-256 of the text, those of the most common texts in a
broadcast table of HOT rows at most. `representatives` returns the owners' whole rows straight from the tries, so texts cross one shuffle.

Results: equality is after lower-casing A to Z; a null text counts as empty. The owner is the largest or the smallest identifier,
a null one losing to any other; for `mark` rows with the same identifier and text are one document and stay or go together, of which
`representatives` returns the least by its columns in order, nulls last. A text of any length is one string. An empty table
gives no rows. Other columns are kept, clashing ones replaced.
"""

from __future__ import annotations

import pickle
import string
import tempfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SLICE_BYTES, col, materialise, slices

#: Bytes of strings and nodes that a task's tries may hold before they spill or, before the shuffle, are passed on.
BUDGET = 48 << 20
NODE_BYTES = 300
#: Subtrees at the top, by length; rows of a returned batch.
PLACES, ROWS = 64, 2000
#: Most texts whose owners are broadcast: each holds more than 1 / HOT of all rows.
HOT = 1000


class Node:
    """A compressed edge: the bytes that lead here, the nodes below by their first byte, and what ends here."""

    __slots__ = ("count", "label", "low", "owner")

    def __init__(self, label: bytes):
        self.label, self.low, self.owner, self.count = label, None, None, 0


def common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of `a` stand at place `at` of `b`."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n  # the first `low` agree, the first `high` don't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """Strings with their owners; `weigh` tells the bytes of an owner that count beside those of the nodes."""

    def __init__(self, better: Callable, weigh: Callable[[object], int] | None = None):
        self.better, self.weigh, self.root, self.bytes = better, weigh, Node(b""), 0

    def insert(self, text: bytes, owner, count: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            below = node.low.get(text[at]) if node.low else None
            if below is None:
                below = Node(text[at:])
                self.bytes += NODE_BYTES + len(below.label)
                node.low = node.low or {}
                node.low[text[at]] = below
                node, at = below, len(text)
                break
            n = common(below.label, text, at)
            if n < len(below.label):  # split the edge
                middle = Node(below.label[:n])
                below.label = below.label[n:]
                middle.low = {below.label[0]: below}
                node.low[text[at]] = middle
                self.bytes += NODE_BYTES
                below = middle
            node, at = below, at + n
        if self.weigh:
            self.bytes -= self.weigh(node.owner) if node.count else 0
        node.owner = owner if not node.count else self.better(node.owner, owner)
        node.count += count
        if self.weigh:
            self.bytes += self.weigh(node.owner)

    def items(self, node: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, object, int]]:
        """Every string with its owner and count."""
        stack = [(node or self.root, before)]
        while stack:
            at, path = stack.pop()
            path = path + at.label
            if at.count:
                yield path, at.owner, at.count
            stack.extend((x, path) for x in (at.low or {}).values())

    def parts(self) -> bool:
        """Whether there are several strings."""
        low = self.root.low or {}
        return len(low) + bool(self.root.count) > 1 or any(x.low for x in low.values())

    def shared(self) -> int:
        """Bytes that all strings have in common at the front."""
        low = self.root.low or {}
        return len(next(iter(low.values())).label) if len(low) == 1 and not self.root.count else 0


class Tries:
    """Subtrees by `place` of a string, within a budget: the largest go to scratch files and are finished one by one. What is held is
    within the budget, but for one string that is alone."""

    def __init__(self, better: Callable, budget: int, place: Callable[[bytes], int] = lambda body: len(body) % PLACES, weigh: Callable | None = None):
        self.better, self.budget, self.place, self.weigh, self.bytes = better, budget, place, weigh, 0
        self.low: dict[int, Trie] = {}
        self.files: dict[int, BinaryIO] = {}

    def insert(self, body: bytes, owner, count: int) -> None:
        k = self.place(body)
        if k in self.files:
            pickle.dump((body, owner, count), self.files[k])
            return
        trie = self.low.get(k)
        if trie is None:
            trie = self.low[k] = Trie(self.better, self.weigh)
        before = trie.bytes
        trie.insert(body, owner, count)
        self.bytes += trie.bytes - before
        while self.bytes > self.budget and (len(self.low) > 1 or trie.parts()):
            self.spill()
            if k not in self.low:
                break

    def spill(self) -> None:
        k = max(self.low, key=lambda x: self.low[x].bytes)
        trie = self.low.pop(k)
        self.bytes -= trie.bytes
        self.files[k] = tempfile.TemporaryFile()  # has no name: gone with the task, however that ends
        for row in trie.items():
            pickle.dump(row, self.files[k])

    def finish(self) -> Iterator[tuple[bytes, object, int]]:
        """Every string with its owner and count. Nothing can be inserted from here on."""
        for k in list(self.low):
            yield from self.low.pop(k).items()
        for k in list(self.files):
            with self.files.pop(k) as file:
                file.seek(0)
                yield from self._rebuilt(file)

    def _rebuilt(self, file: BinaryIO) -> Iterator[tuple[bytes, object, int]]:
        trie, deeper = Trie(self.better, self.weigh), None
        for row in _rows(file):
            if deeper is None:
                trie.insert(*row)
                if trie.bytes > self.budget and trie.parts():
                    at = trie.shared()  # strings part at this byte
                    deeper = Tries(self.better, self.budget, lambda body, at=at: body[at] if len(body) > at else -1, self.weigh)
                    for each in trie.items():
                        deeper.insert(*each)
                    trie = Trie(self.better)
            else:
                deeper.insert(*row)
        yield from deeper.finish() if deeper else trie.items()


def _rows(file: BinaryIO) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def normal(text: Column) -> Column:
    """The text with A to Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _better(keep: str) -> Callable:
    def better(a, b):
        if a is None or b is None:
            return b if a is None else a
        return (max if keep == "largest" else min)(a, b)

    return better


def _tries(df: DataFrame, schema, rows_of: Callable, batch_of: Callable, better: Callable, final: bool, weigh: Callable | None = None) -> DataFrame:
    """One row for each distinct string of a partition. `rows_of` a batch are (string, owner, count); `batch_of` makes a batch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda: Tries(better, BUDGET if final else 2 * BUDGET, weigh=weigh)
        tries, form = new(), None

        def done() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            weight = 0
            for row in tries.finish():
                rows.append(row)
                weight += len(row[0])
                if len(rows) >= ROWS or weight > SLICE_BYTES:
                    yield batch_of(rows, form)
                    rows, weight = [], 0
            if rows:
                yield batch_of(rows, form)

        for batch in batches:
            form = batch.schema
            for part in slices(batch):
                for row in rows_of(part):
                    tries.insert(*row)
                if not final and tries.bytes > BUDGET:  # partial rows can go on at any time
                    yield from done()
                    tries = new()
        yield from done()

    return df.mapInArrow(run, schema)


def owners(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each distinct text: text_sha256, owner, group_size."""
    kind = df.select(col(key)).schema[0].dataType.simpleString()
    schema = f"body binary, owner {kind}, group_size long"
    rows = df.select(normal(col(text)).cast("binary").alias("body"), col(key).alias("owner"), F.lit(1).cast("long").alias("group_size"))

    def rows_of(part: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)

    def batch_of(found: list[tuple], form: pa.Schema) -> pa.RecordBatch:
        bodies, ids, counts = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), pa.array(ids, form.field(1).type), pa.array(counts, pa.int64())], names=["body", "owner", "group_size"])

    local = _tries(rows, schema, rows_of, batch_of, _better(keep), final=False)
    dealt = local.repartition(F.length("body"), F.xxhash64("body"))
    merged = _tries(dealt, schema, rows_of, batch_of, _better(keep), final=True)
    return merged.select(F.sha2("body", 256).alias("text_sha256"), "owner", "group_size")


def mark(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """`df` with text_sha256 (of the normalised text), keep_id, group_size and kept."""
    found = materialise(owners(df, key, text, keep).withColumnRenamed("owner", "keep_id"), "owners")
    n = found.agg(F.sum("group_size")).first()[0] or 0
    common_ones = F.col("group_size") * HOT > n  # so fewer than HOT texts
    hot = found.where(common_ones).select(F.col("text_sha256").alias("of"), F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    cold = found.where(~common_ones).withColumnRenamed("text_sha256", "cold_of")
    new = {"text_sha256", "keep_id", "group_size", "kept"}
    before = [c for c in df.columns if c.lower() not in new]
    left = df.select(*(col(c).alias(f"c{i}") for i, c in enumerate(before)), col(key).alias("key"), F.sha2(normal(col(text)).cast("binary"), 256).alias("text_sha256"))
    left = left.join(F.broadcast(hot), F.col("text_sha256") == F.col("of"), "left")
    # What has its owner already is dealt out anywhere and meets nothing.
    spread = F.when(F.col("of").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("hot"), F.pmod(F.xxhash64("key", "text_sha256", F.rand(7)), F.lit(9973))))
    both = left.withColumn("meet", spread).join(cold, F.col("meet") == F.col("cold_of"), "left")
    both = both.withColumn("keep_id", F.when(F.col("of").isNull(), F.col("keep_id")).otherwise(F.col("hot_id")))
    kept = F.col("key").eqNullSafe(F.col("keep_id")).alias("kept")
    return both.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(before)), "text_sha256", "keep_id", F.coalesce("hot_size", "group_size").alias("group_size"), kept)


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of `df` that stay, one for each distinct text, in the columns of `df`."""
    names = df.columns
    at_key, at_text = names.index(key), names.index(text)
    first = _better(keep)

    def order(row: tuple) -> tuple:
        return tuple((v is None, str(v)) for v in row)

    def better(a: tuple, b: tuple) -> tuple:
        if a[at_key] == b[at_key]:
            return min(a, b, key=order)
        return a if first(a[at_key], b[at_key]) == a[at_key] else b

    def weigh(row: tuple) -> int:
        return NODE_BYTES + len(row[at_text] or "")

    def rows_of(part: pa.RecordBatch) -> Iterator[tuple]:
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            yield (row[at_text] or "").encode().lower(), row, 1  # of bytes only A to Z have another case

    def batch_of(found: list[tuple], form: pa.Schema) -> pa.RecordBatch:
        columns = zip(*(row for _, row, _ in found), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, form, strict=True)], names=names)

    local = _tries(df, df.schema, rows_of, batch_of, better, final=False, weigh=weigh)
    body = normal(col(text)).cast("binary")
    return _tries(local.repartition(F.length(body), F.xxhash64(body)), df.schema, rows_of, batch_of, better, final=True, weigh=weigh)

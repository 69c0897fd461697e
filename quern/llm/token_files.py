"""Token ids in files: frequency-ranked ids, byte-aligned variable-length coding with separate control bytes.

`write` deals documents out in order of their key and writes their packed ids once, in blocks. The ids of all blocks are then counted
and ranked by their frequency in the corpus (ties: the smaller id first), and the blocks are coded from the written ids. A block
holds its documents' lengths and the ranks of their ids, each as a run of control bytes (two bits a value: its bytes less one)
and a run of value bytes; the one table of ranks lies beside the blocks. `read` decodes with numpy: a control byte looks up in a table which
bytes of its four values were kept, the value bytes fill these, and the ranks look up the ids. Blocks are rows of a Parquet table, so any
store that Spark can write holds them and a lost task leaves no half of a file.

Plain texts (Latin script in composed form) are cut into the splitter's own matches by the kinds of their bytes, in numpy, and each
distinct match is encoded once by the library. Other texts are cut at blanks and line feeds, which the library's normaliser and splitter
never look across; their pieces that aren't plain go to the library as they are.

Results: a null text counts as empty; a null key comes first; rows with equal keys are ordered by text; an empty table gives an
empty file set. A text of any length is one row; a block is closed behind it. Other columns of the table aren't looked at, whatever
their names.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import col, materialise, release, slices

#: Ids of a block, at which it is closed: about half a megabyte. Rows are copied several times on their way to a file.
BLOCK_IDS = 250_000
#: Distinct words remembered by a worker.
WORDS = 900_000
#: First bytes of a block, then distinct ids, documents, ids, and bytes of the runs of each, control bytes first.
HEAD = struct.Struct("<4sIIQ6I")
MAGIC = b"QVB1"
#: Whatever isn't ASCII text, a Latin letter that is its own composed form, or common punctuation.
OTHER = "[^\t\n\r\x20-\x7e\u00c0-\u012f\u0132-\u017e\u2010-\u201e\u2026]"
#: Kinds of bytes of plain texts in lower case: the splitter matches runs of letters, single digits and runs of whatever else isn't
#: blank. Bytes from 128 on count as letters; `matches` mends those that are punctuation.
BLANK, LETTER, DIGIT, MARK = range(4)
KINDS = np.array([BLANK if c in b"\t\n\r " else LETTER if c >= 128 or chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK for c in range(256)], np.uint8)
#: What the splitter parts from a word behind an apostrophe.
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")
#: Which of the sixteen bytes of its four values each control byte keeps, from the rule of two bits a value.
KEPT = np.array([[k <= c >> 2 * i & 3 for i in range(4) for k in range(4)] for c in range(256)], bool)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and value bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    more = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]].tobytes()
    four = np.concatenate([more, np.zeros(-len(more) % 4, np.uint8)]).reshape(-1, 4)
    return (four << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes(), data


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    kept = KEPT[control].ravel()[: 4 * n]
    if np.count_nonzero(kept) != len(data):
        raise ValueError(f"{len(data)} value bytes where the control bytes tell of {np.count_nonzero(kept)}")
    out = np.zeros(4 * n, np.uint8)
    out[kept] = data
    return out.view("<u4")


def ranked(counts: np.ndarray) -> np.ndarray:
    """The ids that are used in order of rank."""
    used = np.flatnonzero(counts)
    return used[np.argsort(-counts[used], kind="stable")]


def encode_block(lengths: np.ndarray | list[int], ids: np.ndarray, order: np.ndarray | None = None) -> bytes:
    """A block by the ranks of `order`; without it by those of its own ids, which it then holds."""
    own = ranked(np.bincount(ids)) if order is None else np.zeros(0, np.uint32)
    order = own if order is None else order
    rank_of = np.zeros(int(order.max()) + 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    runs = [*encode_values(own), *encode_values(np.array(lengths, np.uint32)), *encode_values(rank_of[ids])]
    return HEAD.pack(MAGIC, len(own), len(lengths), len(ids), *map(len, runs)) + b"".join(runs)


def decode_block(block: bytes, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents' lengths and all ids; `order` is what the block was coded with."""
    magic, *counts = HEAD.unpack_from(block)
    counts, sizes = counts[:3], counts[3:]
    if magic != MAGIC or len(block) != HEAD.size + sum(sizes) or not counts[0] and order is None:
        raise ValueError("not a whole block")
    runs, at = [], HEAD.size
    for size in sizes:
        runs.append(np.frombuffer(block, np.uint8, size, at))
        at += size
    ids, lengths, ranks = (decode_values(runs[2 * i], runs[2 * i + 1], n) for i, n in enumerate(counts))
    return lengths, (ids if counts[0] else order)[ranks]


def pack_ids(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, otherwise four."""
    return ids.astype("<u4" if len(ids) and ids.max() >> 16 else "<u2").tobytes()


def unpack_ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * n else "<u2")


def is_odd(column: pa.Array) -> np.ndarray:
    """Which texts the library has to see: not plain Latin script in composed form, or perhaps with an added token."""
    return pc.or_(pc.match_substring_regex(column, OTHER), pc.match_substring(column, "<|")).to_numpy(zero_copy_only=False)


def matches(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The splitter's matches in plain texts, in lower case and one after the other, and how many lie before each text and the end."""
    low = pc.utf8_lower(column)
    edges = np.frombuffer(low.buffers()[1], np.int32, len(low) + 1, 4 * low.offset).astype(np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    n = len(data)
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    kind = KINDS[data]
    three = np.flatnonzero(data == 0xE2)  # dashes, quotes, ellipsis
    for i in range(3):
        kind[three + i] = MARK
    two = np.flatnonzero(data == 0xC3)
    two = two[(padded[two + 1] == 0x97) | (padded[two + 1] == 0xB7)]  # multiplication and division signs
    kind[two] = kind[two + 1] = MARK
    first = np.zeros(n + 3, bool)  # of a text
    first[edges] = True
    begins = first[:n] | (kind == DIGIT)
    begins[1:] |= kind[1:] != kind[:-1]
    # An apostrophe alone before letters takes some of them with it.
    at = np.flatnonzero(data == ord("'"))
    at = at[begins[at]]
    at = at[~first[at + 1]]
    at = at[kind[at + 1] == LETTER]
    one, other = padded[at + 1], padded[at + 2]
    pair = np.zeros(len(at), bool)
    for a, b in LONG:
        pair |= (one == a) & (other == b)
    pair &= ~first[at + 2]
    taken = np.isin(one, np.frombuffer(SHORT, np.uint8)) | pair
    at, behind = at[taken], at[taken] + 2 + pair[taken]
    begins[at + 1] = False
    behind = behind[behind < n]
    begins[behind] = True
    solid = kind != BLANK
    begins &= solid
    starts = np.flatnonzero(begins)
    offsets = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    return words, np.searchsorted(starts, edges)


def joined(packed: list[bytes], indices: pa.Array, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the parts that `indices` names among `packed`, and how many lie between neighbours of `before`."""
    every = np.frombuffer(b"".join(packed), "<u4")
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    starts = np.cumsum(sizes) - sizes
    at = indices.to_numpy(zero_copy_only=False)
    counts = sizes[at]
    ends = np.concatenate([[0], np.cumsum(counts)])
    found = every[np.repeat(starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
    return found, np.diff(ends[before])


class Words(dict):
    """Packed ids of words, by their bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.before: dict[bytes, bytes] = {}  # the generation before: what is used again moves on
        tokens = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(tokens.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column one after the other, and how many each text has."""
        column = pc.fill_null(column, "")
        odd = is_odd(column)
        if not odd.any():
            return self._plain(column)
        sides = self._plain(column.filter(pa.array(~odd))), self._odd(column.filter(pa.array(odd)))
        counts = np.zeros(len(column), np.int64)
        counts[~odd], counts[odd] = sides[0][1], sides[1][1]
        found, where = np.empty(int(counts.sum()), np.uint32), np.repeat(odd, counts)
        found[~where], found[where] = sides[0][0], sides[1][0]
        return found, counts

    def encode(self, batch: list[str]) -> list[bytes]:
        """The packed ids of texts."""
        found, lengths = self.ids(pa.array(batch, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(found, np.cumsum(lengths)[:-1])] if batch else []

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`ids` of plain texts: Python meets each distinct word once a slice."""
        words, before = matches(column)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(set(distinct))
        return joined(list(map(self.__getitem__, distinct)), coded.indices, before)

    def _odd(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`ids` of texts with pieces that are left to the library; the other pieces are plain texts."""
        cut = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        odd = is_odd(coded.dictionary)
        found, counts = self._plain(coded.dictionary.filter(pa.array(~odd)))
        packed = np.empty(len(odd), object)
        ends = np.cumsum(counts)
        packed[~odd] = [found[a:b].astype("<u4").tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        left = self.library.encode_batch(coded.dictionary.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)
        packed[odd] = [np.array(x.ids, "<u4").tobytes() for x in left]
        return joined(packed.tolist(), coded.indices, cut.offsets.to_numpy() - cut.offsets[0].as_py())

    def _learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > WORDS // 2:
            self.before = dict(self)
            self.clear()
        fresh = words.difference(self)
        if again := fresh.intersection(self.before) if self.before else ():
            self.update(zip(again, map(self.before.__getitem__, again), strict=True))
            fresh -= again
        fresh = list(fresh)
        for at in range(0, len(fresh), 200):
            some = fresh[at : at + 200]
            ids = np.array(self.library.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            packed, start = ids.tobytes(), 0
            for word, stop in zip(some, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
                self[word] = packed[start:stop]
                start = stop


@lru_cache(maxsize=2)
def load(path: str) -> Words:
    return Words(path)


def write(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes blocks and ranks to `path`: all documents' ids in ascending order of `key`, each with `end_id` behind it."""
    kind = next(f.dataType for f in df.schema if f.name == key)
    placed = T.StructType.fromDDL("part int, block int, before long, n_ids long").add("keys", T.ArrayType(kind))
    raw = T.StructType([*placed, T.StructField("lengths", T.BinaryType()), T.StructField("ids", T.BinaryType())])
    schema = T.StructType([*placed, T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(tokenizer)
        part, block, before, total = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            arrays = pa.concat_arrays(keys)
            listed = pa.ListArray.from_arrays(pa.array([0, len(arrays)], pa.int32()), arrays)
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([total]), listed]
            data = [np.concatenate(lengths).astype("<u4").tobytes(), pack_ids(np.concatenate(ids))]
            return pa.RecordBatch.from_arrays([*row, *(pa.array([d], pa.binary()) for d in data)], names=raw.names)

        for batch in batches:
            for piece in slices(batch):
                if not piece.num_rows:
                    continue
                found, sizes = words.ids(piece.column(1))
                ends = np.cumsum(sizes + 1)
                with_ends = np.empty(len(found) + len(sizes), np.uint32)
                own = np.ones(len(with_ends), bool)
                own[ends - 1] = False
                with_ends[own], with_ends[ends - 1] = found, end_id
                at = first = 0
                while at < len(sizes):  # the documents up to the one at which the block is full
                    to = min(int(np.searchsorted(ends, first + BLOCK_IDS - total)) + 1, len(sizes))
                    last = int(ends[to - 1])
                    keys.append(piece.column(0).slice(at, to - at))
                    lengths.append(sizes[at:to] + 1)
                    ids.append(with_ends[first:last])
                    total += last - first
                    at, first = to, last
                    if total >= BLOCK_IDS:
                        yield close()
                        before, block, total = before + total, block + 1, 0
                        keys, lengths, ids = [], [], []
        if lengths:
            yield close()
        release()

    ordered = df.select(col(key), col(text)).repartitionByRange(col(key)).sortWithinPartitions(col(key), col(text))
    written = materialise(ordered.mapInArrow(run, raw), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load.cache_clear()  # words are no longer needed in a worker that is used again
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.bincount(unpack_ids(data.as_buffer(), n), minlength=len(total))
                more[: len(total)] += total
                total = more
        release()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    # A row for each id of the vocabulary at most.
    counted = written.select("n_ids", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted.coalesce(1).write.parquet(f"{path}/ranks")
    order = ranks(df.sparkSession, path)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load.cache_clear()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = unpack_ids(row.column("ids")[0].as_buffer(), row.column("n_ids")[0].as_py())
                data = encode_block(np.frombuffer(row.column("lengths")[0].as_buffer(), "<u4"), ids, order)
                yield pa.RecordBatch.from_arrays([*(row.column(n) for n in placed.names), pa.array([data], pa.binary())], names=schema.names)
        release()

    written.mapInArrow(code, schema).write.parquet(f"{path}/blocks")


def ranks(spark: SparkSession, path: str) -> np.ndarray:
    """The ids of the files in order of rank."""
    found = spark.read.parquet(f"{path}/ranks").orderBy(F.desc("n"), "id").collect()
    return np.array([r["id"] for r in found], np.uint32)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """A row for each document of the files: key, start (ids of all documents before it) and its packed ids with the end id."""
    blocks, order = spark.read.parquet(f"{path}/blocks"), ranks(spark, path)
    # A row for each task that wrote: the driver has kept more than that of each already.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base, so_far = {}, 0
    for r in totals:
        base[r["part"]] = so_far
        so_far += r["n"]
    kind = blocks.schema["keys"].dataType.elementType
    schema = T.StructType().add(key, kind).add("start", T.LongType()).add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in ("part", "before", "data")}
                lengths, found = decode_block(row["data"].as_py(), order)
                ids = found.tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                keys = batch.column("keys").slice(i, 1).flatten()
                at = pa.array(starts + base[row["part"].as_py()] + row["before"].as_py())
                cut = pa.array([ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, at, cut], names=schema.names)
        release()

    return blocks.mapInArrow(run, schema)

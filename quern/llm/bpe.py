"""Byte-level BPE by monoid tree reduction.

Token sequences form a monoid: the product of the encodings of two byte strings is the encoding of their concatenation.
A long match is halved until the halves are small, the small ones are merged directly by rank, and neighbours are
joined up the tree. A join re-encodes a window around the seam and widens it until the tokens outside are proven stable:
a sequence is the encoding of its bytes exactly when every two adjacent tokens, encoded together, give themselves back. So
once both edges of the window are such pairs, everything outside stays as it was. Decoding concatenates up the same tree.

Results: a null text counts as empty, and an empty text has no ids. Repeated rows get equal ids. `encode` and `decode` replace a
column whose name is that of their output.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import append_columns, texts

#: Bytes up to which a part is merged directly; longer ones are halved.
LEAF_BYTES = 5
#: Bytes up to which an encoding is remembered by a worker; matches, and halves, windows or token pairs that are.
KNOWN_BYTES, MATCHES, PARTS = 32, 200_000, 60_000
#: Tokens decoded in one leaf of the tree.
LEAF_TOKENS = 4096


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.packed = [rank.to_bytes(4, "little") for rank in range(len(self.vocab))]
        self.matches = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.cache = _Cache(self)

    def leaf(self, data: bytes) -> list[int]:
        """Direct merging: the adjacent pair of lowest rank first, the leftmost among equals."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) > 2 * KNOWN_BYTES:
            return self._heap(data)
        rank, none = self.ranks.get, len(self.vocab)
        at = list(range(len(data) + 1))
        scores = [rank(data[i : i + 2], none) for i in at[:-2]]
        while scores and (best := min(scores)) < none:
            i = scores.index(best)
            del at[i + 1], scores[i]
            if i < len(scores):
                scores[i] = rank(data[at[i] : at[i + 2]], none)
            if i:
                scores[i - 1] = rank(data[at[i - 1] : at[i + 1]], none)
        return [self.ranks[data[i:j]] for i, j in zip(at, at[1:], strict=False)]

    def _heap(self, data: bytes) -> list[int]:
        """The same order of merges for wide windows, in n log n."""
        n, rank = len(data), self.ranks.get
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and ends[i] < n and (r := rank(data[i : ends[ends[i]]])) is not None:
                heapq.heappush(queue, (r, i, ends[ends[i]]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, end = heapq.heappop(queue)
            if not alive[i] or ends[i] >= end or ends[ends[i]] != end:
                continue
            alive[ends[i]] = 0
            ends[i] = end
            if end < n:
                before[end] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def stable(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens, encoded together, give themselves back."""
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= PARTS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.leaf(self.vocab[left] + self.vocab[right]) == [left, right]
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The product of two encodings."""
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            data = b"".join([self.vocab[t] for t in a[-i:] + b[:j]])
            if (window := self.parts.get(data)) is None:
                window = self.known(data, self.leaf(data))
            left = i == len(a) or self.stable(a[-i - 1], window[0])
            right = j == len(b) or self.stable(window[-1], b[j])
            if left and right:
                return a[:-i] + window + b[j:]
            i = i if left else min(len(a), 2 * i)
            j = j if right else min(len(b), 2 * j)

    def known(self, data: bytes, ids: list[int]) -> list[int]:
        if len(data) <= KNOWN_BYTES:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[data] = ids
        return ids

    def encode_match(self, data: bytes) -> list[int]:
        """The tree of a match: halves down to leaves, joins up. Halves that were met before are not computed again."""
        if len(data) <= LEAF_BYTES:
            return self.leaf(data) if data else []
        half = len(data) // 2
        sides = []
        for part in (data[:half], data[half:]):
            if (ids := self.parts.get(part)) is None:
                ids = self.known(part, self.encode_match(part))
            sides.append(ids)
        return self.join(*sides)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.matches(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return b"".join(map(self.vocab.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Cache(dict):
    """Packed ids by match, at most MATCHES of them."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, match: str) -> bytes:
        data = match.encode()
        packed = b"".join(map(self.bpe.packed.__getitem__, self.bpe.encode_match(data)))
        if len(data) <= KNOWN_BYTES:
            if len(self) >= MATCHES:
                self.clear()
            self[match] = packed
        return packed


@lru_cache(maxsize=2)
def load(ranks_path: str, pattern: str) -> Bpe:
    """The encoder of a rank file with one base64 token and its rank a line."""
    with open(ranks_path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`df` with its texts' ids in column `ids` (binary, little-endian unsigned 32-bit). `ranks_path` is on every executor.

    With a name in `decoded` the ids are decoded again into a column of that name, where they were made.
    """

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        bpe = load(ranks_path, pattern)
        found = [bpe.encode(t) for t in texts(part, text)]
        out = [pa.array(found, pa.binary())]
        if decoded:
            out.append(pa.array([bpe.decode(np.frombuffer(x, "<u4")) for x in found], pa.binary()))
        return out

    return append_columns(df, f"`{ids}` binary" + (f", `{decoded}` binary" if decoded else ""), compute)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the bytes of the packed ids in column `decoded`; null ids count as none."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        bpe = load(ranks_path, pattern)
        return [pa.array([bpe.decode(np.frombuffer(x or b"", "<u4")) for x in part.column(ids).to_pylist()], pa.binary())]

    return append_columns(df, f"`{decoded}` binary", compute)

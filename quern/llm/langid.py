"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams in order of frequency. A document's own list, made of its whole
text, is compared with each profile by out-of-place distance: the sum over the document's n-grams of how far each stands
from its place in the profile, or the profile's length where it isn't there. The nearest language is the prediction.

Letters are lower-cased; whatever is between letters is one word boundary, which takes part in the n-grams.

Results: a null text or one without a letter is `und` with score 0. Equal counts are ordered by the n-gram's code points, equal distances by
the language's name. Without any profile (no labelled text) every document is `und`. Scores are 1 less the distance as a share of
the largest possible one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import append_columns, col, hex_unit, slices

#: Longest n-gram, n-grams of a profile, n-grams of a document that are compared.
MAX_N, PROFILE, TOP = 3, 400, 400
#: Labelled documents of a language that profiles are learned from, as expected by a draw over all of them.
SAMPLE = 1500
UND = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """One more than the lower-case letter of each code point, or 1 (a word boundary) where it isn't a letter."""
    out = np.ones(0x110000, np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0]) + 1
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts, sorted. An n-gram is its symbols, none of them 0, at 21 bits each."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    points = np.concatenate([[1], points, [1]])
    points = points[(points > 1) | np.concatenate([[True], points[:-1] > 1])]  # one boundary between words
    grams, longer = [points[points > 1]], points
    for n in range(2, MAX_N + 1):
        longer = longer[:-1] << 21 | points[n - 1 :]
        grams.append(longer)
    every = np.sort(np.concatenate(grams))
    if not len(grams[0]):
        return every[:0], every[:0]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.diff(np.append(first, len(every)))


def top(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent keys in order; the smaller key first among equals. Keys come sorted."""
    if len(keys) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        more = counts >= least
        keys, counts = keys[more], counts[more]
    return keys[np.argsort(-counts, kind="stable")][:n]


class Profiles:
    """Ranks of every profile's n-grams side by side."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.keys = np.array(sorted({k for p in profiles.values() for k in p}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), PROFILE, np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = ngrams(text or "")
        if not len(keys) or not self.langs:
            return UND, 0.0
        best = top(keys, counts, TOP)
        at = np.searchsorted(self.keys, best)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != best] = len(self.keys)
        ranks = self.ranks[:, at]
        apart = np.where(ranks == PROFILE, PROFILE, np.minimum(np.abs(ranks - np.arange(len(best), dtype=np.int32)), PROFILE))
        distance = apart.sum(1)
        i = int(distance.argmin())
        return self.langs[i], float(1 - distance[i] / (PROFILE * len(best)))


def fit(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, list[int]]:
    """Profiles by language from the rows where `learn` holds and the language isn't null.

    Each language's rows are drawn by a hash of the key at the rate that gives SAMPLE of them; the rates come from counts
    over all rows. What reaches the driver is PROFILE n-grams a language.
    """
    rows = df.where(learn & col(lang).isNotNull()).select(col(key).alias("key"), col(text).alias("text"), col(lang).alias("lang"))
    # A row a language, as in the profiles themselves. A join with them would move whole texts.
    rates = {r["lang"]: SAMPLE / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rate = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in rates.items()), F.lit(0.0))
    drawn = rows.where(hex_unit(F.col("key"), "langid") < rate).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found: dict[str, list[str]] = {}
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found.setdefault(name, []).append(t or "")
                for name, those in found.items():
                    keys, counts = ngrams("\n".join(those))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    counted = drawn.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Spark keeps PROFILE rows a language in each task before it brings them together.
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "place").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(df: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """`df` with `lang_pred` and `score`."""
    known: list[Profiles] = []

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        if not known:
            known.append(Profiles(profiles))
        found = [known[0].predict(t) for t in part.column(text).to_pylist()]
        return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    return append_columns(df, "lang_pred string, score double", compute)

"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learned lexicon (words and word beginnings that mark label 1), how near its words stand to
a second person, capitals, punctuation and obfuscation. Shallow trees are boosted on logistic loss over binned features; their
margins on rows they weren't fitted on give the isotonic map from margin to probability.

Of large tables the model sees a bounded draw of each label. A row then stands for 1 / rate of its label in the trees and in the map, so scores
are probabilities at the shares of all labelled rows. The lexicon needs no weights: its log-odds compare shares within a label, which a
draw by label keeps, and their z goes by the documents that were counted.

The lexicon comes from document counts by label over the labelled sample. When the trees are fitted, a document's own part
in those counts is taken out first, so its features are what an unseen document's would be.

Results: a null text counts as empty; empty texts are scored as any other. Labels that are null aren't used. Rows labelled twice count
twice. With labels of one class only, or none, every score is the share of label 1 (0 without labels). Clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import append_columns, col, hex_unit, materialise, slices, texts

#: Labelled documents of each label that the model is fitted on, as expected by a draw over all of them.
SAMPLE = 2500
#: Terms of the lexicon at most; documents of label 1 that a term needs; z of its log-odds for the two tiers.
TERMS, LEAST, TIERS = 3000, 3, (2.4, 4.0)
#: Trees, their depth, learning rate, bins, least rows of a leaf, penalty on leaf weights, folds for calibration.
TREES, DEPTH, RATE, BINS, LEAF, PENALTY, FOLDS = 60, 3, 0.15, 64, 5, 1.0, 4
#: Lengths of the word beginnings that are terms beside whole words.
BEGINNINGS = (4, 5, 6)
#: Second-person words of the corpus languages, and what stands for letters in obfuscated words.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer sie ihr ti tuyo usted ustedes vosotros su".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…*_-#%$~`^&=+/\\|@"
FEATURES = ("weak", "strong", "log_odds", "hits", "any", "near_second", "second", "capitals", "shouted", "bangs", "questions", "punctuation", "digits", "obfuscated", "log_words")
HIT, STRONG, YOU, HIDDEN = 1, 2, 4, 8


def plain(token: str) -> tuple[str, bool]:
    """A lower-case token without its edges and with letters for their stand-ins; whether it was obfuscated."""
    word = token.strip(EDGES)
    if word.isalpha():
        return word, False
    if not any(c.isalpha() for c in word):
        return word, False
    bare = re.sub(r"[^\w]|_", "", word.translate(LEET))
    return (bare, True) if bare.isalpha() else (word, False)


def terms(word: str) -> list[str]:
    """The word and its beginnings; a beginning ends with a star."""
    if len(word) < 3 or not word.isalpha():
        return []
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


@dataclass
class Lexicon:
    """Document counts of the terms by label, and of all documents by label."""

    positive: dict[str, int]
    negative: dict[str, int]
    totals: tuple[int, int]

    def weigh(self, term: str, own: int | None = None) -> tuple[float, float]:
        """Log-odds and their z; `own` is the label of a document whose part is taken out."""
        p, n = self.positive.get(term, 0) - (own == 1), self.negative.get(term, 0) - (own == 0)
        P, N = self.totals[0] - (own == 1), self.totals[1] - (own == 0)
        if p < LEAST:
            return 0.0, 0.0
        odds = np.log((p + 0.5) / (P - p + 0.5)) - np.log((n + 0.5) / (N - n + 0.5))
        return float(odds), float(odds / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)))


class Codes(dict):
    """What a token is: bits, and its log-odds beside."""

    def __init__(self, lexicon: Lexicon, own: int | None):
        self.lexicon, self.own, self.odds = lexicon, own, {}

    def __missing__(self, token: str) -> int:
        word, hidden = plain(token)
        code = YOU if word in SECOND else 0
        odds, z = max((self.lexicon.weigh(t, self.own) for t in terms(word) if t in self.lexicon.positive), key=lambda x: x[1], default=(0.0, 0.0))
        if z >= TIERS[0]:
            code |= HIT | (STRONG if z >= TIERS[1] else 0)
            self.odds[token] = odds
        if hidden:
            code |= HIDDEN
        if len(self) >= 300_000:
            self.clear()
            self.odds.clear()
            if z >= TIERS[0]:
                self.odds[token] = odds
        self[token] = code
        return code


def features(text: str, codes: Codes) -> list[float]:
    tokens = text.lower().split()
    n = max(1, len(tokens))
    code = np.frombuffer(bytes(map(codes.__getitem__, tokens)), np.uint8)
    hits = np.flatnonzero(code & HIT)
    you = np.flatnonzero(code & YOU)
    odds = sum(codes.odds.get(tokens[i], 0.0) for i in hits.tolist())
    near = 0.0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        apart = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hits), np.abs(you[np.maximum(at - 1, 0)] - hits))
        near = float((1.0 / (1.0 + apart)).sum() / n)
    size = max(1, len(text))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(raw, minlength=128)[:128]
    shouted = sum(1 for t in text.split() if len(t) > 2 and t.isupper())
    marks = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    return [
        len(hits) / n, int((code & STRONG > 0).sum()) / n, odds / n, float(min(len(hits), 20)), float(bool((code & STRONG).any())), near, len(you) / n,
        kinds[65:91].sum() / size, shouted / n, kinds[33] / size, kinds[63] / size, marks / size, kinds[48:58].sum() / size,
        int((code & HIDDEN > 0).sum()) / n, float(np.log1p(len(tokens))),
    ]


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Boosted trees of fixed depth on binned features: histograms of weighted gradients, the best gain at each node."""
    rows, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1)
    weight = weight / weight.mean()  # the penalty on leaf weights goes by the rows that there are
    share = np.clip((weight * y).mean(), 1e-12, 1 - 1e-12)
    base = float(np.log(share / (1 - share)))
    margin = np.full(rows, base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(rows, np.int64)
        splits = []
        for depth in range(DEPTH):
            many = 1 << depth
            feature, cut = np.zeros(many, np.int64), np.full(many, np.inf)
            gain = np.full(many, 1e-6)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                at = node * BINS + bins[:, j]
                g, h, c = (np.bincount(at, w, many * BINS).reshape(many, BINS).cumsum(1) for w in (grad, hess, None))
                G, H, C = g[:, -1:], h[:, -1:], c[:, -1:]
                won = g**2 / (h + PENALTY) + (G - g) ** 2 / (H - h + PENALTY) - G**2 / (H + PENALTY)
                won = np.where((c >= LEAF) & (C - c >= LEAF), won, 0)[:, : len(cuts[j])]
                best = won.argmax(1)
                better = won[np.arange(many), best] > gain
                gain = np.where(better, won[np.arange(many), best], gain)
                feature, cut = np.where(better, j, feature), np.where(better, cuts[j][best], cut)
            splits.append((feature, cut))
            node = 2 * node + (x[np.arange(rows), feature[node]] > cut[node])
        many = 1 << DEPTH
        leaf = -RATE * np.bincount(node, grad, many) / (np.bincount(node, hess, many) + PENALTY)
        trees.append((splits, leaf))
        margin += leaf[node]
    return {"base": base, "trees": trees}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), model["base"]), np.arange(len(x))
    for splits, leaf in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for feature, cut in splits:
            node = 2 * node + (x[rows, feature[node]] > cut[node])
        out += leaf[node]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbours until the weighted shares rise: the middle of each pool and its share, half a row at the share of all added."""
    order = np.argsort(margin, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight
    pools: list[list[float]] = []  # weight, weight of ones, weighted sum of margins, rows
    for m, v, w in zip(margin[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([w, w * v, w * m, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    total, ones, middle, rows = np.array(pools).T
    return middle / total, (rows * ones / total + 0.5 * ones.sum() / total.sum()) / (rows + 0.5)


def sample(docs: DataFrame, labels: DataFrame, learn, key: str, text: str, label: str) -> DataFrame:
    """key, text, label, weight (1 / rate) of the labelled rows to learn from: SAMPLE of each label, drawn by a hash of the key over all of them."""
    rows = labels.where(learn & col(label).isin(0, 1)).select(col(key).alias("key"), col(label).cast("int").alias("label"))
    rates = {r["label"]: min(1.0, SAMPLE / r["n"]) for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    of_label = lambda values: F.coalesce(*(F.when(F.col("label") == k, F.lit(v)) for k, v in values.items()), F.lit(0.0))
    drawn = rows.where(hex_unit(F.col("key"), "toxicity") < of_label(rates)).withColumn("weight", of_label({k: 1 / v for k, v in rates.items()}))
    # About 2 * SAMPLE pairs of key and label, whatever the input.
    return docs.select(col(key).alias("key"), col(text).alias("text")).join(F.broadcast(drawn), "key")


def learn_lexicon(rows: DataFrame, totals: tuple[int, int]) -> Lexicon:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                count: dict[str, list[int]] = {}
                for t, label in zip(texts(part), part.column("label").to_pylist(), strict=True):
                    for term in {term for token in set(t.lower().split()) for term in terms(plain(token)[0])}:
                        count.setdefault(term, [0, 0])[1 - label] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(count.keys(), pa.string()), pa.array([c[0] for c in count.values()], pa.int64()), pa.array([c[1] for c in count.values()], pa.int64())],
                    names=["term", "p", "n"],
                )

    counted = rows.mapInArrow(run, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n, (P, N) = F.col("p"), F.col("n"), totals
    odds = F.log((p + 0.5) / (P - p + 0.5)) - F.log((n + 0.5) / (N - n + 0.5))
    z = odds / F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    best = counted.where(p >= LEAST).withColumn("z", z).where(F.col("z") >= TIERS[0]).orderBy(F.desc("z"), "term").limit(TERMS).collect()
    return Lexicon({r["term"]: r["p"] for r in best}, {r["term"]: r["n"] for r in best}, totals)


def fit(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """A model from the labelled documents whose `learn` (a condition on the labels' key) holds."""
    rows = materialise(sample(docs, labels, learn, key, text, label), "toxicity-sample")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    P, N = counts.get(1, 0), counts.get(0, 0)
    if not P or not N:
        return {"constant": P / (P + N) if P + N else 0.0}
    lexicon = learn_lexicon(rows, (P, N))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [Codes(lexicon, 0), Codes(lexicon, 1)]
        for batch in batches:
            for part in slices(batch):
                own = part.column("label").to_pylist()
                found = [features(t, codes[y]) for t, y in zip(texts(part), own, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.column("key").cast(pa.string())), pa.array(own, pa.int32()), part.column("weight"), pa.array(found, pa.list_(pa.float64()))],
                    names=["key", "label", "weight", "x"],
                )

    found = rows.mapInArrow(run, "key string, label int, weight double, x array<double>").toPandas().sort_values(["key", "label"], kind="stable")
    x, y, weight = np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES)), found["label"].to_numpy(float), found["weight"].to_numpy(float)
    folds = pd.util.hash_array(found["key"].fillna("").to_numpy(object)) % FOLDS
    out = np.zeros(len(y))
    for k in range(FOLDS):
        rest = folds != k
        if rest.all() or not 0 < y[rest].mean() < 1:
            rest = np.ones(len(y), bool)
        out[folds == k] = margins(fit_trees(x[rest], y[rest], weight[rest]), x[folds == k])
    return {"lexicon": lexicon, "trees": fit_trees(x, y, weight), "map": isotonic(out, y, weight)}


def score(df: DataFrame, model: dict, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """`df` with score (0 to 1, higher: label 1 likelier) and predicted (1 from `threshold` on)."""
    known: list[Codes] = []

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        if "constant" in model:
            p = np.full(part.num_rows, model["constant"])
        else:
            if not known:
                known.append(Codes(model["lexicon"], None))
            x = np.array([features(t, known[0]) for t in texts(part, text)], float)
            p = np.clip(np.interp(margins(model["trees"], x), *model["map"]), 0, 1)
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return append_columns(df, "score double, predicted int", compute)

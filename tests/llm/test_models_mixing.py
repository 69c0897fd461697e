"""Held-out accuracy, mixing against brute force, the queries with SQL, and the pipeline's stages."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import langid, minhash, mixing, queries, toxicity
from tests.test_queries import plain

SF = "/root/testdata/sf0.01"


def test_language(spark):
    found = queries.queries()["op4_rank_order_language"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in found if r.held_out]
    assert len(found) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_of_odd_texts(spark):
    train = [(i, "the cat and the dog " * 3, "en") for i in range(9)] + [(9 + i, "die Katze und der Hund ", "de") for i in range(9)] + [(30, None, "en"), (31, "was", None)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    profiles = langid.fit(df, F.lit(True))
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !!", "q"), (4, "the dog", "q"), (5, "und die " * 30_000, None), (6, "Привет", "q")], "doc_id long, text string, lang_pred string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, profiles).collect()}
    assert [found[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert found[4][0] == "en" and found[5][0] == "de" and found[6][1] == 0.0
    assert langid.fit(df.limit(0), F.lit(True)) == {}
    assert langid.predict(odd, {}).where("lang_pred <> 'und'").count() == 0


def test_places_and_distance():
    profiles = langid.Profiles({"a": [10, 20, 30], "b": [30, 20, 10]})
    assert profiles.ranks[:, :3].tolist() == [[0, 1, 2], [2, 1, 0]]
    keys, counts = langid.ngrams("ab ab")
    point = lambda s: sum((ord(c) + 1 if c != "_" else 1) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {point(k): v for k, v in {"a": 2, "b": 2, "_a": 2, "ab": 2, "b_": 2, "_ab": 2, "ab_": 2, "b_a": 1}.items()}


def toxic_rows():
    random.seed(4)
    clean, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["grumble", "snarl", "spit", "scoff"]
    docs, labels = [], []
    for i in range(1200):
        words, toxic = random.choices(clean, k=random.randint(20, 80)), i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(bad).replace("s", random.choice("s$")) + random.choice(["", "!", "xy"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_rows()
    frame = spark.createDataFrame([*docs, (5000, None), (5001, ""), (5002, "grumble " * 50_000)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, marks, F.col("doc_id") % 3 != 1)
    found = {r.doc_id: r for r in toxicity.score(frame.withColumn("Score", F.lit("x")), model).collect()}
    held = [(found[i].predicted, y) for i, y in labels if i % 3 == 1]
    assert len(found) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 0.02 * len(held)
    none = toxicity.fit(frame, marks.where("toxic = 9"), F.lit(True))
    assert {r.score for r in toxicity.score(frame, none).collect()} == {0.0}


def test_toxicity_at_the_shares_of_all_labels(spark, monkeypatch):
    """A draw by label doesn't move the scores: a fifth of the rows is toxic, and the mark alone doesn't tell which."""
    rng = random.Random(6)
    filler = [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(3000):
        toxic = i % 5 == 0
        words = rng.choices(filler, k=40)
        if rng.random() < (0.9 if toxic else 0.4):
            words.insert(rng.randrange(40), "!!!")
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    means = []
    for size in (2500, 200):
        monkeypatch.setattr(toxicity, "SAMPLE", size)
        model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
        scored = toxicity.score(docs, model).groupBy(F.col("text").contains("!").alias("with")).agg(F.avg("score").alias("score"), F.avg("toxic").alias("share"))
        found = {r["with"]: (r.score, r.share) for r in scored.collect()}
        assert all(abs(score - share) < 0.08 for score, share in found.values()), (size, found)
        means.append(found)
    assert all(abs(means[0][k][0] - means[1][k][0]) < 0.08 for k in means[0])


def test_toxicity_of_the_tables(spark):
    found = queries.queries()["op8_boosted_toxicity"](spark, "/root/testdata/sf0.1")
    held = found.where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted for r in held if r.toxic) >= 0.85 * sum(r.toxic for r in held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.01 * len(held)


def test_isotonic():
    import numpy as np

    at, share = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all()


def mix_brute(rows):
    """doc -> (size, source_size, target, taken), by sorting."""
    size = lambda t: len((t or "").encode().split())
    place = lambda k: int(hashlib.md5(f"mix:{'' if k is None else k}".encode()).hexdigest()[:13], 16) >> 2
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    out = []
    for k, t, s in rows:
        n, total, goal = size(t), sizes[s], target[s]
        whole = min(2, math.floor(goal / total)) if total else 2
        rest = goal - whole * total if whole < 2 else 0.0
        below = sum(size(u) for j, u, z in rows if z == s and place(j) < place(k))
        here = sum(size(u) for j, u, z in rows if z == s and place(j) == place(k))
        extra = rest > 0 and 2 * (rest - below) > here
        out.append((k, n, total, goal, n * (whole + extra)))
    return out


def test_mixing(spark):
    random.seed(8)
    rows = [(i, " ".join(["w"] * random.randint(0, 30)), random.choice(["a", "a", "a", "b", "é", "zz", None])) for i in range(250)]
    rows += [(900, None, "only null"), (901, "w " * 20_000, "b"), (None, "x\x1cy z", "a"), (5, "again", "a"), (5, "again", "a")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, source string, target string")
    found = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df).collect()]
    order = lambda x: tuple((v is None, v) for v in x)
    for a, b in zip(sorted(found, key=order), sorted(mix_brute(rows), key=order), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4]
    assert mixing.mixed(df).count() == sum(r.times for r in mixing.mix(df).collect())
    assert mixing.mixed(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found, expected = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert plain(found.collect(), found.columns) == plain(expected.fetchall(), expected.columns)


def test_pipeline(spark):
    """Each stage on its own input, against plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = [tuple(r) for r in docs.collect()]
    more = [(9001, base[0][1].upper(), "en", "src1", 1), (9002, "12 34 !!", None, None, 1), (9003, None, "fr", "src2", 0), (9004, "Текст без профиля", None, "src2", 0)]
    more += [(9005, base[3][1] + " plus", "en", "src0", 1), (9006, base[3][1] + " plus", "en", "src0", 1), base[7]]
    docs = spark.createDataFrame([*base, *more], docs.schema).withColumn("node", F.lit("extra")).withColumn("kept", F.lit(1))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and docs.columns[-2:] == ["node", "kept"]
    known = corpus_pipeline.language_id(spark, docs, SF)
    left = sorted(r.doc_id for r in known.collect())
    assert left == sorted([r[0] for r in base] + [9001, 9005, 9006, base[7][0]])
    single = corpus_pipeline.exact_copies(spark, known, SF)
    best = {}
    for r in known.collect():
        text = "".join(c.lower() if c.isascii() else c for c in r.text)
        best[text] = max(best.get(text, -1), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(best.values())
    far = corpus_pipeline.near_copies(spark, single, SF)
    kept = {r.doc_id for r in minhash.groups(single, percent=80).where("kept").collect()}
    assert sorted(r.doc_id for r in far.collect()) == sorted(kept) and 9006 not in kept
    mixed = corpus_pipeline.mix(spark, far, SF)
    taken = {r.doc_id: r.times for r in mixing.mix(far).collect()}
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(k for k, n in taken.items() for _ in range(n))
    encoded = corpus_pipeline.encode(spark, mixed, SF)
    assert encoded.count() == mixed.count()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in encoded.collect())
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0

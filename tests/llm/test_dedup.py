"""Exact and near copies, and conversations, against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from quern.llm import chat, exact_dedup, minhash

WORDS = [a + b for a in "ba ko ti ru me so".split() for b in "lan nor vis tek dum gar".split()]


@pytest.mark.parametrize("budget", [10**9, 20_000, 1_000, 1])
def test_tries_at_any_budget(budget):
    random.seed(budget % 97)
    tries, expected = exact_dedup.Tries(max, budget), {}
    for i in range(1500):
        body = b"p" * random.choice([0, 5, 50]) + bytes(random.choices(b"ab", k=random.randint(0, 8))) + random.choice([b"", b"x" * 300, b"y" * 300])
        tries.insert(body, i, 1)
        owner, n = expected.get(body, (0, 0))
        expected[body] = (max(owner, i), n + 1)
    found = list(tries.finish())
    assert len(found) == len(expected) and {b: (o, n) for b, o, n in found} == expected


@pytest.mark.parametrize("part", [0, 3000, 4090])
def test_texts_of_one_length_spill(part):
    """What is held stays within the budget, however many texts share their length and `part` bytes in front."""
    budget, most = 1 << 20, 0
    tries, random_bytes = exact_dedup.Tries(max, budget), random.Random(part).randbytes
    bodies = [b"p" * part + random_bytes(4096 - part) for _ in range(4000)]
    for i, body in enumerate(bodies):
        tries.insert(body, i, 1)
        most = max(most, tries.bytes)
    assert most <= budget + 5000
    assert {b: o for b, o, _ in tries.finish()} == {b: i for i, b in enumerate(bodies)}


def test_common_texts_find_their_owner(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 4)
    rows = [(i, "everywhere" if i % 3 == 0 else "often" if i % 3 == 1 else f"text {i // 6}") for i in range(300)] + [(None, "everywhere")]
    found = exact_dedup.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    classes = {}
    for i, t in rows:
        classes.setdefault(t, []).append(i)
    expected = [(i, t, max(x for x in classes[t] if x is not None), len(classes[t])) for i, t in rows]
    assert sorted([(r.doc_id, r.text, r.keep_id, r.group_size) for r in found], key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("budget", [48 << 20, 2000])
def test_representatives(spark, monkeypatch, budget):
    """One whole row a text: of the largest id, and of its rows the least."""
    monkeypatch.setattr(exact_dedup, "BUDGET", budget)
    rows = [(1, "Same", "b"), (2, "sAME", "b"), (2, "Same", None), (2, "Same", "a"), (None, "same", "a"), (3, None, "x"), (4, "", "x"), (None, "alone", None), (5, "Ä", "x"), (6, "ä", "x"), (7, "q" * 9000, "x")]
    rows += [(i, f"text {i % 40} of many", "x") for i in range(100, 300)]
    found = exact_dedup.representatives(spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)).collect()
    expected = {("Same", 2, "a"), ("", 4, "x"), ("alone", None, None), ("Ä", 5, "x"), ("ä", 6, "x"), ("q" * 9000, 7, "x"), *((f"text {i % 40} of many", i, "x") for i in range(260, 300))}
    assert len(found) == len(expected) and {(r.text, r.doc_id, r.kept) for r in found} == expected
    none = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert exact_dedup.representatives(none).count() == 0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(spark, keep):
    texts = [(1, "Same"), (2, "sAME"), (3, "same "), (4, None), (5, ""), (6, "ÄÖ"), (7, "äÖ"), (8, "x" * 100_000), (9, "X" * 100_000), (3, "same "), (None, "same")]
    df = spark.createDataFrame([(*t, "c") for t in texts], "doc_id long, text string, keep_id string")
    found = exact_dedup.mark(df, keep=keep).collect()
    assert len(found) == len(texts)
    pick = max if keep == "largest" else min
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    classes = {}
    for i, t in texts:
        classes.setdefault(lower(t), []).append(i)
    for r in found:
        same = classes[lower(r.text)]
        owner = pick(i for i in same if i is not None)
        assert (r.keep_id, r.group_size, r.kept) == (owner, len(same), r.doc_id == owner)
    assert exact_dedup.mark(df.limit(0)).count() == 0


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, percent):
    """Component by place in `rows`: the least key reachable over links."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            up[root(j)] = root(i)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((k for k in members[root(i)] if k is not None), default=None)) for i in range(len(rows))]


def near_rows():
    """Chains of edits, groups of copies, passages that many share, short and empty texts."""
    random.seed(5)
    text = lambda n: [random.choice(WORDS) for _ in range(n)]
    rows, key = [], iter(random.sample(range(10_000), 2_000))
    passage = text(60)
    for size in (30, 60, 200, 500):
        words = text(size)
        for step in range(12):  # each one word further from the first
            rows.append((next(key), " ".join(words)))
            words = list(words)
            words[random.randrange(size)] = f"edit{step}x{size}"
    for _ in range(60):
        rows.append((next(key), " ".join(passage + text(random.randint(5, 60)))))
    hot = text(150)
    for i in range(80):
        words = list(hot)
        for _ in range(random.randint(0, 3)):
            words[random.randrange(150)] = f"n{i}"
        rows.append((next(key), " ".join(words).upper() if i % 5 == 0 else "  ".join(words)))
    rows += [(next(key), " ".join(text(40))) for _ in range(60)]
    rows += [(next(key), t) for t in ("", None, " \t\n", "a b", "A  b", "a b c", "one", "one", "a b c d e", "a b c d e f")]
    rows += [(None, "a b"), (rows[0][0], "one more text under a key that is there"), rows[1]]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("block", [1000, 7])
def test_near(spark, monkeypatch, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SIDE", 1000 if block == 1000 else 11)
    monkeypatch.setattr(minhash, "MOST", 2_000_000 if block == 1000 else 400)
    rows = near_rows()
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, node string")
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.groups(df, percent=percent).collect()]
    expected = [(k, n, c, k == c) for k, n, c in brute(rows, percent)]
    # A row without words is its own.
    expected = [(k, n, k if n == 0 else c, k == (k if n == 0 else c)) for k, n, c, _ in expected]
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(found, key=order) == sorted(expected, key=order)


def test_near_representatives(spark):
    """One row of each component stays, whole; one id under two texts is two rows, each judged by its text."""
    random.seed(2)
    text = lambda n: [random.choice(WORDS) for _ in range(n)]
    one, other = text(120), text(120)
    bent = lambda words, i: " ".join([*words[:60], f"odd{i}", *words[61:]])
    rows = [(1, " ".join(one), "a"), (2, bent(one, 2), "b"), (3, " ".join(other), "c"), (2, bent(other, 3), "d"), (7, "alone with these few words", "e"), (None, bent(one, 9), "f")]
    rows += [(8, "", "g"), (8, None, "h"), (None, "keyless text of its own here", "i"), (9, "twice the same text it is", "j"), (9, "twice the same text it is", "j")]
    found = minhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()
    assert sorted(r.row for r in found) == ["a", "d", "e", "g", "h", "i", "j"]
    assert {(r.doc_id, r.text, r.row) for r in found} <= set(rows)


def test_many_rows_of_one_key(spark):
    """Texts under one key, null as well, are linked like any others."""
    rows = near_rows()
    for key in (None, 5):
        df = spark.createDataFrame([(key, t) for _, t in rows], "doc_id long, text string")
        found = minhash.groups(df)
        sizes = sorted(r.n_shingles for r in found.collect())
        assert sizes == sorted(len(shingles(t)) for _, t in rows)
        stay = len({c if n else (k, c) for k, n, c in brute([(i, t) for i, (_, t) in enumerate(rows)], 80)})
        empty = sum(not shingles(t) for _, t in rows)
        assert minhash.representatives(df).count() == len({c for _, n, c in brute([(i, t) for i, (_, t) in enumerate(rows)], 80) if n}) + empty <= stay + empty


def test_near_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.groups(df).count() == 0
    alone = spark.createDataFrame([(1, "just one text that is all there is")], "doc_id long, text string")
    assert minhash.groups(alone).first().kept


def test_pigeonhole():
    """Any two signatures within the distance share a bucket."""
    import numpy as np

    p = minhash.plan(85)
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 16, p.positions, dtype=np.uint16)
    for _ in range(200):
        other = one.copy()
        other[rng.choice(p.chunks * minhash.CHUNK, 2 * p.chunks - 1, replace=False)] ^= 1
        keys = minhash.bucket_keys(np.stack([one, other]), p.chunks)
        assert (keys[0] == keys[1]).any()


@pytest.mark.parametrize("percent", [80, 85])
def test_pigeonhole_over_the_whole_signature(percent):
    """Any two signatures within the distance that pairs are confirmed up to share a bucket, wherever they differ."""
    import numpy as np

    p = minhash.plan(percent)
    rng = np.random.default_rng(7)
    one = rng.integers(0, 1 << 16, p.positions, dtype=np.uint16)
    twos = np.arange(p.positions).reshape(-1, minhash.CHUNK)[:, :2].ravel()[: p.far]  # two errors a chunk as far as they go
    for wrong in [twos, *(rng.choice(p.positions, p.far, replace=False) for _ in range(200))]:
        other = one.copy()
        other[wrong] ^= 1
        keys = minhash.bucket_keys(np.stack([one, other]), p.chunks)
        assert (keys[0] == keys[1]).any()


def test_chat(spark):
    base = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more")]
    rows = [
        *base, (2, 0, "user", "hi"), (2, 1, "assistant", "yes"),  # a snapshot of 1
        (3, 0, "user", "hi"), (3, 1, "assistant", "no"),  # parts ways
        *((4, *r[1:]) for r in base),  # a copy of 1
        (5, 0, "user", None), (6, 0, None, ""), (7, 0, "user", ""), (7, 1, "user", "x" * 50_000), (None, 0, "user", "alone"), (8, 0, "user", "hi"), (8, 0, "user", "hi"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, h1 string")
    found = {r.conv_id: (r.n_turns, r.n_copies, r.chat) for r in chat.render(df).collect()}
    assert {k: v[:2] for k, v in found.items()} == {1: (3, 2), 3: (2, 1), 6: (1, 1), 7: (2, 1), None: (1, 1), 8: (2, 1)}
    assert found[1][2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert found[6][2].startswith("<|im_start|>unknown\n")
    assert chat.render(df.limit(0)).count() == 0


def test_snapshots_are_counted(spark):
    turns = lambda conv, *texts: [(conv, i, "user", t) for i, t in enumerate(texts)]
    rows = [*turns(1, "a", "b", "c"), *turns(2, "a"), *turns(3, "a"), *turns(4, "a", "b"), *turns(5, "a", "b", "c"), *turns(6, "a", "x"), *turns(None, "z", "y"), *turns(8, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv: (r.n_turns, r.n_copies, r.n_snapshots) for r in chat.maximal(df).collect()}
    assert found == {1: (3, 2, 3), 6: (2, 1, 2), None: (2, 1, 1)}


def test_turns_at_one_place_are_ordered_by_text(spark):
    """A conversation of the first of two tied turns is a snapshot, one of the second is not."""
    random.seed(11)
    rows, kept = [], set()
    for i in range(0, 80, 4):
        a, b = sorted(random.sample(range(10_000), 2), key=str)
        rows += [(i, 0, "user", f"{a}"), (i + 1, 0, "user", f"{b}"), (i + 1, 0, "user", f"{a}"), (i + 2, 0, "user", f"{b}")]
        kept |= {i + 1, i + 2}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv for r in chat.maximal(df).collect()} == kept

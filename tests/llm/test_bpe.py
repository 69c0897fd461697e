"""Against the library, and round trips."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.load(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ours):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_every_token_encodes_to_itself(ours):
    """What the proof of stable windows rests on."""
    assert all(ours.leaf(t) == [r] and ours._heap(t) == [r] for t, r in ours.ranks.items())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(ours, library, text):
    assert ids(ours.encode(text)) == library.encode_ordinary(text)
    assert ours.decode(np.array(library.encode_ordinary(text), "<u4")) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abinget on'sé-", min_size=40, max_size=900))
def test_long_matches(ours, library, text):
    assert ids(ours.encode(text)) == library.encode_ordinary(text)


@pytest.mark.parametrize("part", ["a", "ab", "-", "é", "in", "tion", "=-", "\x00"])
@pytest.mark.parametrize("n", [31, 32, 33, 257, 4000])
def test_repeats(ours, library, part, n):
    assert ids(ours.encode(part * n)) == library.encode_ordinary(part * n)


def test_memory_is_bounded(ours, monkeypatch):
    monkeypatch.setattr(bpe, "MATCHES", 50)
    monkeypatch.setattr(bpe, "PARTS", 20)
    random.seed(1)
    for _ in range(300):
        ours.encode("".join(random.choices("abcdefgh", k=12)))
    assert len(ours.cache) <= 50 or len(ours.parts) <= 21


def test_frames(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (1, "Hello world", "x"), (4, "Wort " * 20_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    found = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in found] == ["Hello world", "Hello world", "", "", "Wort " * 20_000]
    assert found[0].ids == found[1].ids and found[2].ids == b""
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    both = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded="decoded").where("doc_id = 1").first()
    assert bytes(both.decoded) == b"Hello world"

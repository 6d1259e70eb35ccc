import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnkit.llm import packing, token_counts
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    found, counts = packing.encoder(PATH).encode([t.encode() for t in texts])
    return [own.tolist() for own in np.split(found, np.cumsum(counts))[:len(texts)]]


@pytest.mark.parametrize("clashing", [False, True])
def test_counts_as_the_library(spark, clashing):
    want = sorted([(d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for d, t, *_ in cases.documents()], key=str)
    assert cases.rows(token_counts.token_counts(cases.frame(spark, clashing=clashing), PATH)) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text_counts_and_encodes_as_the_library(texts):
    want = [ids(t) for t in texts]
    assert token_counts.merges(PATH).tokens(texts) == [len(x) for x in want] if texts else True
    assert encoded(texts) == want


def test_every_letter_splits_as_in_the_library():
    letters = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b1{c}2 {c} ." for c in letters[i:i + 512]) for i in range(0, len(letters), 512)]
    assert token_counts.merges(PATH).tokens(texts) == [len(ids(t)) for t in texts]
    assert encoded(texts) == [ids(t) for t in texts]


def test_empty_tables(spark):
    assert token_counts.token_counts(cases.empty(spark), PATH).collect() == []
    assert packing.pack_documents(cases.empty(spark), PATH).collect() == []


def pieces(text, capacity=1024):
    own = [*ids(text), 2]
    first = len(own) % capacity or capacity
    at, n = 0, 0
    while at < len(own):
        size = first if at == 0 else capacity
        yield n, at, size, zlib.crc32(np.array(own[at:at + size], "<u4").tobytes())
        at, n = at + size, n + 1


def check_places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("how", [{}, {"items": 7, "fan_in": 2}, {"items": 7, "fan_in": 3, "carry": 2}])
def test_every_piece_has_one_gapless_place(spark, how):
    rows = packing.pack_documents(cases.frame(spark, clashing=True), PATH, **how).collect()
    want = sorted([(d, *p) for d, t, *_ in cases.documents() for p in pieces(t)], key=str)
    assert sorted([tuple(r)[:5] for r in rows], key=str) == want
    check_places(rows, 1024)


@pytest.mark.parametrize(("items", "waste"), [(50_000, 0.008), (200, 0.05)])
def test_few_sequences(spark, items, waste):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 3000).tolist()
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(4)
    rows = packing.pack(df, items=items).collect()
    assert len(rows) == len(lengths)
    assert check_places(rows, 1024) <= (1 + waste) * sum(lengths) / 1024 + 1


def test_items_that_never_pair(spark):
    df = spark.createDataFrame([(i, 600) for i in range(500)], "doc_id long, length long")
    assert check_places(packing.pack(df, items=20, carry=5, fan_in=4).collect(), 1024) == 500


def test_best_fit_takes_the_tightest_bin():
    where, offset, fill = packing.best_fit(np.array([700, 900, 100, 300]), 1024)
    assert where.tolist() == [1, 0, 0, 1] and fill.tolist() == [1000, 1000]
    assert offset.tolist() == [0, 0, 900, 700]

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from churnkit.llm import common as C
from churnkit.llm import encoding, token_files
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = encoding.Encoder(PATH)


def by_library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def ours(texts, coder=CODER):
    ids, counts = coder.encode([t.encode() for t in texts])
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z'''srtdmvel 12 \n\n\t  .,!?éß\xa0\x85\x1c½²ñж")), min_size=1, max_size=5))
def test_ids_of_the_library(texts):
    assert ours(texts) == by_library(texts)


def test_awkward_texts_have_the_library_s_ids():
    texts = [t or "" for _, t, *_ in cases.documents()] + ["", "日本 's", "<|endoftext|>", "a <|endoftext|>'s <|endoftext|", "'", "' s"]
    assert ours(texts) == by_library(texts)
    assert ours(["", ""]) == [[], []]


def test_small_tables_forget_and_stay_right():
    coder = encoding.Encoder(PATH, keep=4000)
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(60)) for _ in range(3)]
        assert ours(texts, coder) == by_library(texts)
        assert coder.young_cost <= 2000 + 300 and len(coder.old) < 40


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 32), st.floats(0.0, 1.0), st.integers(0, 2**32 - 1), st.integers(0, 5000))
def test_blocks_round_trip(bits, percentile, seed, n):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.random(n) < 0.02] = 2**32 - 1
    sink = io.BytesIO()
    writer = token_files.Writer(sink, percentile)
    cut = n // 3
    writer.add(pa.array([7], pa.int64()), ids[:cut], np.array([cut]))
    writer.add(pa.array([None, 9], pa.int64()), ids[cut:], np.array([0, n - cut]))
    assert writer.close() == len(sink.getvalue())
    reader = token_files.Reader(pa.BufferReader(sink.getvalue()))
    assert reader.ids(0, n).tolist() == ids.tolist()
    a, b = sorted((int(seed % (n + 1)), n // 2))
    assert reader.ids(a, b).tolist() == ids[a:b].tolist()
    assert reader.documents["n_tokens"].tolist() == [cut, 0, n - cut]


def test_outliers_do_not_widen_a_block():
    ids = np.arange(token_files.BLOCK, dtype=np.uint32) % 16
    ids[5] = 50_000
    stored, head = token_files.encode_blocks(ids, 0.98)
    assert head["width"].tolist() == [4] and head["extra"].tolist() == [1] and len(stored[0]) == 512 + 6


def expected(rows):
    """start, count and checksum of each document in the file's order (ids unique where texts differ in length)."""
    texts = sorted({t or "" for _, t, *_ in rows})
    ids = {t: np.array([*i, 0], "<u4") for t, i in zip(texts, by_library(texts), strict=True)}
    return [(d, len(ids[t or ""]), zlib.crc32(ids[t or ""].tobytes())) for d, t, *_ in rows]


@pytest.mark.parametrize("file_bytes", [20_000, 32 << 20])
def test_files_hold_every_document_in_order(spark, file_bytes):
    rows = cases.documents()
    listing = token_files.write(cases.frame(spark, clashing=True), PATH, C.fresh_path(spark, "ids"), file_bytes=file_bytes)
    assert (listing.count() > 2) == (file_bytes == 20_000)
    got = token_files.read(listing).collect()
    assert sorted([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], key=str) == sorted(expected(rows), key=str)
    got.sort(key=lambda r: (r["start"], r["n_tokens"]))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in got]
    assert known == sorted(known, key=lambda d: (d is not None, d or 0))


def test_empty_table(spark):
    assert token_files.round_trip(cases.empty(spark), PATH, C.fresh_path(spark, "ids")).collect() == []


def test_a_shared_id_is_cut_into_files(spark):
    rows = [(5, f"text number {i} " * 20, "en", "s", 1) for i in range(400)]
    listing = token_files.write(cases.frame(spark, rows), PATH, C.fresh_path(spark, "ids"), file_bytes=20_000)
    assert max(r["n_docs"] for r in listing.collect()) < 200


def test_damaged_files_are_refused(spark):
    listing = token_files.write(cases.frame(spark), PATH, C.fresh_path(spark, "ids")).collect()
    store, at = pafs.FileSystem.from_uri(listing[0]["path"])
    with store.open_input_file(at) as source:
        data = source.read()
    for broken in (b"", data[:-1], data[:20] + data[-24:], b"x" + data[1:]):
        with pytest.raises(token_files.DamagedFile):
            token_files.Reader(pa.BufferReader(broken))

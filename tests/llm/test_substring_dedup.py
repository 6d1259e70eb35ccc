import random

import pytest

from churnkit.llm import substring_dedup
from tests.llm import cases


def plain(docs, length=50):
    """Every string of every document in a dictionary."""
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for doc_id, text, *_ in order:
        b = (text or "").encode()
        rank = float("inf") if doc_id is None else doc_id
        for i in range(len(b) - length + 1):
            first.setdefault(b[i:i + length], rank)
    for doc_id, text, *_ in order:
        b = (text or "").encode()
        rank = float("inf") if doc_id is None else doc_id
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < rank:
                cover[i:i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((doc_id, len(b), sum(cover), runs, kept))
    return sorted(out, key=str)



def simple(df):
    return sorted([(r["doc_id"], r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]))
                   for r in df.collect()], key=str)


@pytest.mark.parametrize("clashing", [False, True])
def test_same_as_a_dictionary_of_all_strings(spark, clashing):
    assert simple(substring_dedup.dedup_substrings(cases.frame(spark, clashing=clashing))) == plain(cases.documents())


def test_borders_of_repeats(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    shared = [word(n) for n in (49, 50, 51, 75, 120)]
    docs = [(i, word(rng.randint(0, 40)).join(rng.sample(shared, rng.randint(1, 5))), None, None, None) for i in range(40)]
    docs += [(100 + i, rng.choice(shared)[rng.randint(0, 3):] + word(rng.randint(0, 9)), None, None, None) for i in range(30)]
    docs += [(200 + i, "ab" * rng.randint(20, 60), None, None, None) for i in range(5)]
    rng.shuffle(docs)
    assert simple(substring_dedup.dedup_substrings(cases.frame(spark, docs))) == plain(docs)


def test_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1 << 12)
    assert simple(substring_dedup.dedup_substrings(cases.frame(spark))) == plain(cases.documents())


def test_swapped_pieces_are_not_equal(spark):
    a = "abcdefg one " * 2 + "abcdefg two " + "abcdefg six " + "end of it all"
    b = "abcdefg two " + "abcdefg one " * 2 + "abcdefg six " + "end of it all"
    docs = [(1, a, None, None, None), (2, b, None, None, None)]
    assert simple(substring_dedup.dedup_substrings(cases.frame(spark, docs))) == plain(docs)


def test_empty_table_and_short_length(spark):
    assert substring_dedup.dedup_substrings(cases.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.dedup_substrings(cases.empty(spark), length=20)

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from churnkit.llm import components, simhash
from tests.llm import cases


def plain(docs):
    """Fingerprints bit by bit, links by comparing all pairs."""
    prints = []
    for doc_id, text, *_ in docs:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(prints, group, strict=True):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    return sorted([(d, format(f, "016x"), least.get(g)) for (d, f), g in zip(prints, group, strict=True)], key=str)


@pytest.mark.parametrize("clashing", [False, True])
def test_same_as_all_pairs(spark, clashing):
    assert cases.rows(simhash.near_duplicates(cases.frame(spark, clashing=clashing))) == plain(cases.documents())


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.empty(spark)).collect() == []
    assert simhash.keep_first(cases.empty(spark)).collect() == []


def test_known_hash_is_the_one_spark_uses(spark):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("n", [5, 60, 300])
def test_links_connect_what_pairs_connect(spark, n):
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(3)]
    found = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(n)}
    found |= {b ^ (1 << 63) for b in base}
    values = sorted(x % (1 << 64) for x in found)
    group = {v: v for v in values}

    def top(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                group[top(a)] = top(b)
    classes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in components.components(simhash.link(classes)).collect()}
    for i, a in enumerate(values):
        for b in values[:i]:
            assert (top(a) == top(b)) == (roots.get(a, a) == roots.get(b, b))


def test_long_chain(spark):
    n = 70
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(links).collect()} == {(i, 0) for i in range(n + 1)}


def test_keep_first_keeps_one_of_each_group(spark):
    docs = cases.frame(spark)
    kept = [r for r in simhash.keep_first(docs).collect() if r["doc_id"] is not None]
    want = {c for d, _, c in plain(cases.documents()) if d is not None}
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
    assert set(simhash.keep_first(docs).columns) == set(docs.columns)


def test_keep_first_decides_per_row(spark):
    """A text whose doc_id also names a duplicate is not lost, and the duplicate goes."""
    a, b = "only copy of this text here", "another text that is found twice"
    docs = cases.frame(spark, [(1, b, None, None, None), (5, a, None, None, None), (5, b, None, None, None)])
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_first(docs).collect()) == [(1, b), (5, a)]


def test_keep_first_repeats_names_and_empty(spark):
    text = "one row of many that agree in everything but a column"
    rows = [(7, text, lang, None, None) for lang in ("de", "en", "de", None)] + [(None, text, "x", None, None)]
    docs = cases.frame(spark, rows, clashing=True).withColumnRenamed("source", "a.dot").withColumn("text_hash", F.lit(1))
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in got.collect()) == [(0, "x"), (7, "de")]
    assert simhash.keep_first(cases.empty(spark)).collect() == []

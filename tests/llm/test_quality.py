import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.llm import quality
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            cover.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover),
            n < 20 or 100 * len(cover) > 30 * n)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("clashing", [False, True])
def test_base_rules(spark, clashing):
    got = quality.judge(cases.frame(spark, clashing=clashing), labels(spark)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = sorted([(d, *plain(t), not plain(t)[-1]) for d, t, *_ in cases.documents()], key=str)
    assert cases.rows(got) == want


def test_repeated_windows_at_the_border():
    w = [f"w{i}".encode() for i in range(30)]
    assert quality.repeated_words(w) == 0
    assert quality.repeated_words(w[:8] + w[:8]) == 16
    assert quality.repeated_words(w[:8] + [b"x"] + w[:7] + [b"y"]) == 0
    assert quality.repeated_words([b"a"] * 9) == 9
    assert quality.repeated_words([b"a"] * 8) == 0


def corpus(n=900):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(25, 120))]
        bad = i % 9 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + rng.choice("#*$%") * 3 for w in words]
        out.append((i, " ".join(words), None, None, None, int(not bad)))
    return out


def test_forest_finds_junk_it_was_not_shown(spark):
    rows = corpus()
    seen = labels(spark, [(r[0], r[5], 0) for r in rows if r[0] % 2] + [(1, None, None), (None, 1, 0)])
    got = {r["doc_id"]: r["kept"] for r in quality.judge(cases.frame(spark, [r[:5] for r in rows]), seen).collect()}
    fresh = [r for r in rows if r[0] % 2 == 0]
    good, bad = [got[r[0]] for r in fresh if r[5]], [got[r[0]] for r in fresh if not r[5]]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_labels_of_one_kind_and_empty_tables(spark):
    docs = cases.frame(spark, [r[:5] for r in corpus(100)])
    for rows in ([(i, 1, 0) for i in range(100)], [(i, 0, 0) for i in range(100)]):
        assert quality.judge(docs, labels(spark, rows)).where(F.col("kept").isNull()).count() == 0
    assert quality.judge(cases.empty(spark), labels(spark)).collect() == []


def test_isolation_prefers_the_odd_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    forest = quality.Forest.grow(x, trees=60, sample=128, seed=1)
    scores = forest.score(np.array([[0, 0, 0], [6, 6, 6], [0, 8, 0]]))
    assert scores[1] > scores[0] + 0.1 and scores[2] > scores[0] + 0.05

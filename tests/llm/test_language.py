import math
import random

import pytest

from churnkit.llm import language
from tests.llm import cases

SYLLABLES = {"aa": "ba be bi lo la li no".split(), "bb": "schu zen kal tor mif nup".split(), "cc": "él ñó qué ça ûr îm".split()}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def corpus(seed, n=300, words=12):
    rng = random.Random(seed)
    return [(i, text(rng, lang, rng.randint(1, words)), lang, None, None) for i, lang in
            enumerate(rng.choice(list(SYLLABLES)) for _ in range(n))]


def plain(learned, texts):
    """Code lengths by the book: count, escape, exclude."""
    counts = {}
    for _, t, lang, *_ in learned:
        data = b"\n\n" + t.encode()
        for i in range(2, len(data)):
            for k in range(3):
                at = counts.setdefault((lang, data[i - k:i]), {})
                at[data[i]] = at.get(data[i], 0) + 1

    def p(lang, context):
        """The distribution after a context, as a list of 256."""
        if context is None:
            return [1 / 256] * 256
        full = counts.get((lang, context), {})
        lower = p(lang, context[1:] if context else None)
        if not full:
            return lower
        total, kinds = sum(full.values()), len(full)
        mass = sum(q for b, q in enumerate(lower) if b not in full)
        return [full[b] / (total + kinds) if b in full else kinds / (total + kinds) * lower[b] / mass for b in range(256)]

    out = []
    for t in texts:
        data = b"\n\n" + t.encode()
        out.append({lang: -sum(math.log(p(lang, data[i - 2:i])[data[i]]) for i in range(2, len(data)))
                    for lang in sorted({x[2] for x in learned})})
    return out


def test_code_lengths_by_the_book(spark):
    learned = corpus(1, 40, 6)
    models = language.learn(cases.frame(spark, learned))
    texts = ["bab lo", "schuzen", "él ba zen", "\x00\xff never seen", "q"]
    got = models.code_lengths([t.encode() for t in texts])
    for row, want in zip(got, plain(learned, texts), strict=True):
        assert row == pytest.approx([want[x] for x in models.langs], rel=1e-4)


def test_probabilities_sum_to_one(spark):
    import numpy as np
    models = language.learn(cases.frame(spark, corpus(2, 60)))
    assert np.exp(models.table.astype(float)).sum(1) == pytest.approx(1, abs=1e-4)
    pruned = language.learn(cases.frame(spark, corpus(2, 60)), max_contexts=3)
    assert len(pruned.table) == 259
    assert np.exp(pruned.table.astype(float)).sum(1) == pytest.approx(1, abs=1e-4)


def test_held_out_accuracy(spark):
    models = language.learn(cases.frame(spark, corpus(3)))
    fresh = corpus(4, 200, 6)
    got = {r["doc_id"]: r for r in language.identify(cases.frame(spark, fresh), models).collect()}
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in fresh) / len(fresh) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_awkward_cases(spark):
    models = language.learn(cases.frame(spark, corpus(3)))
    docs = [(1, None, "aa", None, None), (2, "", None, None, None), (3, "123 !!", "bb", None, None), (None, "schuzen", None, None, None),
            (5, "baba " * 100_000, None, None, None), (5, "baba " * 100_000, None, None, None)]
    got = cases.rows(language.identify(cases.frame(spark, docs, clashing=True), models).select("doc_id", "lang_pred"))
    assert got == [(1, "und"), (2, "und"), (3, "und"), (5, "aa"), (5, "aa"), (None, "bb")]
    assert {r["lang_pred"] for r in language.identify(cases.frame(spark, docs), None).collect()} == {"und"}
    assert language.learn(cases.empty(spark)) is None
    assert language.identify(cases.empty(spark), models).collect() == []

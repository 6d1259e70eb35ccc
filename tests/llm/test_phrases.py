import random
import re
from collections import Counter

import pytest

from churnkit.llm import phrases
from tests.llm import cases

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, least, depth=5, share=100, top=2000):
    """Counts by going through every piece, scores and containment by the contract's words."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for m in range(1, min(depth, len(words) - i) + 1):
                    f[lang or "und", tuple(words[i:i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), b in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                if 100 * b >= share * candidates[lang, words[i:i + m]]:
                    covered.add((lang, words[i:i + m]))
    out = {}
    for (lang, words), a in candidates.items():
        if (lang, words) in covered:
            continue
        cut = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cut.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cut)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted([(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items()
                   for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)], key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abCdé\x01") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    fixed = [rng.choices(vocabulary, weights, k=rng.randint(2, 7)) for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 30)):
            words += rng.choice(fixed) if rng.random() < 0.5 else rng.choices(vocabulary, weights, k=2)
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n"]) for w in words), rng.choice(["en", "de", "und", None]), "s", 1))
    return rows


@pytest.mark.parametrize("how", [{}, {"budget": 40}, {"budget": 7, "bits": 8}, {"top": 9, "share": 60}, {"depth": 2}, {"depth": 3, "budget": 5}])
def test_same_as_going_through_every_piece(spark, monkeypatch, how):
    monkeypatch.setattr(phrases, "SALTS", 5)
    rows = corpus()
    expected = plain(rows, 6, **{k: v for k, v in how.items() if k in ("top", "share", "depth")})
    assert len(expected) > 15
    assert cases.rows(phrases.collocations(cases.frame(spark, rows, clashing=True), least=6, **how)) == expected


def test_awkward_texts(spark):
    rows = cases.documents()
    assert cases.rows(phrases.collocations(cases.frame(spark), least=3, budget=500)) == plain(rows, 3)


def test_empty_and_wordless_tables(spark):
    assert phrases.collocations(cases.empty(spark)).collect() == []
    rows = [(1, None, None, "s", 1), (2, "", "en", "s", 1), (3, " . \n", "en", "s", 1)]
    assert phrases.collocations(cases.frame(spark, rows), least=1).collect() == []


def test_products_beyond_64_bits_are_exact(spark):
    words = spark.createDataFrame([("en", "a", 3 * 10**14), ("en", "b", 7 * 10**13 + 1)], "lang string, phrase string, n long")
    pair = spark.createDataFrame([("en", "a b", 2, 5 * 10**13 + 3)], "lang string, phrase string, length long, n long")
    totals = spark.createDataFrame([("en", 9 * 10**14 + 7)], "lang string, n long")
    got = phrases._cuts(pair, words, totals).first()["score"]
    assert got == 1000 * (5 * 10**13 + 3) * (9 * 10**14 + 7) // (3 * 10**14 * (7 * 10**13 + 1))

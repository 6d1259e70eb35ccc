import random
from itertools import pairwise

import numpy as np
import pytest

from churnkit.llm import decontaminate
from tests.llm import cases


def plain_score(a, b):
    """Smith-Waterman, cell by cell."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_cell_by_cell():
    rng = np.random.default_rng(3)
    a = [rng.integers(0, 5, rng.integers(1, 12)) for _ in range(60)]
    b = [rng.integers(-1, 5, rng.integers(1, 25)) for _ in range(60)]
    score, end_a, end_b = decontaminate.align(a, b)
    assert score.tolist() == [plain_score(x.tolist(), [y if y >= 0 else None for y in ys.tolist()]) for x, ys in zip(a, b, strict=True)]
    for x, y, s, i, j in zip(a, b, score, end_a, end_b, strict=True):
        if s:
            assert plain_score(x[:i].tolist(), [v if v >= 0 else None for v in y[:j].tolist()]) == s


def setting(seed=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, prose(rng.randint(14, 40))) for i in range(12)]
    docs, want = [], set()
    for d in range(120):
        words = prose(rng.randint(0, 150))
        if d % 4 == 0:
            i, own = items[d // 4 % 12]
            copy = list(own)
            for _ in range(len(copy) // 8 if d % 8 else 0):          # edited copies
                k = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[k] = "edited"
                else:
                    del copy[k]
            at = rng.randint(0, len(words))
            words[at:at] = copy
            want.add((d, i))
        text = ". ".join(" ".join(words[i:j]).capitalize() for i, j in pairwise([0, len(words) // 2, len(words)]))
        docs.append((d, text, None, None, None))
    return docs, [(i, " ".join(w)) for i, w in items], want


BENCHMARK = "item_id long, text string"


def test_copies_and_edited_copies_are_found(spark):
    docs, items, want = setting()
    benchmark = spark.createDataFrame(items, BENCHMARK)
    for block_words in (10**6, 60):
        got = decontaminate.find_leaks(cases.frame(spark, docs, clashing=True), benchmark, block_words=block_words).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    import re
    text = dict((d, t) for d, t, *_ in docs)
    for r in got:
        assert len(re.findall(r"\w+", text[r["doc_id"]])) >= r["word_end"] > r["word_start"] >= 0
    kept = decontaminate.decontaminate(cases.frame(spark, docs, clashing=True), benchmark).collect()
    assert {r["doc_id"] for r in kept} == {d for d, *_ in docs} - {d for d, _ in want}


def test_an_item_in_most_documents_keeps_its_seeds(spark):
    rng = random.Random(1)
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(d, f"{rng.random()} {item} {rng.random()}" if d % 3 else "nothing here", None, None, None) for d in range(90)]
    got = decontaminate.find_leaks(cases.frame(spark, docs), spark.createDataFrame([(7, item)], BENCHMARK)).collect()
    assert sorted(r["doc_id"] for r in got) == [d for d in range(90) if d % 3]


def test_awkward_cases(spark):
    benchmark = spark.createDataFrame([(1, None), (None, "a b c d e"), (2, ""), (3, "--- !"), (4, "solo"), (5, "one two three four five"),
                                       (5, "one two three four five")], BENCHMARK)
    docs = [(1, None, None, None, None), (2, "", None, None, None), (3, "here solo stands", None, None, None),
            (None, "One, two; three\nfour five.", None, None, None), (6, "one two three four five " * 3000, None, None, None),
            (6, "one two three four five " * 3000, None, None, None)]
    got = cases.rows(decontaminate.find_leaks(cases.frame(spark, docs), benchmark).select("doc_id", "item_id", "similarity"))
    assert set(got) == {(3, 4, 1.0), (None, 5, 1.0), (6, 5, 1.0)}
    assert decontaminate.decontaminate(cases.frame(spark, docs), benchmark).count() == 2
    assert decontaminate.find_leaks(cases.empty(spark), benchmark).collect() == []
    assert decontaminate.find_leaks(cases.frame(spark, docs), benchmark.limit(0)).collect() == []
    assert decontaminate.decontaminate(cases.frame(spark, docs), benchmark.limit(0)).count() == len(docs)


@pytest.mark.parametrize("length", [1, 3, 30])
def test_cut_parts_hold_every_place_of_an_item(length):
    for end in range(1, 2000, 97):
        parts = decontaminate._cut(0, end, length)
        assert parts[0][0] == 0 and parts[-1][1] == end
        assert all(a2 <= b1 - length for (_, b1), (a2, _) in pairwise(parts))


@pytest.mark.parametrize("every", [3, 4, 5])
@pytest.mark.parametrize("copies", [1, 400])
def test_an_evenly_edited_copy_is_found_as_the_only_leak(spark, every, copies):
    """Most of the item's n-grams occur nowhere; none stays whole where every third word is replaced."""
    words = [f"w{i}" for i in range(20)]
    edited = " ".join(w if i % every else "edited" for i, w in enumerate(words, 1))
    docs = [(d, f"before {edited} after" if d < copies else "nothing here w3", None, None, None) for d in range(copies + 20)]
    benchmark = spark.createDataFrame([(7, " ".join(words))], BENCHMARK)
    got = decontaminate.find_leaks(cases.frame(spark, docs), benchmark).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(copies))
    want = plain_score(words, edited.split()) / 40
    assert all(r["similarity"] == pytest.approx(want) for r in got)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 0.95])
def test_every_alignment_that_reaches_the_least_is_found(least):
    """Against all pairs aligned cell by cell, whatever the seeds' frequencies are."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(1, 16))]) for i in range(15)]
    texts = []
    for k in range(150):
        words = [rng.choice([*vocabulary, "other", "others"]) for _ in range(rng.randint(0, 60))]
        if k % 2:
            copy = [w if rng.random() < 0.8 else "edited" for w in rng.choice(items)[1]]
            words[len(words) // 2:len(words) // 2] = [w for x in copy for w in ([x, "let", "in"][:rng.choice([1, 1, 2, 3])])]
        texts.append(words)
    want = {(t, i): plain_score(item, words) / (2 * len(item)) for t, words in enumerate(texts) for i, item in items}
    want = {k: v for k, v in want.items() if v >= least}
    for skew in (False, True):
        block = decontaminate.Block.of(items, 3, least)
        frequency = np.array([rng.choice([0, 1, 1000]) if skew else 1 for _ in block.grams])
        found = decontaminate.Searcher(block, block.rarest(frequency)).search([" ".join(w) for w in texts])
        assert {(t, i): v for t, i, v, _, _ in found} == pytest.approx(want)


def test_words_are_those_of_the_pattern():
    text = "".join(chr(c) + ("a" if c % 3 else " ") for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    for part in (text, "Plain, ASCII\x0btext_1 -- it's", "", "\u2014", "Stra\u00dfe\u2026\u0130x"):
        assert [w.decode() for w in decontaminate._words(part)] == decontaminate.WORD.findall(part.lower())


@pytest.mark.parametrize("size", [1, 3])
def test_texts_are_searched_together_and_give_what_each_gives_alone(monkeypatch, size):
    docs, items, want = setting()
    texts = [text + " " + text * 40 if d % 10 == 0 else text for d, text, *_ in docs]      # some longer than an uncut stretch
    block = decontaminate.Block.of([(i, text.split()) for i, text in items], size, 0.5)
    searcher = decontaminate.Searcher(block, block.rarest(np.ones(len(block.grams), np.int64)))
    alone = [(t, *rest) for t, text in enumerate(texts) for _, *rest in searcher.search([text])]
    calls, candidates = [], decontaminate.Searcher.candidates
    monkeypatch.setattr(decontaminate.Searcher, "candidates", lambda self, words, *a: calls.append(len(words)) or candidates(self, words, *a))
    assert searcher.search(texts) == alone and {(t, i) for t, i, *_ in alone} >= want
    assert len(calls) == 1

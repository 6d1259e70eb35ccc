import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from churnkit.llm import lexical
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, top=50):
    """Scores document by document, as the contract words them."""
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t, *_ in docs]
    bags = [(d, b) for d, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, bag in bags:
            n = sum(bag.values())
            m = 50 + 50 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
                        for t in set(TERM.findall((text or "").translate(LOWER))) if t in bag)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def items():
    docs = [t for _, t, *_ in sorted(cases.documents(), key=str) if t]
    rng = random.Random(5)
    texts = [" ".join(rng.choice(docs).split()[:rng.randint(1, 40)]) for _ in range(25)]
    texts += ["nowhere-seen", "", None, " ...", texts[0], texts[0].upper(), "ÉÊÈ 日本語の文", "word", "the a " + texts[1]]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]


@pytest.mark.parametrize("how", [{}, {"top": 5}, {"block_bytes": 200}])
def test_same_as_document_by_document(spark, how):
    asked = spark.createDataFrame(items(), "item_id long, text string")
    got = lexical.rank(cases.frame(spark, clashing=True), asked, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert cases.rows(got) == plain(cases.documents(), items(), how.get("top", 50))


def test_empty_tables_and_text_ids(spark):
    asked = spark.createDataFrame([("x", "word two"), (None, "word")], "item_id string, text string")
    assert lexical.rank(cases.empty(spark), asked).collect() == []
    assert lexical.rank(cases.frame(spark), asked.limit(0)).collect() == []
    assert {r["item_id"] for r in lexical.rank(cases.frame(spark), asked).collect()} == {"x", None}


def test_ties_of_many_copies_keep_the_lowest_ids(spark):
    docs = [(i, "apple pear", "en", "s", 10) for i in range(900, 0, -1)] + [(i, "plum", "en", "s", 4) for i in range(901, 2000)]
    got = lexical.rank(cases.frame(spark, docs), spark.createDataFrame([(1, "apple")], "item_id long, text string"), top=50)
    assert [(r["rank"], r["doc_id"]) for r in got.orderBy("rank").collect()] == [(i, i) for i in range(1, 51)]


@pytest.mark.parametrize("seed", range(4))
def test_shared_sums_equal_the_items_sums(seed):
    rng = random.Random(seed)
    rows = [rng.sample(range(60), rng.randint(1, 40)) for _ in range(30)]
    plan = lexical.share(rows, 60)
    values = np.array([rng.randint(0, 10**12) for _ in range(60)])
    sums = list(values)
    for a, b in zip(plan.left, plan.right, strict=True):
        sums.append(sums[a] + sums[b])
    assert [sum(sums[n] for n in own) for own in plan.items] == [int(values[r].sum()) for r in rows]
    assert len(plan.left) + sum(len(own) - 1 for own in plan.items) < sum(len(r) - 1 for r in rows)

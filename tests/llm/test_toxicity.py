import random

import numpy as np
import pytest

from churnkit.llm import toxicity
from tests.llm import cases

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    insults = ["zorgwit", "quexat", "bruvlo"]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(insults) + rng.choice(["", "s", "ig", "ung"]) + rng.choice(["", "!", ","]))
        out.append((i, " ".join(words), None, None, None, int(toxic)))
    return out


def test_held_out_documents(spark):
    rows = corpus()
    docs = cases.frame(spark, [r[:5] for r in rows], clashing=True)
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows], LABELS)
    got = {r["doc_id"]: r for r in toxicity.score(docs, docs.where("doc_id % 3 > 0"), labels, bits=16).collect()}
    fresh = [r for r in rows if r[0] % 3 == 0]
    toxic, clean = [got[r[0]]["predicted"] for r in fresh if r[5]], [got[r[0]]["predicted"] for r in fresh if not r[5]]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.03
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    kept = toxicity.keep_ordinary(docs, docs.where("doc_id % 3 > 0"), labels, bits=16)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if not r["predicted"]}
    assert kept.columns == docs.columns


def plain_shared(grams, sizes=toxicity.SHORTER, discount=0.75):
    """Kneser-Ney by definition: numbers of different left neighbours."""
    level, kinds = set(grams), {}
    for size in sizes:
        count = {}
        for g in level:
            count[g[-size:]] = count.get(g[-size:], 0) + 1
        kinds[size], level = count, set(count)

    def p(tail):
        if tail is None:
            return 1 / 256
        same = {t: n for t, n in kinds[len(tail)].items() if t[:-1] == tail[:-1]}
        below = [s for s in sizes if s < len(tail)]
        low = p(tail[-below[0]:] if below else None)
        return (kinds[len(tail)][tail] - discount + discount * len(same) * low) / sum(same.values())

    return {t: p(t) for t in kinds[sizes[0]]}


def test_shared_backoff_by_definition(spark):
    rng = random.Random(1)
    grams = {bytes(rng.choice(b"ab ") for _ in range(toxicity.ORDER)) for _ in range(200)}
    code = lambda g: int(np.array([int.from_bytes(g, "big")], np.uint64).view(np.int64)[0])
    counts = spark.createDataFrame([(code(g), 1, 0) for g in grams], "code long, n0 long, n1 long")
    got = {r["tail"]: r["p"] for r in toxicity.shared_backoff(counts).collect()}
    want = {int.from_bytes(t, "big"): p for t, p in plain_shared(grams).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_grams_stay_inside_words():
    code, starts = toxicity._grams(b" ab abcdefghij ")
    got = [int(c).to_bytes(8, "big").lstrip(b"\0") for c in code]
    assert got[:4] == [b" a", b" ab", b" ab ", b" a"]
    assert got[10:] == [b"abcdefgh", b"bcdefghi", b"cdefghij", b"defghij "]
    assert starts.tolist() == [0, 3]
    assert toxicity._grams(b"  ")[0].tolist() == [0x2020]


def test_awkward_cases(spark):
    rows = corpus(300)
    learn = cases.frame(spark, [r[:5] for r in rows])
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows] + [(None, 1, 1), (3, None, None)], LABELS)
    docs = cases.frame(spark)
    got = toxicity.score(docs, learn, labels, bits=14).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in cases.documents())
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    for kind in (0, 1):
        one = spark.createDataFrame([(r[0], 1, kind) for r in rows], LABELS)
        assert {r["predicted"] for r in toxicity.score(docs, learn, one, bits=14).collect()} == {kind}
    assert toxicity.score(cases.empty(spark), learn, labels, bits=14).collect() == []
    assert {r["predicted"] for r in toxicity.score(docs, cases.empty(spark), labels, bits=14).collect()} == {0}
    assert toxicity.keep_ordinary(docs, learn, labels, bits=14).where("doc_id is null").count() == 2


def test_no_gram_is_dropped_whatever_the_table_size(spark):
    """Many times more different grams than 2**bits give the same evidence as a table that holds them all."""
    rows = corpus(200)
    docs = cases.frame(spark, [r[:5] for r in rows])
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows], LABELS)
    by_bits = []
    for bits in (8, 20):
        got = toxicity.score(docs, docs.where("doc_id % 3 > 0"), labels, bits=bits).collect()
        by_bits.append({r["doc_id"]: [r[c] for c in ("score", *toxicity.EVIDENCE)] for r in got})
    few, many = by_bits
    assert few.keys() == many.keys()
    assert all(few[d] == pytest.approx(many[d], rel=1e-5, abs=1e-6) for d in many)


def test_shared_backoff_goes_down_byte_by_byte(spark):
    """Every length from seven to one, one left neighbour at a time, whatever the module's own lengths are."""
    rng = random.Random(4)
    grams = {bytes(rng.choice(b"ab ") for _ in range(8)) for _ in range(200)}
    code = lambda g: int(np.array([int.from_bytes(g, "big")], np.uint64).view(np.int64)[0])
    counts = spark.createDataFrame([(code(g), 1, 0) for g in grams], "code long, n0 long, n1 long")
    got = {r["tail"]: r["p"] for r in toxicity.shared_backoff(counts).collect()}
    want = {int.from_bytes(t, "big"): p for t, p in plain_shared(grams, range(7, 0, -1)).items()}
    assert got == pytest.approx(want, rel=1e-9)


def by_definition(learn, texts):
    """The four evidences of each text, gram by gram, from ``learn``: [(text, toxic)]."""
    def grams(text):
        """((previous word, word so far), (seven bytes within the word), next byte) of the running text."""
        before = b""
        for word in toxicity._stream(text.lower().encode()).split():
            whole = b" " + word + b" "
            for i in range(1, len(whole)):
                yield (before, whole[:i]), whole[max(0, i - 7):i], whole[i:i + 1]
            before = word

    near, far = ({}, {}), ({}, {})
    for text, toxic in learn:
        found = list(grams(text))
        for g in {(b, c) for _, b, c in found}:
            near[toxic].setdefault(g[0], {}).setdefault(g[1], 0)
            near[toxic][g[0]][g[1]] += 1
        for g in {(a, c) for a, _, c in found}:
            far[toxic].setdefault(g[0], {}).setdefault(g[1], 0)
            far[toxic][g[0]][g[1]] += 1
    shared = plain_shared({(b + c).rjust(8, b"\0") for kind in near for b, cs in kind.items() for c in cs})

    def p(counts, context, byte, low):
        own = counts.get(context, {})
        n = sum(own.values())
        return (max(own.get(byte, 0) - 0.75, 0) + 0.75 * len(own) * low) / n if n else low

    def unseen(table, context):
        back = [0.75 * len(t[context]) / sum(t[context].values()) if context in t else 1.0 for t in table]
        return min(0.0, np.log(back[1] / back[0]))

    def seen(table, context, byte):
        return any(byte in t.get(context, {}) for t in table)

    def ratios(a, b, byte):
        tail = (b + byte).rjust(8, b"\0")[-7:]
        if seen(near, b, byte):
            low = [p(t, b, byte, shared[tail]) for t in near]
            within = np.log(low[1] / low[0])
        else:
            within = unseen(near, b)
        if sum(far[1].get(a, {}).values()) < toxicity.SHARED:
            return within, within
        if seen(far, a, byte):
            return np.log(p(far[1], a, byte, low[1]) / p(far[0], a, byte, low[0])), within
        return within + unseen(far, a), within

    out = []
    for text in texts:
        words, before, size = [], b"", 0
        for word in toxicity._stream(text.lower().encode()).split():
            whole = b" " + word + b" "
            words.append(np.sum([ratios((before, whole[:i]), whole[max(0, i - 7):i], whole[i:i + 1])
                                 for i in range(1, len(whole))], axis=0))
            before, size = word, size + len(whole) - 1
        words = np.array(words).reshape(-1, 2)
        out.append([*(words.sum(0) / size), *np.log(np.exp(words).mean(0))] if len(words) else [0.0] * 4)
    return out


def test_evidence_by_definition(spark):
    rows = corpus(120)
    docs = cases.frame(spark, [r[:5] for r in rows])
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows], LABELS)
    learnt = {r["doc_id"] for r in docs.where(~toxicity._sets_curve()).collect()}
    texts = [r[1] for r in rows[:40]] + ["", "Zorgwit zorgwits, never-seen words é", "a"]
    want = by_definition([(r[1], r[5]) for r in rows if r[0] in learnt], texts)
    asked = cases.frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: [r[c] for c in toxicity.EVIDENCE] for r in toxicity.score(asked, docs, labels, bits=12).collect()}
    for i, line in enumerate(want):
        assert got[i] == pytest.approx(line, rel=1e-4, abs=1e-5), texts[i]


def prose(rng, vocabulary, n):
    return [rng.choice(vocabulary) for _ in range(n)]


def test_expressions_of_ordinary_words(spark):
    """Toxic texts hold two words side by side that ordinary texts hold apart; they are caught in texts not learnt from."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    rows = []
    for i in range(1200):
        words = prose(rng, vocabulary, rng.randint(20, 60))
        if i % 5 == 0:
            for _ in range(2):
                at = rng.randint(0, len(words))
                words[at:at] = [vocabulary[0], vocabulary[1]]
        else:                                         # the same words, never in this order
            words = [w for w in words if w != vocabulary[0]]
            for _ in range(2):
                words += [vocabulary[1], vocabulary[0], vocabulary[2]]
        rows.append((i, " ".join(words), None, None, None, int(i % 5 == 0)))
    docs = cases.frame(spark, [r[:5] for r in rows])
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows], LABELS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, docs.where("doc_id % 4 > 0"), labels).collect()}
    fresh = [r for r in rows if r[0] % 4 == 0]
    assert np.mean([got[r[0]] for r in fresh if r[5]]) >= 0.9
    assert np.mean([got[r[0]] for r in fresh if not r[5]]) <= 0.03


def test_long_clean_texts_with_unseen_words_stay(spark):
    """Of clean texts with one unseen word in a hundred, long ones are not flagged more than short ones."""
    rows = corpus(700)
    rng = random.Random(9)
    known = sorted({w for r in rows if not r[5] for w in r[1].split()})
    asked = []
    for i, size in enumerate([60] * 60 + [6000] * 60):
        words = prose(rng, known, size)
        for at in range(0, size, 100):
            words[at + rng.randrange(min(100, size))] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
        asked.append((i, " ".join(words), None, None, None))
    docs = cases.frame(spark, [r[:5] for r in rows])
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows], LABELS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(cases.frame(spark, asked), docs, labels).collect()}
    short, long = [got[i] for i in range(60)], [got[i] for i in range(60, 120)]
    assert sum(short) <= 3 and sum(long) <= 3


def test_tables_stand_in_order_of_code_and_are_looked_up_a_batch_at_a_time(spark):
    rng = np.random.default_rng(4)
    code = np.unique(rng.integers(-2**62, 2**62, 3000))
    ratio = rng.random(len(code)).astype(np.float32)
    order = rng.permutation(len(code))
    grams = spark.createDataFrame([(int(code[i]), float(ratio[i])) for i in order], "code long, ratio double").repartition(5)
    asked = np.concatenate([code[::7], code[::7], code[:50] + 1])
    want = dict(zip(code.tolist(), ratio.tolist(), strict=True))
    for bits in (8, 20):
        shards = toxicity._shards(grams, bits)
        assert (shards.parts > 1) == (bits == 8)
        seen = [b.column(0).to_numpy() for b in toxicity.C.shared_batches(shards.path, ["code"], 100)]
        assert all(len(c) <= 100 and (np.diff(c) > 0).all() for c in seen)
        assert sorted(np.concatenate(seen).tolist()) == code.tolist()
        assert np.array_equal(shards.look(asked.view(np.uint64)), np.array([want.get(c, np.nan) for c in asked.tolist()], np.float32), equal_nan=True)
        assert len(shards.look(asked[:0].view(np.uint64))) == 0

"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is the stated query set. It is taken in blocks of bounded size
(``block_words``), each block against all documents. A first pass counts in
how many documents each word n-gram of the block occurs. An alignment that
reaches the least similarity keeps at least ``sure`` n-grams of the item whole
(from the scores alone), so some of them are among the others and one: those,
the rarest, are the item's seeds, and no alignment can miss them, whatever
occurs how often. Where edits may break every n-gram of the usual size, the
item's seeds are shorter, down to single words. A second pass looks for seeds
in every whole text, and aligns the item with the surroundings of the hits
(local alignment over words: match 2, mismatch and gap -1). The similarity is
the best score over that of the item with itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm import common as C

WORD = re.compile(r"\w+")
APART = bytes(b if b > 127 or WORD.fullmatch(chr(b)) else 32 for b in range(256))
MATCH, MISMATCH, GAP = 2, -1, -1
TOGETHER = 256                        # alignments done at once
WORDS = 1 << 16                       # words of texts searched together
PAIRS = 1 << 20                       # (word, item) pairs looked at together
SPARE = 4                             # one in so many of the n-grams sure to stay whole is asked for before an alignment


def _least_score(length: int, least: float) -> int:
    return max(1, math.ceil(MATCH * length * least - 1e-9))


def _sure(length: int, size: int, least: float) -> int:
    """How many n-grams of an item any alignment that reaches ``least`` keeps
    whole, at least: each edit costs a point and ends a run of matches, and each
    run holds ``size`` - 1 fewer n-grams than words."""
    score = _least_score(length, least)
    return -(-score // MATCH) if size == 1 else length - (size - 1) * (MATCH * length - score + 1)


@dataclass
class Block:
    """Items of one block: ids, words as numbers of the block's own vocabulary (by their UTF-8 bytes),
    the size of each item's n-grams, and the distinct n-grams with the
    (gram, item, place) rows behind them."""

    ids: list[int]
    vocabulary: dict[bytes, int]
    words: list[np.ndarray]
    size: np.ndarray
    least: float
    grams: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, list[str]]], size: int, least: float) -> Block:
        vocabulary: dict[bytes, int] = {}
        words = [np.array([vocabulary.setdefault(w.encode(), len(vocabulary)) for w in ws], np.int64) for _, ws in items]
        own = np.array([max(n for n in range(1, max(1, min(size, len(ws))) + 1) if n == 1 or _sure(len(ws), n, least) > 0)
                        for ws in words], np.int64)
        rows = []
        base = len(vocabulary) + 1
        for i, ws in enumerate(words):
            code = _codes(ws, int(own[i]), base)
            rows.append(np.column_stack([code, np.full(len(code), i), np.arange(len(code))]))
        at = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
        at = at[np.argsort(at[:, 0], kind="stable")]
        return cls([i for i, _ in items], vocabulary, words, own, least, np.unique(at[:, 0]), at)

    def sure(self) -> np.ndarray:
        """Whole n-grams of each item in any alignment that reaches ``least``."""
        return np.array([_sure(len(w), int(n), self.least) for w, n in zip(self.words, self.size, strict=True)], np.int64)

    def asked(self) -> np.ndarray:
        """How many seeds of each item must stand together before it is aligned."""
        return np.maximum(1, -(-self.sure() // SPARE))

    def rarest(self, frequency: np.ndarray) -> np.ndarray:
        """The rows of ``at`` with the seeds: of each item's n-grams the rarest, so many
        that no alignment that reaches ``least`` has fewer than ``asked`` of them."""
        own = frequency[np.searchsorted(self.grams, self.at[:, 0])]
        order = np.lexsort((self.at[:, 2], own, self.at[:, 1]))
        many = np.bincount(self.at[:, 1], minlength=len(self.words))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(many) - many, many)
        keep = np.zeros(len(order), bool)
        keep[order] = rank < np.repeat(many - self.sure() + self.asked(), many)
        return self.at[keep]


def _codes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """One number per run of ``size`` words; -1 where a word is unknown. Runs of
    other sizes get other numbers (an item shorter than the usual size)."""
    n = len(words) - size + 1
    if size < 1 or n < 1:
        return np.empty(0, np.int64)
    code = np.zeros(n, np.int64)
    bad = np.zeros(n, bool)
    for k in range(size):
        part = words[k:k + n]
        bad |= part < 0
        code = code * base + part + 1
    return np.where(bad, -1, code & np.int64((1 << 63) - 1))      # a wrapped code only costs a candidate


def _words(text: str) -> list[bytes]:
    """What ``WORD`` finds in the lower-cased text, as UTF-8: signs become spaces, and the text is split at those."""
    text = text.lower()
    if not text.isascii():
        for sign in set(text):
            if sign > "\x7f" and not WORD.match(sign):
                text = text.replace(sign, " ")
    return text.encode("utf-8", "surrogatepass").translate(APART).split()


def _numbers(text: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    words = _words(text)
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))


def _direct(grams: np.ndarray, base: int) -> np.ndarray:
    """For each code of a single word its row of ``grams``, -1 where it is not among them."""
    rows = np.full(base, -1, np.int32)
    single = np.searchsorted(grams, base)
    rows[grams[:single]] = np.arange(single)
    return rows


def _found(words: np.ndarray, grams: np.ndarray, sizes: list[int], base: int, direct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row of ``grams``) of every n-gram of the text that is among ``grams``."""
    places, rows = [], []
    for size in sizes:
        if size == 1:
            row = direct[words + 1]
            place = np.flatnonzero(row >= 0)
            row = row[place]
        else:
            code = _codes(words, size, base)
            maybe = np.flatnonzero(code >= 0)
            row = np.minimum(np.searchsorted(grams, code[maybe]), len(grams) - 1)
            hit = grams[row] == code[maybe]
            place, row = maybe[hit], row[hit]
        places.append(place)
        rows.append(row)
    return np.concatenate(places), np.concatenate(rows)


def _sizes(block: Block) -> list[int]:
    return np.unique(block.size).tolist()


def _frequency_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    block: Block = sent.value
    counts, held = np.zeros(len(block.grams), np.int64), np.zeros(len(block.grams), bool)
    sizes, base = _sizes(block), len(block.vocabulary) + 1
    direct = _direct(block.grams, base)
    for batch in C.groups(batches):
        for text in C.texts(batch):
            _, rows = _found(_numbers(text, block.vocabulary), block.grams, sizes, base, direct)
            held[rows] = True
            counts += held
            held[rows] = False
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["gram", "n"])


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and where it ends in item and passage (exclusive).

    All pairs advance together, one item word a step; the gaps along the
    passage come out of a running maximum.
    """
    m, n = max(map(len, items)), max(map(len, passages))
    a = np.full((len(items), m), -2, np.int32)
    b = np.full((len(items), n), -3, np.int32)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, :len(x)], b[i, :len(y)] = x, y
    slope = -GAP * np.arange(1, n + 1, dtype=np.int32)
    row = np.zeros((len(items), n + 1), np.int32)
    best, end_a, end_b = (np.zeros(len(items), np.int32) for _ in range(3))
    for i in range(m):
        gain = np.where(b == a[:, i:i + 1], np.int32(MATCH), np.int32(MISMATCH))
        base = np.maximum(np.maximum(row[:, :-1] + gain, row[:, 1:] + GAP), 0)
        row[:, 1:] = np.maximum.accumulate(base + slope, axis=1) - slope
        top = row.max(1)
        better = top > best
        best[better], end_a[better], end_b[better] = top[better], i + 1, row.argmax(1)[better]
    return best, end_a, end_b


def _width(length):
    """The longest stretch that is looked at uncut."""
    return 6 * length + 64


def _slices(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in their order, with sizes of about ``PAIRS`` together."""
    home = (np.cumsum(sizes) - sizes) // PAIRS
    yield from np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(home)) + 1)


def _cut(a: int, b: int, length: int) -> list[tuple[int, int]]:
    """A long stretch in overlapping parts, each able to hold the whole item."""
    width = _width(length)
    if b - a <= width:
        return [(a, b)]
    step = width - 3 * length - 16
    return [(x, min(b, x + width)) for x in range(a, max(a + 1, b - (width - step)), step)]


def _at_most(common: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What alignments can score at most, given which words of one side the other
    has: within its stretch each of them gains a match, each other word costs an edit.
    ``common`` holds sides of the given lengths (1 or more), one behind the other."""
    begin = np.cumsum(length) - length
    total = np.cumsum(np.where(common, MATCH, MISMATCH))
    total -= np.repeat(np.append(0, total[begin[1:] - 1]), length)
    apart = np.repeat(np.arange(len(length)) * ((MATCH - MISMATCH) * int(length.max()) + 1), length)    # each side below the one before
    least = np.minimum(np.minimum.accumulate(total - apart) + apart, 0)
    return np.maximum.reduceat(total - least, begin)


class Searcher:
    """Finds the items of one block in texts, by the given seeds."""

    def __init__(self, block: Block, seeds: np.ndarray):
        self.block, self.least = block, block.least
        self.grams = np.unique(seeds[:, 0])
        self.first = np.searchsorted(seeds[:, 0], self.grams)
        self.last = np.searchsorted(seeds[:, 0], self.grams, side="right")
        self.seeds, self.sizes, self.base = seeds, _sizes(block), len(block.vocabulary) + 1
        lengths = np.array([len(w) for w in block.words], np.int64)
        self.score = np.array([_least_score(n, self.least) for n in lengths.tolist()], np.int64)
        self.slack = np.maximum(0, MATCH * lengths - self.score)       # words that an alignment may let in
        self.lengths, self.span, self.asked = lengths, lengths + self.slack, block.asked()
        self.flat = np.concatenate(block.words) if block.words else np.empty(0, np.int64)
        self.begins = np.cumsum(lengths) - lengths
        self.direct = _direct(self.grams, self.base)

    def candidates(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of the stretches that can hold an alignment that reaches ``least``:
        enough seeds within its longest extent, and words common to both close enough together in each.

        ``words`` holds texts from ``first`` to ``last`` (exclusive), with an unknown word between them."""
        if not len(self.grams):
            return
        places, rows = _found(words, self.grams, self.sizes, self.base, self.direct)
        if not len(places):
            return
        many, texts = self.last[rows] - self.first[rows], np.searchsorted(first, places, "right") - 1
        which = np.arange(many.sum()) + np.repeat(self.first[rows] - np.cumsum(many) + many, many)
        place, text = np.repeat(places, many), np.repeat(texts, many)
        item, offset = self.seeds[which, 1], self.seeds[which, 2]
        gap = int(self.span.max()) + 1
        wide = len(words) + (len(first) + 1) * gap         # places of two texts or items are further apart than any span
        here, back = np.unique(item * wide + place + text * gap, return_inverse=True)
        until = np.searchsorted(here, here + self.span[here // wide])
        close = np.flatnonzero((until - np.arange(len(here)) >= self.asked[here // wide])[back])
        if not len(close):
            return
        item, text, start = item[close], text[close], (place - offset)[close]
        order = np.lexsort((start, text, item))            # where the item may lie; overlapping stretches joined
        item, text, start = item[order], text[order], start[order]
        a = np.maximum(first[text], start - self.slack[item])
        b = np.minimum(last[text], start + self.span[item])
        fresh = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(text) != 0) | (a[1:] > b[:-1])))
        item, text, a, b = item[fresh], text[fresh], a[fresh], b[np.append(fresh[1:], len(b)) - 1]
        long = np.flatnonzero(b - a > _width(self.lengths[item]))
        if len(long):
            parts = [_cut(x, y, n) for x, y, n in zip(a[long].tolist(), b[long].tolist(), self.lengths[item[long]].tolist(), strict=True)]
            n = [len(p) for p in parts]
            extra = np.array([cut for p in parts for cut in p], np.int64)
            item, text = (np.append(np.delete(c, long), np.repeat(c[long], n)) for c in (item, text))
            a, b = np.append(np.delete(a, long), extra[:, 0]), np.append(np.delete(b, long), extra[:, 1])
            order = np.lexsort((a, text, item))
            item, text, a, b = item[order], text[order], a[order], b[order]
        size = len(words) + 1
        known = np.flatnonzero(words >= 0)
        index = np.append(np.sort(words[known] * size + known), np.iinfo(np.int64).max)     # places by word
        length = self.lengths[item]
        seen = np.zeros(self.base, bool)                   # the last one stands for unknown words
        for near in _slices(length):
            sizes = length[near]
            own = self.flat[np.arange(sizes.sum()) + np.repeat(self.begins[item[near]] - np.cumsum(sizes) + sizes, sizes)] * size
            at = index[np.searchsorted(index, own + np.repeat(a[near], sizes))]
            able = _at_most(at < own + np.repeat(b[near], sizes), sizes) >= self.score[item[near]]
            for k in near[able].tolist():
                i, x, y = int(item[k]), int(a[k]), int(b[k])
                seen[self.block.words[i]] = True
                if _at_most(seen[words[x:y]], np.array([y - x]))[0] >= self.score[i]:
                    yield int(text[k]), i, x, y
                seen[self.block.words[i]] = False

    def _joined(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts' words looked at together: number of the first text, words, where each text starts and ends."""
        held, many, t = [], 0, 0
        for n, text in enumerate(texts, 1):
            held.append(_numbers(text, self.block.vocabulary))
            many += len(held[-1])
            if many >= WORDS or n == len(texts):
                sizes = np.array([len(w) for w in held], np.int64)
                first = np.cumsum(sizes + 1) - sizes - 1
                yield t, np.concatenate([x for w in held for x in (w, [-1])]).astype(np.int64), first, first + sizes
                held, many, t = [], 0, n

    def search(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, end word) of the best alignment of every pair that reaches ``least``."""
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        waiting: list[tuple[int, int, int, np.ndarray]] = []

        def settle() -> None:
            items = [self.block.words[i] for _, i, _, _ in waiting]
            score, end_a, end_b = align(items, [p for _, _, _, p in waiting])
            for (t, i, start, passage), s, ea, eb in zip(waiting, score.tolist(), end_a.tolist(), end_b.tolist(), strict=True):
                similarity = s / (MATCH * len(self.block.words[i]))
                if similarity >= self.least and similarity > found.get((t, i), (0, 0, 0))[0]:
                    back = align([self.block.words[i][:ea][::-1]], [passage[:eb][::-1]])[2][0]
                    found[t, i] = similarity, start + eb - int(back), start + eb
            waiting.clear()

        for t, words, first, last in self._joined(texts):
            for k, i, a, b in self.candidates(words, first, last):
                waiting.append((t + k, i, a - int(first[k]), words[a:b]))
                if len(waiting) >= TOGETHER:
                    settle()
        if waiting:
            settle()
        return [(t, self.block.ids[i], *rest) for (t, i), rest in sorted(found.items())]


def _search_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    searcher: Searcher = sent.value
    for batch in C.groups(batches):
        hits = searcher.search(C.texts(batch))
        if hits:
            row, item, similarity, start, end = map(list, zip(*hits, strict=True))
            yield pa.RecordBatch.from_arrays(
                [C.column(batch, "doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()),
                 pa.array(similarity, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["doc_id", "item_id", "similarity", "word_start", "word_end"])


def _clean_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    searcher: Searcher = sent.value
    for batch in C.groups(batches):
        hit = {t for t, *_ in searcher.search(C.texts(batch))}
        yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))


def _blocks(benchmark: DataFrame, block_words: int, size: int, least: float) -> Iterator[Block]:
    """The items in order of id, at most about ``block_words`` words at a time."""
    items: list[tuple[int, list[str]]] = []
    held = 0
    ordered = benchmark.where("text is not null and item_id is not null").select("item_id", "text").orderBy("item_id", "text")
    for row in ordered.toLocalIterator():
        words = WORD.findall(row["text"].lower())
        if not words:
            continue
        if items and held + len(words) > block_words:
            yield Block.of(items, size, least)
            items, held = [], 0
        items.append((row["item_id"], words))
        held += len(words)
    if items:
        yield Block.of(items, size, least)


def _searchers(docs: DataFrame, benchmark: DataFrame, least: float, size: int, block_words: int) -> Iterator[Searcher]:
    sc = docs.sparkSession.sparkContext
    narrow = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    for block in _blocks(benchmark, block_words, size, least):
        counts = C.map_arrow(narrow, partial(_frequency_batches, sent=sc.broadcast(block)), "gram long, n long")
        frequency = np.zeros(len(block.grams), np.int64)
        for row in counts.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():   # one row a gram of the block
            frequency[row["gram"]] = row["n"]
        yield Searcher(block, block.rarest(frequency))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, size: int = 3,
               block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, similarity, word_start, word_end): every document and
    item whose best local alignment reaches ``least`` of the item's own score.

    Words are runs of word characters, lower-cased. Null or wordless items and
    texts match nothing. ``size`` is the longest seed; where edits that still
    reach ``least`` may break all n-grams of that size, seeds are shorter.
    Repeated rows, items and null doc_ids each give their own row. An empty
    table on either side gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id long, similarity double, word_start long, word_end long"
    out = spark.createDataFrame([], schema)
    for searcher in _searchers(docs, benchmark, least, size, block_words):
        out = out.unionByName(C.map_arrow(narrow, partial(_search_batches, sent=spark.sparkContext.broadcast(searcher)), schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, size: int = 3,
                  block_words: int = 1_000_000) -> DataFrame:
    """``docs`` without the documents that hold an item of ``benchmark`` (as in
    ``find_leaks``); all columns stay, no row is shuffled."""
    rest = docs.withColumn("text", F.col("text").cast("string"))
    for searcher in _searchers(docs, benchmark, least, size, block_words):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
        rest = C.map_arrow(rest, partial(_clean_batches, sent=docs.sparkSession.sparkContext.broadcast(searcher)), schema)
    return rest

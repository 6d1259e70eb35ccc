"""Ranked lexical search for many queries at once, by shared sub-expressions.

An item's score in a document is a sum over the item's terms, so items that
share terms share part of the sum. For a block of items the driver mines these
shared term sets: the pair of addends that most items have in common becomes a
node of its own, again and again (``share``), until no two items share a pair.
The nodes form a graph: a term at the leaves, a sum of two nodes above, an
item's own addends on top.

The documents are read once per block. A task counts the terms of the block in
each text and writes them as narrow postings; document frequencies and lengths
are added up from those. A second pass over the postings alone fills, for some
hundred documents at a time, one accumulator per leaf and node (each computed
once, level by level) and adds them up per item; every task keeps each item's
best, and a window over what the tasks kept gives the ranks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.llm import common as C

#: A-Z become a-z; ASCII that is neither letter nor digit separates; all other bytes belong to a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
MINED_TOGETHER = 256                 # of an item with more addends, so many at a time are searched for pairs
CELLS = 6 << 20                      # accumulators (nodes x documents) that a task holds
POSTINGS = "n long, terms array<int>, tfs array<int>"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(TERM_BYTES).split()


@dataclass
class Plan:
    """The sharing graph of a block: node ``i`` below ``n_terms`` is term i,
    the others add two earlier nodes; ``items`` holds each item's addends."""

    n_terms: int
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    levels: list[tuple[int, int]] = field(default_factory=list)      # nodes from, to (made in one round)
    items: list[list[int]] = field(default_factory=list)

    @property
    def n_nodes(self) -> int:
        return self.n_terms + len(self.left)


def share(items: list[list[int]], n_terms: int) -> Plan:
    """Mine addends that two or more items share, most shared first.

    A round counts the pairs inside each item and takes, by falling count,
    pairs whose addends are still free in it; where an item holds such a pair,
    the pair's node replaces both. A term occurs once in an item, so a node is
    never added twice.
    """
    plan = Plan(n_terms)
    rows = [sorted(set(item)) for item in items]
    while True:
        used = Counter(chain.from_iterable(rows))
        pairs: Counter[tuple[int, int]] = Counter()
        chunks = []
        for row in rows:
            shared = sorted((a for a in row if used[a] > 1), key=lambda a: (-used[a], a))
            own = [sorted(shared[at:at + MINED_TOGETHER]) for at in range(0, len(shared), MINED_TOGETHER)]
            chunks.append(own)
            for chunk in own:
                pairs.update(combinations(chunk, 2))
        worth = sorted(((n, pair) for pair, n in pairs.items() if n > 1), key=lambda x: (-x[0], x[1]))
        if not worth:
            break
        begin = plan.n_nodes
        holders: dict[int, set[int]] = {}
        for i, row in enumerate(rows):
            for a in row:
                holders.setdefault(a, set()).add(i)
        made = False
        for _, (a, b) in worth:
            both = holders[a] & holders[b]           # items that still hold both, whatever was replaced before
            if len(both) < 2:
                continue
            node = plan.n_nodes
            plan.left.append(a)
            plan.right.append(b)
            holders[a] -= both
            holders[b] -= both
            for i in both:
                rows[i] = [x for x in rows[i] if x != a and x != b] + [node]
            made = True
        if not made:
            break
        plan.levels.append((begin, plan.n_nodes))
    plan.items = rows
    return plan


@dataclass
class Block:
    """Items searched together."""

    ids: list
    vocabulary: dict[bytes, int]
    plan: Plan

    @classmethod
    def of(cls, items: list[tuple[object, list[bytes]]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        rows = [[vocabulary.setdefault(t, len(vocabulary)) for t in own] for _, own in items]
        return cls([i for i, _ in items], vocabulary, share(rows, len(vocabulary)))


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[Block]:
    """The items in order of id, at most about ``block_bytes`` of distinct terms at a time."""
    held, size = [], 0
    narrow = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    for row in narrow.orderBy("item_id", "text").toLocalIterator():
        own = sorted(set(terms(row["text"].encode())))
        if not own:
            continue
        if held and size + sum(map(len, own)) > block_bytes:
            yield Block.of(held)
            held, size = [], 0
        held.append((row["item_id"], own))
        size += sum(map(len, own))
    if held:
        yield Block.of(held)


def _posting_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Terms of the block in each document, with how often they occur, and the document's length."""
    known = sent.value
    for batch in C.groups(batches):
        sizes, ends, found, times = [], [0], [], []
        for text in C.utf8(batch):
            own = terms(text)
            counts = Counter(map(known.get, own))
            counts.pop(None, None)
            sizes.append(len(own))
            found.extend(counts.keys())
            times.extend(counts.values())
            ends.append(len(found))
        at = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [C.column(batch, "doc_id"), pa.array(sizes, pa.int64()),
             pa.ListArray.from_arrays(at, pa.array(found, pa.int32())),
             pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))], names=["doc_id", "n", "terms", "tfs"])


def _frequency_batches(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    """Documents of this task that hold each term, and (term -1) those with a
    term at all, with all their terms."""
    df = np.zeros(n_terms, np.int64)
    docs = length = 0
    for batch in batches:
        df += np.bincount(C.column(batch, "terms").flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        n = C.column(batch, "n").to_numpy()
        docs += int((n > 0).sum())
        length += int(n.sum())
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs)),
                                      pa.array(np.append(np.zeros(len(at), np.int64), length))], names=["term", "df", "length"])


@dataclass
class Scorer:
    plan: Plan
    weights: np.ndarray
    n_docs: int
    length: int
    base: int                        # of a hundred, the part of the length norm that does not depend on the length

    def impacts(self, n: np.ndarray, tfs: np.ndarray, term: np.ndarray) -> np.ndarray:
        m = self.base + (100 - self.base) * n * self.n_docs // max(self.length, 1)
        return self.weights[term] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m))

    def scores(self, sizes: np.ndarray, ends: np.ndarray, term: np.ndarray, tfs: np.ndarray) -> Iterator[np.ndarray]:
        """Each item's score in the given documents."""
        doc = np.repeat(np.arange(len(sizes)), np.diff(ends))
        sums = np.zeros((self.plan.n_nodes, len(sizes)), np.int64)
        sums[term, doc] = self.impacts(sizes[doc], tfs, term)
        left, right = np.array(self.plan.left, np.int64), np.array(self.plan.right, np.int64)
        for a, b in self.plan.levels:                 # a round adds nodes of earlier rounds only
            own = slice(a - self.plan.n_terms, b - self.plan.n_terms)
            sums[a:b] = sums[left[own]] + sums[right[own]]
        for addends in self.plan.items:
            yield sums[addends].sum(axis=0)


class Best:
    """An item's best documents so far: highest score, then lowest id, no id last."""

    def __init__(self, top: int):
        self.top, self.floor = top, 1
        self.rows = np.empty((3, 0), np.int64)        # score, has no id, id

    def take(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.floor)
        if not len(at):
            return
        rows = np.concatenate([self.rows, np.stack([scores[at], missing[at], ids[at]])], axis=1)
        if rows.shape[1] > self.top:
            rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[:self.top]]
            self.floor = int(rows[0, -1])
        self.rows = rows


def _best_batches(batches: Iterator[pa.RecordBatch], sent, top: int) -> Iterator[pa.RecordBatch]:
    scorer: Scorer = sent.value
    best = [Best(top) for _ in scorer.plan.items]
    step = max(1, CELLS // max(1, scorer.plan.n_nodes))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            ids = C.column(part, "doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            found, times = C.column(part, "terms"), C.column(part, "tfs")
            ends = found.offsets.to_numpy().astype(np.int64)
            scores = scorer.scores(C.column(part, "n").to_numpy(), ends - ends[0], found.flatten().to_numpy(),
                                   times.flatten().to_numpy().astype(np.int64))
            for own, values in zip(best, scores, strict=True):
                own.take(values, ids, missing)
    kept = [own.rows.shape[1] for own in best]
    score, missing, ids = np.concatenate([own.rows for own in best], axis=1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.arange(len(best)), kept)), pa.array(ids, mask=missing.astype(bool)), pa.array(score)],
        names=["item", "doc_id", "score"])


def rank(docs: DataFrame, items: DataFrame, top: int = 50, length_share: int = 50,
         block_bytes: int = 2 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents, by
    falling score and rising doc_id.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased, of whole texts. ``length_share`` of a hundred of the length
    norm follows the document's length. Null, empty and termless texts match
    nothing and do not count as documents; long texts count whole. A repeated
    document is ranked as often as it occurs; a null doc_id comes last among
    equal scores, which are cut in an arbitrary way only between equal rows.
    Every row of ``items`` gets its own ranks (also repeated ids); items
    without terms or matches give no rows. doc_id must be an integer. Empty
    tables on either side give an empty result; other columns are not read.
    Items are searched in blocks of about ``block_bytes`` of terms (a larger
    item is a block of its own), which bounds what is sent to tasks.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    id_type = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for block in _blocks(items, block_bytes):
        postings = C.stage(C.map_arrow(narrow, partial(_posting_batches, sent=sc.broadcast(block.vocabulary)),
                                       f"doc_id long, {POSTINGS}"), "postings")
        n_terms = len(block.vocabulary)
        counts = C.map_arrow(postings.select("n", "terms"), partial(_frequency_batches, n_terms=n_terms),
                             "term long, df long, length long")
        df, n_docs, length = [0] * n_terms, 0, 0
        for row in counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).collect():
            if row["term"] < 0:                       # one row a term of the block, and the totals
                n_docs, length = row["df"], row["length"]
            else:
                df[row["term"]] = row["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df], np.int64)
        scorer = Scorer(block.plan, weights, n_docs, length, 100 - length_share)
        best = C.map_arrow(postings.where(F.size("terms") > 0), partial(_best_batches, sent=sc.broadcast(scorer), top=top),
                           "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {id_type}")
        out = out.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out

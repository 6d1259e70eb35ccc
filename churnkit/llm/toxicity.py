"""Toxicity by class-conditional Kneser-Ney models over the bytes of the running text.

Each class (ordinary, toxic) counts in how many of its texts a byte follows a
context. The longest context is the word before and what the word has so far;
where toxic texts hold it too seldom (``SHARED`` times), both classes fall
back on the seven bytes before inside the word. What a class has not seen falls back,
by absolute discounting, to the next shorter context and at last to one shared Kneser-Ney model,
whose counts are the numbers of different left neighbours in both classes
together; so a rare expression borrows from words that share its stem.

The document's evidence covers every word of the text and does not grow with
its length: the difference of the two log-likelihoods over the number of
bytes, and the logarithm of the mean likelihood ratio of its words, both with
the word before and without it. (That mean is the likelihood ratio of a text
with one toxic expression at an unknown place; of ordinary texts it is about
one at any length.) A byte that neither class has seen after its context
never speaks for toxicity: the class with fewer texts leaves more to the
unseen, which tells its size only. A logistic curve makes the score.

The counts cover the learning rows but for a fifth of them, on which the curve
is set, so that it sees texts the counts don't know. They live in Spark
tables. The log-ratios of all grams are written to the shared folder in shards
of about 2**bits grams, as many as the corpus asks for. Tasks look up the
different words and word pairs of a group of texts in one shard after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnkit.llm import common as C

ORDER = 8
DISCOUNT = 0.75
SHORTER = (7, 6, 5, 4, 3, 2, 1)        # bytes of the grams of the shared model, longest first
SPACE = 32
STREAM_GROUP = 1 << 19                # compressed bytes worked on at once
CURVE_SHARE = 5                       # one learning document in so many sets the curve
SHARED = 3                            # toxic observations that make a word before the next one a context
SLOTS = 1 << 24                       # bits of the filter of such contexts
PAIRS = 1 << 15                       # different word pairs hashed at once
TALLY = 1 << 21                       # different grams that a task adds up before it sends them on
WORDS = 1 << 20                       # different words after the word before that a task adds up
WORD_BYTES = 32 << 20                 # and their bytes
PART_BYTES = 4 << 20                  # bytes of texts that ask for one more part
PAIR_COLUMNS = ["gram", "context", "code", "n0", "n1", "total0", "total1", "kinds0", "kinds1"]
EVIDENCE = ["whole", "whole_within", "pair", "word"]
APART = bytes(b if chr(b).isalnum() or b > 127 else SPACE for b in range(256))


def _stream(text: bytes) -> bytes:
    """The words of a lower-cased text in its order, one space around each;
    ASCII signs part words as white space does."""
    return b" " + b" ".join(text.translate(APART).split()) + b" "


def _grams(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes (context, then byte) of every byte after the first, and the
    starts of words. Contexts don't reach before the space that opens a word."""
    code = _codes(np.frombuffer(stream, np.uint8))
    ends = np.flatnonzero(code[1:] & np.uint64(255) == SPACE)
    return code[1:], np.concatenate([[0], ends[:-1] + 1])


def _codes(stream: np.ndarray) -> np.ndarray:
    """Each byte with the up to seven before it, back to the space that opens its word."""
    b = stream.astype(np.uint64)
    at = np.arange(len(b))
    opened = np.maximum.accumulate(np.where(b == SPACE, at, 0))
    depth = at - np.concatenate([[0], opened[:-1]])
    code = b.copy()
    for back in range(1, ORDER):
        code[back:] |= np.where(depth[back:] >= back, b[:-back], np.uint64(0)) << np.uint64(8 * back)
    return code


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _lengths(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.diff(np.append(starts, len(code)))


def _word_hashes(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(_mix(code), starts)


def _pairs(code: np.ndarray, before: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of (word before, this word so far) and of the same with the next
    byte, for the bytes of words (or of their beginnings) of the given lengths and
    hashes of the words before."""
    first = np.cumsum(length) - length
    place = np.arange(len(code)) - np.repeat(first, length)
    own = _mix(code)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
    so_far = total[:-1] - np.repeat(total[first], length)
    seed = _mix(np.repeat(before, length) + place.astype(np.uint64))
    return _mix(seed + so_far), _mix(seed ^ _mix(so_far + own))


def _text_pairs(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, gram) of every byte of a text, the starts of its words and the
    hashes of the words before them; the first word has zero before it."""
    code, starts = _grams(stream)
    if len(code) < 2:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.uint64))
    before = np.concatenate([np.zeros(1, np.uint64), _word_hashes(code, starts)[:-1]])
    return *_pairs(code, before, _lengths(code, starts)), starts, before


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only lower-cased, compressed streams travel to the labels."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in C.groups(batches):
        streams = [_stream(t.lower().encode()) for t in C.texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [C.column(batch, "doc_id"), pa.array([len(s) for s in streams], pa.int64()),
             pa.array([codec.compress(s, asbytes=True) for s in streams], pa.binary())],
            names=["doc_id", "size", "stream"])


class _Tally:
    """Numbers of ordinary and toxic texts per key, with what belongs to a key."""

    def __init__(self, names: list[str]):
        self.names, self.rows, self.held, self.waiting = names, [], 0, 0

    def add(self, columns: list[np.ndarray], toxic: int) -> None:
        """One text's different keys (the first column)."""
        n = np.full((2, len(columns[0])), 0, np.int64)
        n[toxic] = 1
        self.put(columns, *n)

    def put(self, columns: list[np.ndarray], n0: np.ndarray, n1: np.ndarray) -> None:
        self.rows.append([*columns, n0, n1])
        self.waiting += len(columns[0])

    def due(self) -> Iterator[pa.RecordBatch]:
        if self.waiting > max(TALLY // 2, self.held):
            self.settle()
        if self.held > TALLY:
            yield from self.out()

    def settle(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.rows, strict=True)]
        _, first, back = np.unique(columns[0], return_index=True, return_inverse=True)
        n = [np.bincount(back, c).astype(np.int64) for c in columns[-2:]]
        self.rows, self.held, self.waiting = [[*(c[first] for c in columns[:-2]), *n]], len(first), 0

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self.settle()
            arrays = [pa.array(c.view(np.int64)) for c in self.rows[0]]
            self.rows, self.held = [], 0
            yield pa.RecordBatch.from_arrays(arrays, names=[*self.names, "n0", "n1"])


def _streams(batch: pa.RecordBatch) -> Iterator[bytes]:
    codec = pa.Codec("zstd")
    for size, stream in zip(C.column(batch, "size").to_pylist(), C.column(batch, "stream").to_pylist(), strict=True):
        yield codec.decompress(stream, size, asbytes=True)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally(["code"])
    for batch in C.groups(batches, "stream", STREAM_GROUP):
        for stream, toxic in zip(_streams(batch), C.column(batch, "toxic").to_pylist(), strict=True):
            tally.add([np.unique(_grams(stream)[0])], toxic)
            yield from tally.due()
    yield from tally.out()


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the toxic texts, a row for each different gram of a text."""
    tally = _Tally(["context"])
    for batch in C.groups(batches, "stream", STREAM_GROUP):
        for stream in _streams(batch):
            context, gram, _, _ = _text_pairs(stream)
            tally.add([context[np.unique(gram, return_index=True)[1]]], 1)
            yield from tally.due()
    yield from tally.out()


def _read_filter(path: str) -> np.ndarray:
    rows = C.read_shared(path, ["at", "bits"])
    words = np.zeros(SLOTS // 64, np.uint64)
    words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


_filter = C.TaskCache(_read_filter)


def _pieces(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The given pieces of ``data``, one behind the other."""
    first = np.cumsum(size) - size
    return data[np.arange(size.sum()) + np.repeat(start - first, size)]


class _Words:
    """A tally of beginnings of words after the word before: per key the hash of that
    word, the bytes, and signed numbers of ordinary and toxic texts. They leave as one row
    of compressed columns for each part; a part holds all with a word before and a first byte."""

    def __init__(self, parts: int):
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.rows, self.data, self.bytes, self.held, self.waiting = [], [], 0, 0, 0

    def add(self, stream: bytes, columns: list[np.ndarray], weight: np.ndarray, toxic: int) -> None:
        """One text's keys; columns: key, hash of the word before, start and size in the stream."""
        key, before, start, size = columns
        n = np.zeros((2, len(key)), np.int64)
        n[toxic] = weight
        self.rows.append([key, before, start + self.bytes, size, *n])
        self.data.append(np.frombuffer(stream, np.uint8))
        self.bytes += len(stream)
        self.waiting += len(key)

    def due(self) -> Iterator[pa.RecordBatch]:
        if self.waiting > max(WORDS // 2, self.held) or self.bytes > WORD_BYTES:
            self.settle()
        if self.held > WORDS or self.bytes > WORD_BYTES // 2:
            yield from self.out()

    def settle(self) -> None:
        key, before, start, size, *n = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        n = [np.bincount(back, c).astype(np.int64) for c in n]
        size = size[first]
        data = _pieces(np.concatenate(self.data), start[first], size)
        self.rows, self.data = [[key[first], before[first], np.cumsum(size) - size, size, *n]], [data]
        self.bytes, self.held, self.waiting = len(data), len(first), 0

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self.settle()
            _, before, start, size, *n = self.rows[0]
            data = self.data[0]
            self.clear()
            home = (_mix(before ^ _mix(data[start].astype(np.uint64))) % np.uint64(self.parts)).astype(np.int64)
            order = np.lexsort((_opening(data, start, size), before, home))
            edges = np.searchsorted(home[order], np.arange(self.parts + 1))
            parts = np.flatnonzero(np.diff(edges))
            packed = []
            for part in parts:
                mine = order[edges[part]:edges[part + 1]]
                fresh = np.flatnonzero(np.append(True, np.diff(before[mine]) != 0))
                packed.append([before[mine[fresh]], np.diff(np.append(fresh, len(mine))).astype(np.int32), size[mine].astype(np.int32),
                               *(c[mine].astype(np.int32) for c in n), _pieces(data, start[mine], size[mine])])
            codec = pa.Codec("zstd", compression_level=3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int32)), pa.array([[c.nbytes for c in p] for p in packed], pa.list_(pa.int64())),
                 pa.array([[codec.compress(c.tobytes(), asbytes=True) for c in p] for p in packed], pa.list_(pa.binary()))],
                names=["part", "sizes", "packed"])


def _opening(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each piece as a number that sorts like them."""
    out = np.zeros(len(start), np.uint64)
    for i in range(8):
        here = np.where(size > i, data[np.minimum(start + i, len(data) - 1)], 0)
        out = (out << np.uint64(8)) | here.astype(np.uint64)
    return out


def _unpacked(sizes: list[int], packed: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hash of the word before, size, n0, n1) of the words of a packed row, and their bytes."""
    codec = pa.Codec("zstd")
    kinds = [np.uint64, *[np.int32] * 4, np.uint8]
    before, run, size, n0, n1, data = (np.frombuffer(codec.decompress(c, n), k)
                                       for c, n, k in zip(packed, sizes, kinds, strict=True))
    return np.repeat(before, run), size.astype(np.int64), n0.astype(np.int64), n1.astype(np.int64), data


def _beginnings(stream: bytes, asked: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A text's words after the words before them, cut behind their last context that is
    asked for, as a tree of beginnings: the columns of ``_Words.add`` and weights.

    A beginning's weight is one less the number of different next bytes, and those of
    weight zero are left out. So the weights of all that begin alike add up to one: the
    text counts once for each of its beginnings, however many words share it."""
    context, gram, starts, before = _text_pairs(stream)
    length = np.diff(np.append(starts, len(context)))
    place = np.arange(len(context)) - np.repeat(starts, length)
    on = asked[context & np.uint64(SLOTS - 1)]
    cut = np.maximum.reduceat(np.where(on, place + 1, 0), starts) if len(starts) else length
    at = np.flatnonzero(place < np.repeat(cut, length))
    key, first, back = np.unique(gram[at], return_index=True, return_inverse=True)
    longer = first[place[at[first]] > 0]              # the byte before stands just before in ``at``
    weight = 1 - np.bincount(back[longer - 1], minlength=len(key))
    told = np.flatnonzero(weight)
    at = at[first[told]]
    word = np.searchsorted(starts, at, "right") - 1
    return [key[told], before[word], starts[word] + 1, place[at] + 1], weight[told]


def _word_batches(batches: Iterator[pa.RecordBatch], path: str, parts: int) -> Iterator[pa.RecordBatch]:
    words, asked = _Words(parts), None
    for batch in C.groups(batches, "stream", STREAM_GROUP):
        asked = _filter(path) if asked is None else asked
        for stream, toxic in zip(_streams(batch), C.column(batch, "toxic").to_pylist(), strict=True):
            words.add(stream, *_beginnings(stream, asked), toxic)
            yield from words.due()
    yield from words.out()


def _part_rows(tally: _Tally) -> pa.RecordBatch | None:
    """A part's grams, with their contexts' totals where the part holds the whole context:
    only of contexts that toxic texts hold ``SHARED`` times. The first byte's context is
    spread over parts: no totals."""
    if not tally.rows:
        return None
    tally.settle()
    _, context, code, opens, n0, n1 = tally.rows[0]
    _, at = np.unique(context, return_inverse=True)
    sums = [np.bincount(at, c).astype(np.int64)[at] for c in (n0, n1, n0 > 0, n1 > 0)]
    first = opens > 0
    on = np.flatnonzero(first | (sums[1] >= SHARED))
    counts = [pa.array(c[on], pa.int64()) for c in (n0, n1)]
    totals = [pa.array(c[on], pa.int64(), mask=first[on]) for c in sums]
    keys = [pa.array(c[on].view(np.int64)) for c in (tally.rows[0][0], context, code)]
    return pa.RecordBatch.from_arrays([*keys, *counts, *totals], names=PAIR_COLUMNS)


def _pair_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows of ``_word_batches`` sorted by part; a part's words are added up one packed row at a time."""
    tally, part, asked = _Tally(["gram", "context", "code", "opens"]), None, None
    for batch in batches:
        asked = _filter(path) if asked is None else asked
        for row in range(batch.num_rows):
            here = C.column(batch, "part")[row].as_py()
            if here != part:
                done = _part_rows(tally)
                if done is not None:
                    yield done
                tally, part = _Tally(["gram", "context", "code", "opens"]), here
            before, length, n0, n1, data = _unpacked(C.column(batch, "sizes")[row].as_py(), C.column(batch, "packed")[row].as_py())
            opens = np.cumsum(length) - length
            code = np.delete(_codes(np.insert(data, opens, SPACE)), opens + np.arange(len(opens)))
            context, gram = _pairs(code, before, length)
            first = np.zeros(len(code), np.uint64)
            first[opens] = 1
            on = np.flatnonzero(asked[context & np.uint64(SLOTS - 1)])
            n = [np.repeat(c, length)[on] for c in (n0, n1)]
            tally.put([gram[on], context[on], code[on], first[on]], *n)
            if tally.waiting > max(TALLY // 2, tally.held):
                tally.settle()
    done = _part_rows(tally)
    if done is not None:
        yield done


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, size, stream, toxic) of the rows of ``docs`` that ``labels`` marks."""
    narrow = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    packed = C.map_arrow(narrow, _pack, f"doc_id {id_type}, size long, stream binary")
    return packed.join(_known(labels), "doc_id").select("doc_id", "size", "stream", "toxic")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(code, n0, n1): ordinary and toxic rows of ``_labelled`` that hold the
    gram. A word said a thousand times in one text is one observation: bursts
    would drown what texts have in common."""
    found = C.map_arrow(rows.select("size", "stream", "toxic"), _count_batches, "code long, n0 long, n1 long")
    return found.groupBy("code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def pair_counts(rows: DataFrame) -> tuple[DataFrame, str]:
    """The grams after contexts with the word before that toxic rows hold ``SHARED`` times or
    more, with their own numbers and their contexts' totals (``PAIR_COLUMNS``), and the filter
    of such contexts (a bit a slot, so some pass that do not reach it: their totals tell).

    Words, not their bytes, go from the texts to where those that begin alike meet, as many
    parts as the texts ask for; a frequent word before is dealt by the first byte that follows."""
    bulk = rows.agg(F.sum("size")).first()[0] or 0
    rows = rows.select("size", "stream", "toxic")
    seen = C.map_arrow(rows.where("toxic = 1"), _context_batches, "context long, n0 long, n1 long")
    often = seen.groupBy("context").agg(F.sum("n1").alias("n1")).where(F.col("n1") >= SHARED)
    slot = F.col("context").bitwiseAND(SLOTS - 1)
    bits = often.groupBy(F.shiftright(slot, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(context & 63 as int))")).alias("bits"))
    path = C.written(bits, "toxic-contexts")
    words = C.map_arrow(rows, partial(_word_batches, path=path, parts=int(bulk // PART_BYTES) + 1),
                        "part int, sizes array<long>, packed array<binary>")
    met = words.repartition("part").sortWithinPartitions("part")
    found = C.stage(C.map_arrow(met, partial(_pair_batches, path=path), ", ".join(f"{c} long" for c in PAIR_COLUMNS)), "pairs")
    whole, first = found.where("total1 is not null"), found.where("total1 is null")
    summed = [F.sum(c).over(_context()).alias(f"total{k}") for k, c in enumerate(("n0", "n1"))]
    kinds = [F.sum(F.signum(c).cast("long")).over(_context()).alias(f"kinds{k}") for k, c in enumerate(("n0", "n1"))]
    first = first.select("gram", "context", "code", "n0", "n1", *summed, *kinds).where(F.col("total1") >= SHARED)
    return whole.unionByName(first), path


def _known(labels: DataFrame) -> DataFrame:
    """One row per labelled document; toxic if any of its labels says so."""
    return (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
            .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))


def _context() -> Window:
    return Window.partitionBy("context")              # at most 256 rows: the next byte


def shared_backoff(counts: DataFrame) -> DataFrame:
    """(tail, p): Kneser-Ney probability of the last byte of every seven-byte
    tail, from numbers of different left neighbours, shorter tails below."""
    tails, level = [], counts.select("code")
    for size in SHORTER:
        level = C.stage(level.groupBy(F.col("code").bitwiseAND((1 << 8 * size) - 1).alias("code"))
                        .agg(F.count("*").alias("kinds")), f"tails{size}")
        tails.append(level)
    p = None
    for size, level in zip(reversed(SHORTER), reversed(tails), strict=True):
        seen = (level.withColumn("context", F.shiftrightunsigned("code", 8))
                .withColumn("total", F.sum("kinds").over(_context())).withColumn("types", F.count("*").over(_context())))
        if p is None:
            lower = seen.withColumn("low", F.lit(1 / 256))
        else:
            lower = seen.withColumn("short", F.col("code").bitwiseAND((1 << 8 * shorter) - 1)).join(
                p.select(F.col("tail").alias("short"), F.col("p").alias("low")), "short")
        p = lower.select(F.col("code").alias("tail"),
                         ((F.col("kinds") - DISCOUNT + DISCOUNT * F.col("types") * F.col("low")) / F.col("total")).alias("p"))
        shorter = size
    return p


def _with_totals(seen: DataFrame) -> DataFrame:
    """``seen`` with the totals and the numbers of different grams of its contexts, by class."""
    totals = {f"total{k}": F.sum(f"n{k}").over(_context()) for k in (0, 1)}
    return seen.withColumns(totals | {f"kinds{k}": F.sum(F.signum(f"n{k}")).over(_context()) for k in (0, 1)})


def _with_classes(seen: DataFrame, low: list) -> DataFrame:
    """``seen`` (context, n0, n1, totals and more) with each class's probability p0, p1 over what
    lies ``low``, and ``unseen``: what a byte tells that neither class has seen after the context."""
    p, empty = [], []
    for k, below in enumerate(low):
        n, total = F.col(f"n{k}"), F.col(f"total{k}")
        back = F.when(total > 0, DISCOUNT * F.col(f"kinds{k}") / total).otherwise(1.0)
        own = F.when(total > 0, F.greatest(n - DISCOUNT, F.lit(0.0)) / total).otherwise(0.0)
        p.append(own + back * below)
        empty.append(F.log(back))
    return seen.select("*", p[0].alias("p0"), p[1].alias("p1"),
                       F.least(empty[1] - empty[0], F.lit(0.0)).alias("unseen"))


def _ratio():
    return (F.log("p1") - F.log("p0")).alias("ratio")


def log_ratios(counts: DataFrame, pairs: DataFrame) -> list[DataFrame]:
    """(code, ratio) of seen grams; of their contexts what an unseen next byte
    tells; and both for the contexts with the word before."""
    seen = (counts.withColumn("context", F.shiftrightunsigned("code", 8))
            .withColumn("tail", F.col("code").bitwiseAND((1 << 8 * (ORDER - 1)) - 1)).join(shared_backoff(counts), "tail"))
    near = C.stage(_with_classes(_with_totals(seen), [F.col("p")] * 2).select("code", "context", "p0", "p1", "unseen"), "ratios")
    far = pairs.join(near.select("code", F.col("p0").alias("low0"), F.col("p1").alias("low1")), "code")
    far = C.stage(_with_classes(far, [F.col("low0"), F.col("low1")]).select("gram", "context", "p0", "p1", "unseen"), "pair-ratios")
    tables = [near.select("code", _ratio()), near.select("context", "unseen").distinct(),
              far.select("gram", _ratio()), far.select("context", "unseen").distinct()]
    return [t.toDF("code", "ratio") for t in tables]


def _shards(grams: DataFrame, bits: int) -> Shards:
    """Write (code, ratio) of every gram, dealt by code where one shard doesn't hold them,
    and then in order of code, as each group of texts reads all shards again."""
    rows = grams.select("code", F.col("ratio").cast("float").alias("ratio"))
    parts = -(-grams.count() >> bits) | 1             # an odd number: every byte of a code takes part in the remainder
    if parts == 1:
        return Shards(C.written(rows.sortWithinPartitions("code"), "toxic-grams"), 1)
    path = C.fresh_path(grams.sparkSession, "toxic-grams")
    dealt = rows.withColumn("shard", F.pmod("code", F.lit(parts)))
    dealt.repartition(parts, "shard").sortWithinPartitions("shard", "code").write.mode("error").partitionBy("shard").parquet(path)
    return Shards(path, parts)


@dataclass(frozen=True)
class Shards:
    """Where a table of ratios stands, and in how many shards."""

    path: str
    parts: int

    def look(self, code: np.ndarray) -> np.ndarray:
        """The ratio of each code; NaN where the table does not have it. The table passes by
        in batches, each in order of code: a task holds none of it."""
        asked, back = np.unique(code.view(np.int64), return_inverse=True)
        out = np.full(len(asked), np.nan, np.float32)
        for batch in C.shared_batches(self.path, ["code", "ratio"]) if len(asked) else ():
            codes, ratios = (C.column(batch, c).to_numpy() for c in ("code", "ratio"))
            if len(codes):
                first, last = np.searchsorted(asked, codes[0]), np.searchsorted(asked, codes[-1], "right")
                at = np.searchsorted(codes, asked[first:last])
                hit = np.flatnonzero(codes[at] == asked[first:last])
                out[first + hit] = ratios[at[hit]]
        return out[back]


def _mean_ratio(logs: np.ndarray) -> float:
    """Logarithm of the mean of likelihood ratios given as logarithms."""
    top = logs.max()
    return float(top + np.log(np.exp(logs - top).mean()))


def _joined(pieces: list[np.ndarray]) -> np.ndarray:
    """The pieces as one array; the list is emptied."""
    out = np.concatenate(pieces)
    pieces.clear()
    return out


@dataclass(frozen=True)
class Model:
    """Where the tables and the filter of contexts stand; tasks read them
    there, so nothing of them passes through the driver."""

    tables: tuple[Shards, ...]
    contexts: str

    def _look(self, code: np.ndarray, table: int) -> np.ndarray:
        return self.tables[table].look(code)

    def _across(self, code, starts, ratio, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whole log-ratio of each of the given words after the hash of the word before it.
        Hashes are formed ``PAIRS`` words at a time; the tables are asked once."""
        asked = _filter(self.contexts)
        sizes, out, found = _lengths(code, starts), [], ([], [], [], [])
        for part in range(0, len(word), PAIRS):
            mine = word[part:part + PAIRS]
            length = sizes[mine]
            first = np.cumsum(length) - length
            at = np.arange(length.sum()) - np.repeat(first - starts[mine], length)
            context, gram = _pairs(code[at], before[part:part + PAIRS], length)
            on = np.flatnonzero(asked[context & np.uint64(SLOTS - 1)])
            own = ratio[at]
            out.append(np.add.reduceat(own, first, dtype=np.float64))
            home = (part + np.searchsorted(first, on, "right") - 1).astype(np.int32)
            for pieces, piece in zip(found, (gram[on], context[on], own[on], home), strict=True):
                pieces.append(piece)
        gram, context, own, home = (_joined(pieces) for pieces in found)
        told = self._look(gram, 2)
        del gram
        new = np.flatnonzero(np.isnan(told))
        told -= own
        told[new] = np.nan_to_num(self._look(context[new], 3))
        return np.concatenate(out) + np.bincount(home, told, len(word))

    def evidence(self, streams: list[bytes]) -> np.ndarray:
        """Per stream: the length-normalised log-ratio of the whole text with and
        without the word before as context, and the logarithm of the words'
        mean likelihood ratio, likewise. Streams without a word: zeros."""
        out = np.zeros((len(streams), len(EVIDENCE)))
        known: dict[bytes, int] = {}
        held = [np.array([known.setdefault(w, len(known)) for w in stream.split()], np.int64) for stream in streams]
        if not known:
            return out
        code, starts = _grams(b" " + b" ".join(known) + b" ")
        ratio = self._look(code, 0)
        new = np.flatnonzero(np.isnan(ratio))
        ratio[new] = np.nan_to_num(self._look(code[new] >> np.uint64(8), 1))
        within, length = np.add.reduceat(ratio, starts, dtype=np.float64), _lengths(code, starts)
        hashes = np.append(_word_hashes(code, starts), np.uint64(0))       # the last one stands before a text
        word = np.concatenate(held)
        before = np.concatenate([np.append(-1, h[:-1]) if len(h) else h for h in held]) % len(hashes)
        pair, back = np.unique(before * len(known) + word, return_inverse=True)
        across = self._across(code, starts, ratio, hashes[pair // len(known)], pair % len(known))[back]
        stop = 0
        for i, words in enumerate(held):
            if len(words):
                far, stop = across[stop:stop + len(words)], stop + len(words)
                size = length[words].sum()
                out[i] = far.sum() / size, within[words].sum() / size, _mean_ratio(far), _mean_ratio(within[words])
        return out


def _evidence_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in C.groups(batches):
        found = model.evidence([_stream(t.lower().encode()) for t in C.texts(batch)])
        yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), *(pa.array(found[:, i]) for i in range(len(EVIDENCE)))],
                                         names=["doc_id", *EVIDENCE])
        C.give_back()


def _stream_evidence(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in C.groups(batches, "stream", STREAM_GROUP):
        found = model.evidence(list(_streams(batch)))
        yield pa.RecordBatch.from_arrays(
            [C.column(batch, "doc_id"), C.column(batch, "toxic"), *(pa.array(found[:, i]) for i in range(len(EVIDENCE)))],
            names=["doc_id", "toxic", *EVIDENCE])
        C.give_back()


def _sets_curve():
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("curve")), F.lit(CURVE_SHARE)) == 0


def fit(docs: DataFrame, labels: DataFrame, bits: int = 21) -> Model:
    """The model from the rows of ``docs`` that ``labels`` marks, the curve's share left out."""
    rows = C.stage(_labelled(docs.where("doc_id is not null").where(~_sets_curve()), labels), "labelled")
    pairs, contexts = pair_counts(rows)
    tables = log_ratios(C.stage(gram_counts(rows), "grams"), pairs)
    return Model(tuple(_shards(t, bits) for t in tables), contexts)


def curve(x: np.ndarray, toxic: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic curve over the evidence, the last one its shift."""
    flat = np.zeros(x.shape[1] + 1)
    if not toxic.any() or toxic.all():
        flat[-1] = 20.0 if len(toxic) and toxic.all() else -20.0
        return flat
    centre, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    beta, penalty = flat, ridge * len(x) * np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(rounds):                           # Newton's method on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - toxic) + penalty * beta)
        beta = beta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    weights = beta[:-1] / scale
    return np.append(weights, beta[-1] - (weights * centre).sum())


def score(docs: DataFrame, learn_docs: DataFrame, labels: DataFrame, bits: int = 21, rows: int = 50_000) -> DataFrame:
    """(doc_id, score, predicted) and the evidence for every row of ``docs``.

    Learns from the rows of ``learn_docs`` that ``labels`` marks; the curve is
    set on about ``rows`` rows of its share at most (by the hash of the id). Null, empty and blank texts have no evidence (zeros). Without a
    toxic or without an ordinary label every score is near 0 or near 1. An
    empty table gives an empty result; texts of any length are scored whole.
    Repeated rows and null ids stay; other columns are not read.
    """
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    model = fit(learn_docs, labels, bits)
    columns = ", ".join(f"{c} double" for c in EVIDENCE)
    share = _labelled(learn_docs.where("doc_id is not null").where(_sets_curve()), labels)
    seen = C.map_arrow(share, partial(_stream_evidence, model=model), f"doc_id {id_type}, toxic int, {columns}")
    picked = C.bounded_sample(C.stage(seen, "curve"), rows, seed=5).select("toxic", *EVIDENCE).toPandas()
    weights = curve(picked[EVIDENCE].to_numpy(float), picked["toxic"].to_numpy() == 1)
    raw = C.map_arrow(narrow, partial(_evidence_batches, model=model), f"doc_id {id_type}, {columns}")
    line = sum((F.lit(float(w)) * F.col(c) for w, c in zip(weights, EVIDENCE, strict=False)), F.lit(float(weights[-1])))
    value = 1 / (1 + F.exp(-line))
    return raw.select("doc_id", value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), *EVIDENCE)


def keep_ordinary(docs: DataFrame, learn_docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents predicted toxic. A row without a doc_id stays."""
    bad = score(docs, learn_docs, labels, **how).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))

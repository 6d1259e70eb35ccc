"""Phrase collocations: counts of word sequences from partitioned suffix subtrees.

The corpus is a string of words; a phrase's count is the number of suffixes
that begin with it. Suffixes are cut at ``depth`` words and partitioned by
their prefixes, so that each part fits a memory budget:

1. Prefixes of one, two and three words are counted in turn (``_level``). What
   is rarer than ``least`` ends a suffix, since no phrase of interest holds it.
2. A prefix of two words with more suffixes than the budget is extended by a
   word, level by level, until its parts fit.
3. The prefixes are grouped by a running sum of their sizes (``_groups``); each
   group's suffixes go to one task, which sorts them into a subtree: rows with
   the same first d words are a node of depth d, and its count is the sum of
   its leaves (``subtree``). Groups are built independently.

Prefixes are counted by hash slots: a task sends the slots it met, sorted, as
differences, and a range of slots is added up in one array. What the scans get
back has a fixed size (a bit per slot, a group per range of slots). Prefixes
that share a slot can let a rare suffix through, which the subtree's own counts
then drop: counts, candidates and scores come from the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.llm import common as C
from churnkit.session import ship_package

WORD, GAP, BREAK = 0, 1, 2
#: A-Z become a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Blank and tab part words; these and line ends part pieces, which phrases don't cross.
KIND = np.array([BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else GAP if chr(b) in " \t" else WORD for b in range(256)], np.uint8)
GROUP = 16 << 20
SALTS = 256
MIX = np.uint64(0x9E3779B97F4A7C15)   # odd, bits well spread
UNKNOWN = "und"
PARTS_BITS = 10                       # slots are added up in so many ranges (as a power of two)
CELL_BITS = 16                        # prefixes are grouped by so many ranges of slots
WAITING = 4_000_000                   # different slots, words or suffixes that a task holds
PACKED = 100_000                      # suffixes in one compressed table
SLOTS = "part long, slots binary, counts binary, words binary"
COUNTED = "lang string, word string, n long"
SUMMED = "part long, mask binary, hot binary, sizes binary, n long"
LEAVES = "group long, packed binary"
LEAF = ["group", "depth", "total", "lang", "phrase"]
LEAF_SCHEMA = pa.schema([("group", pa.int64()), ("depth", pa.int64()), ("total", pa.bool_()), ("lang", pa.string()),
                         ("phrase", pa.string()), ("n", pa.int64())])
COUNTED_SCHEMA = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


class Words:
    """The words of a group of texts: ``codes`` into ``dictionary``, the
    language code of each, and whether the next word follows in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        texts = C.utf8(batch)
        data = np.frombuffer(b"\n".join([*texts, b""]).translate(LOWER), np.uint8)
        kind = KIND[data]
        inside = kind == WORD
        starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        stops = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
        edges = np.append(0, np.cumsum(stops - starts)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.dictionary = coded.dictionary
        breaks = np.cumsum(kind == BREAK)[starts]
        self.follows = np.append(breaks[1:] == breaks[:-1], False)[:len(starts)]
        langs = C.column(batch, "lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.lang = langs.indices.to_numpy().astype(np.int64)[np.searchsorted(ends, starts, side="right")]

    def counted(self, frequent: np.ndarray) -> pa.RecordBatch:
        """(lang, word, n) of the frequent words, and of each language's words together (word null)."""
        size = len(self.dictionary)
        keys, n = np.unique((self.lang * size + self.codes)[frequent], return_counts=True)
        langs, all_n = np.unique(self.lang, return_counts=True)
        words = pa.concat_arrays([self.dictionary.cast(pa.string()).take(pa.array(keys % size)), pa.nulls(len(langs), pa.string())])
        which = pa.array(np.append(keys // size, langs))
        return pa.RecordBatch.from_arrays([pa.array(self.langs, pa.string()).take(which), words, pa.array(np.append(n, all_n))],
                                          names=["lang", "word", "n"])

    def hashes(self) -> np.ndarray:
        """64-bit hash of each occurrence's (language, word)."""
        word = np.array([xxhash.xxh64_intdigest(w, 42) for w in self.dictionary.to_pylist()], np.uint64)
        lang = np.array([xxhash.xxh64_intdigest(x, 7) for x in self.langs], np.uint64)
        return word[self.codes] ^ (lang[self.lang] * MIX) if len(self.codes) else np.empty(0, np.uint64)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a prefix and one more word."""
    h = (left ^ (left >> np.uint64(29))) * MIX + right
    return (h ^ (h >> np.uint64(32))) * MIX


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, so that small ones compress to little."""
    values = values.astype("<u8")
    return values.view(np.uint8).reshape(len(values), 8).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


class SlotCounts:
    """How often a task met each slot."""

    def __init__(self, bits: int):
        self.bits = bits
        self.slots, self.counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

    def add(self, hashes: np.ndarray) -> None:
        slots, n = np.unique(hashes >> np.uint64(64 - self.bits), return_counts=True)
        self.slots.append(slots)
        self.counts.append(n)

    @property
    def waiting(self) -> int:
        return sum(map(len, self.slots))

    def flush(self) -> pa.RecordBatch:
        """A row per range of slots: the slots as differences, and their counts."""
        slots, where = np.unique(np.concatenate(self.slots), return_inverse=True)
        counts = np.zeros(len(slots), np.int64)
        np.add.at(counts, where, np.concatenate(self.counts))
        self.__init__(self.bits)
        part = (slots >> np.uint64(max(self.bits - PARTS_BITS, 0))).astype(np.int64)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        cuts = [*zip(first, np.append(first[1:], len(slots)), strict=False)]        # none where nothing was met
        return pa.RecordBatch.from_arrays(
            [pa.array(part[first]), pa.array([_planes(np.diff(slots[a:b], prepend=np.uint64(0))) for a, b in cuts], pa.binary()),
             pa.array([_planes(counts[a:b]) for a, b in cuts], pa.binary())], names=["part", "slots", "counts"])


class Summed:
    """Counts of a task's rows, added up over its groups of texts."""

    def __init__(self, keys: list[str]):
        self.keys, self.rows = keys, []

    def add(self, batch: pa.RecordBatch) -> None:
        self.rows.append(pa.Table.from_batches([batch]))

    @property
    def waiting(self) -> int:
        return sum(t.num_rows for t in self.rows)

    def flush(self, schema: pa.Schema) -> pa.Table:
        if not self.rows:
            return schema.empty_table()
        summed = pa.concat_tables(self.rows).group_by(self.keys).aggregate([("n", "sum")])
        self.rows = []
        return summed.rename_columns([*self.keys, "n"])


class Level:
    """What the counts of all prefixes of one length come to: which slots are
    frequent (a bit each), which exceed the budget, and the sizes of ranges."""

    def __init__(self, rows: list, bits: int):
        self.shift = np.uint64(64 - bits)
        width = 1 << max(bits - PARTS_BITS, 0)
        self.mask = np.zeros(max((1 << bits) // 8, 1), np.uint8)
        self.sizes = np.zeros(1 << min(bits, CELL_BITS), np.int64)
        hot, self.n = [np.empty(0, np.uint64)], 0
        cells = max(len(self.sizes) * width >> bits, 1)
        for row in rows:
            at = row["part"] * width // 8
            self.mask[at:at + len(row["mask"])] |= np.frombuffer(row["mask"], np.uint8) << np.uint8(row["part"] * width % 8)
            at = row["part"] * cells
            self.sizes[at:at + cells] = np.frombuffer(row["sizes"], np.int64)
            hot.append(np.frombuffer(row["hot"], np.uint64))
            self.n += row["n"]
        self.hot = np.sort(np.concatenate(hot))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.mask[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def exceeds(self, hashes: np.ndarray) -> np.ndarray:
        return np.isin(hashes >> self.shift, self.hot) if len(self.hot) else np.zeros(len(hashes), bool)


def _sum_batches(batches: Iterator[pa.RecordBatch], least: int, budget: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Add up the slots of one range after the other (rows come sorted by range)."""
    width = 1 << max(bits - PARTS_BITS, 0)
    cells = max((1 << min(bits, CELL_BITS)) * width >> bits, 1)
    current, counts = None, np.zeros(width, np.int64)

    def result() -> pa.RecordBatch:
        known = counts >= least
        hot = np.flatnonzero(counts > budget) + current * width
        sizes = np.where(known & (counts <= budget), counts, 0).reshape(cells, -1).sum(axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array([current], pa.int64()), pa.array([np.packbits(known, bitorder="little").tobytes()], pa.binary()),
             pa.array([hot.astype(np.uint64).tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()),
             pa.array([int(counts.sum())], pa.int64())], names=["part", "mask", "hot", "sizes", "n"])

    for batch in batches:
        for part, slots, n in zip(*(C.column(batch, c).to_pylist() for c in ("part", "slots", "counts")), strict=True):
            if part != current:
                if current is not None:
                    yield result()
                current, counts = part, np.zeros(width, np.int64)
            counts[np.cumsum(_numbers(slots)).astype(np.int64) - part * width] += _numbers(n).astype(np.int64)
    if current is not None:
        yield result()


def _level(slots: DataFrame, least: int, budget: int, bits: int) -> Level:
    """At most 2**PARTS_BITS rows reach the driver, 2**bits bits in all."""
    dealt = slots.select("part", "slots", "counts").repartition("part").sortWithinPartitions("part")
    return Level(C.map_arrow(dealt, partial(_sum_batches, least=least, budget=budget, bits=bits), SUMMED).collect(), bits)


class Suffixes:
    """The suffixes of a group of texts: at each place how many words it has,
    cut at ``depth`` words, piece ends and what the ``levels`` know as rare."""

    def __init__(self, words: Words, levels: list[Level], depth: int):
        self.words, self.depth = words, depth
        self.h = words.hashes()
        known = levels[0].has(self.h) if levels else np.ones(len(self.h), bool)
        link = words.follows & known
        link[:-1] &= known[1:]
        self.pair = np.zeros(len(self.h), np.uint64)
        self.pair[:-1] = mixed(self.h[:-1], self.h[1:])
        self.length = known.astype(np.int64)
        inside = [link & level.has(self.prefix(d)) for d, level in enumerate(levels[1:], 2)]   # the first d words are frequent
        run = known.copy()
        for d in range(2, depth + 1):
            run &= self._ahead(link, d - 2)
            for m, frequent in enumerate(inside, 2):  # all its parts of m words are
                if m <= d:
                    run &= self._ahead(frequent, d - m)
            self.length += run

    @staticmethod
    def _ahead(values: np.ndarray, k: int) -> np.ndarray:
        """Each place's value ``k`` words on."""
        return np.append(values[k:], np.zeros(min(k, len(values)), values.dtype))

    def prefix(self, d: int) -> np.ndarray:
        """The hash of each place's first ``d`` words."""
        if d == 1:
            return self.h
        h = self.pair
        for k in range(2, d):
            h = mixed(h, self._ahead(self.h, k))
        return h


def _prefix_batches(batches: Iterator[pa.RecordBatch], sent, d: int, depth: int, bits: int,
                    with_words: bool = False) -> Iterator[pa.RecordBatch]:
    """Slots of the prefixes of ``d`` words; with ``large`` only of those whose
    shorter prefixes all exceed the budget. ``with_words`` adds the counts of
    the frequent words, and of all words of a language (word null)."""
    levels, large = sent.value
    slots, counted = SlotCounts(bits), Summed(["lang", "word"])
    for batch in C.groups(batches, limit=GROUP):
        words = Words(batch)
        own = Suffixes(words, levels, depth)
        at = own.length >= d
        for m, level in large.items():
            at &= level.exceeds(own.prefix(m))
        slots.add(own.prefix(d)[at])
        if slots.waiting > WAITING:
            yield from _both(slots.flush())
        if with_words and len(words.codes):
            counted.add(words.counted(own.length > 0))
            if counted.waiting > WAITING:
                yield from _both(words=counted.flush(COUNTED_SCHEMA))
    yield from _both(slots.flush(), counted.flush(COUNTED_SCHEMA))


def _both(slots: pa.RecordBatch | None = None, words: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
    """Slots, or word counts packed by the word's hash, as rows of one table."""
    if slots is not None:
        yield pa.RecordBatch.from_arrays([*slots.columns, pa.nulls(slots.num_rows, pa.binary())],
                                         names=["part", "slots", "counts", "words"])
    if words is not None and words.num_rows:
        known = words.column("word").fill_null("").cast(pa.binary()).to_pylist()
        part = pa.array([xxhash.xxh64_intdigest(w, 42) >> 64 - PARTS_BITS for w in known], pa.int64())
        for batch in _packed(words.append_column("group", part), ["group", "lang", "word"]):
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("group"), none, none, batch.column("packed")],
                                             names=["part", "slots", "counts", "words"])


def _unpacked(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up packed word counts, one part after the other (rows come sorted by part)."""
    current, summed = None, Summed(["lang", "word"])
    for batch in batches:
        for part, blob in zip(C.column(batch, "part").to_pylist(), C.column(batch, "words"), strict=True):
            if part != current:
                yield from summed.flush(COUNTED_SCHEMA).to_batches()
                current = part
            for rows in _unpacked(blob).to_batches():
                summed.add(rows)
            if summed.waiting > WAITING:
                for rows in summed.flush(COUNTED_SCHEMA).to_batches():
                    summed.add(rows)
    yield from summed.flush(COUNTED_SCHEMA).to_batches()


def _suffix_batches(batches: Iterator[pa.RecordBatch], sent, depth: int) -> Iterator[pa.RecordBatch]:
    """The different suffixes of two words or more in a task's texts, with
    their counts, packed by the group of their prefix. A prefix over the budget
    gives a leaf of its own (``total``) and passes on its longer suffixes."""
    levels, large, group_of = sent.value
    summed = Summed(LEAF)
    for batch in C.groups(batches, limit=GROUP):
        own = Suffixes(Words(batch), levels, depth)
        left = np.flatnonzero(own.length >= 2)
        for d in range(2, depth + 1):
            h = own.prefix(d)[left]
            big = large[d].exceeds(h) if d in large else np.zeros(len(h), bool)
            group = group_of[(h >> np.uint64(65 - len(group_of).bit_length())).astype(np.int64)]
            for leaves in (_leaves(own, left[~big], group[~big], d, own.length[left[~big]], False),
                           _leaves(own, left[big], group[big], d, np.full(int(big.sum()), d), True)):
                if leaves is not None:
                    summed.add(leaves)
            left = left[big]
            left = left[own.length[left] > d]
            if not len(left):
                break
        if summed.waiting > WAITING:
            yield from _packed(summed.flush(LEAF_SCHEMA), LEAF)
    yield from _packed(summed.flush(LEAF_SCHEMA), LEAF)


def _packed(rows: pa.Table, order: list[str]) -> Iterator[pa.RecordBatch]:
    """A row per group: its rows in order, as compressed Arrow tables of at most ``PACKED`` rows."""
    if not rows.num_rows:
        return
    rows = rows.sort_by([(c, "ascending") for c in order])
    group = rows.column("group").to_numpy()
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    for a, b in zip(first, np.append(first[1:], len(group)), strict=True):
        for at in range(int(a), int(b), PACKED):
            own = rows.slice(at, min(PACKED, int(b) - at)).drop_columns(["group"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(own)
            yield pa.RecordBatch.from_arrays([pa.array([int(group[a])]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                             names=["group", "packed"])


def _leaves(own: Suffixes, at: np.ndarray, group: np.ndarray, depth: int, length: np.ndarray,
            total: bool) -> pa.RecordBatch | None:
    """The different suffixes at the given places, cut at ``length`` words."""
    if not len(at):
        return None
    codes = own.words.codes
    cells = np.full((own.depth + 1, len(at)), -1, np.int64)
    cells[0] = own.words.lang[at]
    for k in range(own.depth):
        here = length > k
        cells[k + 1, here] = codes[at[here] + k]
    order = np.lexsort(cells[::-1])
    cells = cells[:, order]
    first = np.flatnonzero(np.append(True, (cells[:, 1:] != cells[:, :-1]).any(axis=0)))
    n = np.diff(np.append(first, len(at)))
    cells, sizes = cells[:, first], length[order][first]
    rows = cells[1:].T
    words = own.words.dictionary.cast(pa.string()).take(pa.array(rows[rows >= 0]))
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), words)
    return pa.RecordBatch.from_arrays(
        [pa.array(group[order][first]), pa.array(np.full(len(first), depth)), pa.array(np.full(len(first), total)),
         pa.array(own.words.langs, pa.string()).take(pa.array(cells[0])), pc.binary_join(listed, " "), pa.array(n)],
        names=[*LEAF, "n"])


def subtree(rows: pa.Table, least: int) -> pa.Table:
    """Nodes of the subtree of one group's suffixes: every (lang, phrase of two
    words or more) with at least ``least`` suffixes below it, its length and
    count. A prefix longer than two words has nodes from its own length on; the
    totals of prefixes over the budget are apart from other suffixes.
    """
    rows = rows.combine_chunks()
    chunk = pc.split_pattern(C.single(rows.column("phrase")), " ")       # words hold no blank
    sizes = np.diff(chunk.offsets.to_numpy())
    coded = chunk.flatten().dictionary_encode()
    langs = C.single(rows.column("lang")).dictionary_encode()
    depth = int(sizes.max(initial=0))
    cells = np.full((depth + 1, len(sizes)), -1, np.int64)
    n, skip = rows.column("n").to_numpy(), rows.column("depth").to_numpy()
    apart = np.where(C.single(rows.column("total")).to_numpy(zero_copy_only=False), skip, 0)   # totals, by their length
    kinds = int(skip.max(initial=0)) + 1
    cells[0] = kinds * langs.indices.to_numpy().astype(np.int64) + apart
    place = np.arange(len(coded)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cells[place + 1, np.repeat(np.arange(len(sizes)), sizes)] = coded.indices.to_numpy()
    order = np.lexsort(cells[::-1])
    cells, n, sizes, skip = cells[:, order], n[order], sizes[order], skip[order]
    differs = np.ones(len(n), bool)                   # at depth d: the first d words are not the row's before
    differs[1:] = cells[0, 1:] != cells[0, :-1]
    lang, phrase, length, count = [], [], [], []
    for d in range(1, depth + 1):
        differs[1:] |= cells[d, 1:] != cells[d, :-1]
        if d < 2:
            continue
        first = np.flatnonzero(differs)
        below = np.add.reduceat(n, first)
        own = (sizes[first] >= d) & (below >= least) & (skip[first] <= d)
        at = first[own]
        words = [coded.dictionary.take(pa.array(cells[k, at])) for k in range(1, d + 1)]
        phrase.append(pc.binary_join_element_wise(*words, " "))
        lang.append(langs.dictionary.take(pa.array(cells[0, at] // kinds)))
        length.append(np.full(len(at), d))
        count.append(below[own])
    return pa.table({"lang": pa.chunked_array(lang, pa.string()), "phrase": pa.chunked_array(phrase, pa.string()),
                     "length": pa.array(np.concatenate([np.zeros(0, np.int64), *length])),
                     "n": pa.array(np.concatenate([np.zeros(0, np.int64), *count]))})


def _builder(least: int):
    def build(rows: pa.Table) -> pa.Table:
        packed = [_unpacked(blob) for chunk in rows.column("packed").chunks for blob in chunk]
        summed = pa.concat_tables(packed).group_by(LEAF[1:]).aggregate([("n", "sum")])
        return subtree(summed.rename_columns([*LEAF[1:], "n"]), least)
    return build


def _groups(levels: list[Level], budget: int) -> np.ndarray:
    """The group of each range of slots: ranges in order, a new group where the budget is full."""
    sizes = sum(level.sizes for level in levels)
    return (np.cumsum(sizes) - sizes) // budget


def phrase_counts(docs: DataFrame, least: int = 100, depth: int = 5, budget: int = 500_000,
                  bits: int = 27) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three staged tables: (lang, n) of all words; (lang, phrase, n) of the
    words, and (lang, phrase, length, n) of the phrases of 2 to ``depth`` words,
    that occur at least ``least`` times."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    narrow = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                         F.col("text").cast("string").alias("text")).where("text is not null")

    def scan(d: int, known: list[Level], large: dict[int, Level], with_words: bool = False) -> DataFrame:
        return C.map_arrow(narrow, partial(_prefix_batches, sent=sc.broadcast((known, large)), d=d, depth=depth, bits=bits,
                                           with_words=with_words), SLOTS)

    levels = [_level(scan(1, [], {}), least, 1 << 62, bits)]
    budget = max(budget, levels[0].n >> 16)           # at most 2**16 prefixes of a length exceed it
    counted = C.stage(scan(2, levels, {}, with_words=True), "pairs")
    levels.append(_level(counted.where("slots is not null"), least, budget, bits))
    if depth > 2:
        levels.append(_level(scan(3, levels, {}), least, 1 << 62, bits))
    parts, large = [levels[1]], {2: levels[1]}
    while len(large[max(large)].hot) and max(large) < depth:
        d = max(large) + 1
        large[d] = _level(scan(d, levels, large), least, budget, bits)
        parts.append(large[d])
    sent = sc.broadcast((levels, large, _groups(parts, budget)))
    leaves = C.map_arrow(narrow, partial(_suffix_batches, sent=sent, depth=depth), LEAVES)
    ship_package(spark)
    nodes = leaves.groupBy("group").applyInArrow(_builder(least), "lang string, phrase string, length long, n long")
    dealt = counted.where("words is not null").select("part", "words").repartition("part").sortWithinPartitions("part")
    words = C.map_arrow(dealt, _word_batches, COUNTED)
    words = C.stage(words.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    return (words.where("word is null").select("lang", "n"),
            words.where("word is not null").select("lang", F.col("word").alias("phrase"), "n"), C.stage(nodes, "phrases"))


def _cuts(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase with l, r and score of its lowest-scoring cut."""
    counts = words.unionByName(phrases.select("lang", "phrase", "n"))
    part = F.split("phrase", " ", -1)
    cut = phrases.select("lang", "phrase", F.col("n").alias("a"), part.alias("w"),
                         F.explode(F.sequence(F.lit(1), F.col("length").cast("int") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                     F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    cut = cut.join(totals, "lang")
    wide = "decimal(18,0)"
    above = (1000 * F.col("a")).cast("decimal(19,0)") * F.col("n").cast(wide)
    score = F.call_function("div", above, F.col("l").cast(wide) * F.col("r").cast(wide))
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cut.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")


def _covered(phrases: DataFrame, share: int) -> DataFrame:
    """Phrases that lie inside a longer one which has ``share`` of a hundred of their count."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length").cast("int") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    longer = phrases.where("length > 2").withColumn("w", F.split("phrase", " ", -1))
    most = longer.select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return most.join(phrases, ["lang", "phrase"]).where(100 * F.col("longer") >= share * F.col("n")).select("lang", "phrase")


def _ranked(df: DataFrame, order: list[Column], top: int) -> DataFrame:
    """Each language's first ``top`` rows and their rank: first within salted
    shares of the language, then over what these keep."""
    shares = Window.partitionBy("lang", "salt").orderBy(*order)
    first = (df.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
             .withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= top))
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .where(F.col("rank") <= top).drop("salt"))


def collocations(docs: DataFrame, least: int = 100, depth: int = 5, share: int = 100, top: int = 2000,
                 budget: int = 500_000, bits: int = 27) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases
    of 2 to ``depth`` words that occur ``least`` times or more.

    ``a`` is the phrase's count, ``n`` the language's words, ``l`` and ``r``
    the counts of the parts at the cut with the lowest score floor(1000 a n /
    (l r)) (of equal ones the first). Phrases inside a longer candidate with
    ``share`` of a hundred of their count go. Order: score and count falling,
    phrase rising by bytes. Null lang is ``und``; null, empty and wordless
    texts add nothing; long texts count whole; repeated rows count each. An
    empty table gives an empty result; other columns are not read. ``budget``
    is the number of suffixes a task builds a subtree from, ``2**bits`` the
    number of hash slots; neither changes the result.
    """
    totals, words, phrases = phrase_counts(docs, least, depth, budget, bits)
    kept = _cuts(phrases, words, totals).join(_covered(phrases, share), ["lang", "phrase"], "left_anti")
    ranked = _ranked(kept, [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

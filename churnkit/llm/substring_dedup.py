"""Exact substring dedup over a sparse, distributed suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Ranks double as in suffix-array construction: the
rank of 8 bytes is their value, ranks of 24 and of ``length`` bytes come from
the pair of ranks at a growing offset. Spark deals (rank, position) pairs by
rank, sorts them, and what is unique or settled drops out before the next
offset:

1. Positions are thinned first, without losing a match: of the 24-byte ranks
   inside a window of ``length`` bytes the smallest is the window's anchor,
   so equal windows have equal anchors. Neighbouring windows with one anchor
   make a unit (about one unit for 13 positions), known by the rank of its
   whole stretch. Pairs (anchor rank, unit rank) are sorted; a unit that also
   occurs in a smaller document is settled at once (this covers the inside of
   every repeat). Anchors that are unique, or always in the same unit, drop out.
2. For what is left, the edges of repeats, the rank of every single window of
   ``length`` bytes is sorted, and the smallest document of each rank found.

Ranks are 64-bit mixes (104 bits for a unit, 80 for a window, next to the
bucket they are dealt by), so equality is by fingerprint.

Documents are worked on in blocks of a task's input. A block sends one entry
per different rank, with its smallest doc_id, so a string that a third of all
documents hold costs one entry a block. What comes back is one or two bits an
entry, in the order sent, in a table in the shared folder; the block reads it
when the input is scanned again. A block's name holds a checksum of its
documents: should the input ever be cut differently on a rescan, the table has
no such name and the task fails rather than use other bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm import common as C

ANCHOR = 24                           # bytes whose rank picks anchors
LAST = np.int64(2**63 - 1)            # stands for a null doc_id: no document is larger
GROUP = 1 << 19                       # bytes hashed at once
BLOCK = 4 << 20                      # bytes of text whose entries are sent together
BUCKET_BYTES = 8 << 20               # bytes of text for each bucket
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
TOP = 20                              # bits of a key that decide its bucket
MESSAGE = "part int, block string, bucket int, n long, payload binary"
REPLY = "part int, block string, bucket int, n long, late binary, open binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * M1
    x ^= x >> np.uint64(29)
    x *= M2
    x ^= x >> np.uint64(32)
    return x


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[:-(width - span)], v[width - span:]) if span < width else v


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    size = 1 << max(20, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        base = 0xD1342543DE82EF95
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


class Units:
    """Units of a group of documents (one buffer): first and last window start,
    anchor rank, rank of the whole stretch, document."""

    def __init__(self, texts: list[bytes], length: int):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        data = b"".join(texts) + b"\0" * length
        n = int(self.sizes.sum())
        self.rank8 = np.ndarray(n + length - 7, "<u8", data, 0, (1,))
        m = _mix(self.rank8)
        anchor = _mix(m[:-16] + m[8:-8] * M1 + m[16:] * M2)
        bits = np.uint64(max(22, n.bit_length()))      # positions take the low bits, so ties go to the left
        low = (np.uint64(1) << bits) - np.uint64(1)
        order = (anchor & ~low) | np.arange(len(anchor), dtype=np.uint64)
        best = _sliding_min(order, length - ANCHOR + 1)
        counts = np.maximum(self.sizes - length + 1, 0)
        document = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        starts = np.arange(counts.sum()) + np.repeat(self.begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        at = (best[starts] & low).astype(np.int64)
        edge = np.append(True, at[1:] != at[:-1]) if len(at) else np.empty(0, bool)
        first = np.flatnonzero(edge)
        self.low = starts[first]
        self.high = starts[np.append(first[1:], len(starts)) - 1] if len(first) else self.low
        self.document = document[first]
        self.anchor = anchor[at[first]]
        power, inverse = _powers(len(m) + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m * power[:len(m)])])
        stretch = (prefix[self.high + length - 7] - prefix[self.low]) * inverse[self.low]
        where = (at[first] - self.low) * 256 + (self.high - self.low)
        self.rank = _mix(stretch + where.astype(np.uint64) * M1)
        self.length = length

    def windows(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, documents and both ranks of every single window of the given units."""
        n = self.high[units] - self.low[units] + 1
        start = np.arange(n.sum()) + np.repeat(self.low[units] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        a = np.zeros(len(start), np.uint64)
        b = np.zeros(len(start), np.uint64)
        for k in [*range(0, self.length - 8, 8), self.length - 8]:
            part = _mix(self.rank8[start + k])
            a = a * M1 + part
            b = (b ^ part) * M2 + np.uint64(k)
        return start, np.repeat(self.document[units], n), _mix(a), _mix(b) & np.uint64(0xFFFF)


class Block:
    """What one block sends: its different keys in order, the smallest doc_id of
    each, and for every row the place of its key."""

    def __init__(self, key: np.ndarray, extra: list[np.ndarray], doc_id: np.ndarray):
        order = np.argsort(key)
        cols = [c[order] for c in (key, *extra)]
        new = np.zeros(len(order), bool)
        if len(order):
            new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        self.key, *self.extra = (c[first] for c in cols)
        ids = doc_id[order]
        self.doc_id = np.minimum.reduceat(ids, first) if len(first) else ids
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1


def _planes(values: np.ndarray, width: int = 8) -> bytes:
    """The bytes of the values, all first bytes, then all second ones: equal high bytes compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: memoryview, n: int, width: int = 8) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[str, list[tuple[pa.RecordBatch, Units]], np.ndarray]]:
    """(name, groups, doc_id of every document) of each block of a task's input."""
    part = TaskContext.get().partitionId()
    groups: list[tuple[pa.RecordBatch, Units]] = []
    ids: list[np.ndarray] = []
    held = seen = 0
    for batch in C.groups(batches, limit=GROUP):
        units = Units(C.utf8(batch), length)
        groups.append((batch, units))
        ids.append(C.column(batch, "doc_id").cast(pa.int64()).fill_null(int(LAST)).to_numpy())
        held += int(units.sizes.sum())
        del batch, units
        if held >= BLOCK:
            full = _named(part, seen, groups, ids)
            groups, ids, held, seen = [], [], 0, seen + 1
            yield full
            del full
            C.give_back()
    if groups:
        yield _named(part, seen, groups, ids)


def _named(part: int, seen: int, groups, ids):
    check = 0
    for (_, units), own in zip(groups, ids, strict=True):
        check = zlib.crc32(units.sizes.tobytes(), zlib.crc32(own.tobytes(), check))
    return f"{part}-{seen}-{check:08x}", groups, ids


def _unit_block(groups, ids) -> tuple[Block, np.ndarray, list[int]]:
    """Entries of a block's units, bucket bounds, and where each group's units begin."""
    anchor = np.concatenate([u.anchor for _, u in groups])
    rank = np.concatenate([u.rank for _, u in groups])
    doc = np.concatenate([own[u.document] for (_, u), own in zip(groups, ids, strict=True)])
    bounds = np.cumsum([0, *(len(u.anchor) for _, u in groups)])
    low = np.uint64(64 - TOP)
    key = (anchor >> low << low) | (_mix(anchor ^ _mix(rank)) >> np.uint64(TOP))
    return Block(key, [anchor, rank], doc), doc, bounds.tolist()


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Places where the sorted keys pass into the next bucket."""
    edges = np.array([-(-(i << TOP) // buckets) for i in range(1, buckets)], np.uint64) << np.uint64(64 - TOP)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _messages(name: str, block: Block, columns: list[tuple[np.ndarray, int]], buckets: int) -> Iterator[pa.RecordBatch]:
    cut = _cuts(block.key, buckets)
    rows = []
    for i in range(buckets):
        a, b = int(cut[i]), int(cut[i + 1])
        if a < b:
            rows.append((name, i, b - a, b"".join(_planes(c[a:b], w) for c, w in columns)))
    if rows:
        part = int(name.split("-")[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows]),
             pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
             pa.array([r[3] for r in rows], pa.binary())], names=["part", "block", "bucket", "n", "payload"])


def _send_units(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for name, groups, ids in _blocks(batches, length):
        block, _, _ = _unit_block(groups, ids)
        anchor, rank = block.extra
        yield from _messages(name, block, [(anchor, 5), (rank, 8), (block.doc_id.view(np.uint64), 8)], buckets)
        del groups, ids, block, anchor, rank          # before the next block is built


def _received(table: pa.Table, widths: tuple[int, ...]) -> tuple[list[np.ndarray], list[int]]:
    sizes = table.column("n").to_pylist()
    parts: list[list[np.ndarray]] = [[] for _ in widths]
    for n, payload in zip(sizes, table.column("payload").to_pylist(), strict=True):
        at, view = 0, memoryview(payload)
        for k, w in enumerate(widths):
            parts[k].append(_unplanes(view[at:], n, w))
            at += n * w
    return [np.concatenate(p) for p in parts], sizes


def _reply(table: pa.Table, sizes: list[int], late: np.ndarray, open_: np.ndarray | None) -> pa.Table:
    cut = np.cumsum(sizes)[:-1]
    pack = lambda bits: pa.array([np.packbits(b).tobytes() for b in np.split(bits, cut)], pa.binary())
    return pa.table({"part": table.column("part"), "block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n"),
                     "late": pack(late), "open": pack(late if open_ is None else open_)})


def _runs(cols: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _rank_units(table: pa.Table) -> pa.Table:
    """For each unit entry of a bucket: is it in a smaller document; must its windows be told apart."""
    (anchor, rank, doc), sizes = _received(table, (5, 8, 8))
    doc = doc.view(np.int64)
    order = np.lexsort((doc, rank, anchor))
    a, r, d = anchor[order], rank[order], doc[order]
    new_anchor = _runs([a])
    new_unit = _runs([a, r])
    unit = np.cumsum(new_unit) - 1
    group = np.cumsum(new_anchor) - 1
    late = d > d[new_unit][unit]
    starts = np.flatnonzero(new_anchor)
    different = np.add.reduceat(new_unit, starts, dtype=np.int64) > 1
    several = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
    open_ = ~late & (different & several)[group]
    back_late, back_open = np.empty(len(order), bool), np.empty(len(order), bool)
    back_late[order], back_open[order] = late, open_
    del anchor, rank, doc, order, a, r, d, unit, group
    C.give_back()
    return _reply(table, sizes, back_late, back_open)


def _rank_windows(table: pa.Table) -> pa.Table:
    """For each window entry of a bucket: is it in a smaller document."""
    (key, more, doc), sizes = _received(table, (8, 2, 8))
    doc = doc.view(np.int64)
    order = np.lexsort((doc, more, key))
    d = doc[order]
    new = _runs([key[order], more[order]])
    late = np.empty(len(order), bool)
    late[order] = d > d[new][np.cumsum(new) - 1]
    return _reply(table, sizes, late, None)


class Replies:
    """The bits that came back for the blocks of one task's input."""

    def __init__(self, folder: str):
        self.folder, self.blocks = folder, None

    def _load(self, part: int) -> None:
        self.blocks = {}
        try:
            table = C.read_shared(f"{self.folder}/part={part}")
        except FileNotFoundError:
            return                                    # nothing was sent from here
        for row in table.sort_by("bucket").select(["block", "n", "late", "open"]).to_pylist():
            own = self.blocks.setdefault(row["block"], {"late": [], "open": []})
            for what, found in own.items():
                found.append(np.unpackbits(np.frombuffer(row[what], np.uint8), count=row["n"]).astype(bool))

    def of(self, name: str, n: int, what: str) -> np.ndarray:
        """In the order the block's entries were sent."""
        if self.blocks is None:
            self._load(int(name.split("-")[0]))
        bits = np.concatenate([np.zeros(0, bool), *self.blocks.get(name, {what: []})[what]])
        if len(bits) != n:
            raise RuntimeError(f"{len(bits)} replies for {n} entries of block {name}: the input was cut differently on this scan")
        return bits


def _window_block(groups, ids, block: Block, doc: np.ndarray, bounds: list[int], open_: np.ndarray):
    """Entries of the single windows of a block's open units (each told apart once, in its first document)."""
    rows, keys, more, owner = [], [], [], []
    wanted = open_[block.entry] & (doc == block.doc_id[block.entry])
    for g, ((_, units), own) in enumerate(zip(groups, ids, strict=True)):
        start, document, key, extra = units.windows(np.flatnonzero(wanted[bounds[g]:bounds[g + 1]]))
        rows.append((start, document))
        keys.append(key)
        more.append(extra)
        owner.append(own[document])
    owner = np.concatenate(owner)
    return Block(np.concatenate(keys), [np.concatenate(more)], owner), owner, rows


def _send_windows(batches: Iterator[pa.RecordBatch], length: int, buckets: int, units_at: str) -> Iterator[pa.RecordBatch]:
    replies = Replies(units_at)
    for name, groups, ids in _blocks(batches, length):
        block, doc, bounds = _unit_block(groups, ids)
        open_ = replies.of(name, len(block.key), "open")
        windows = _window_block(groups, ids, block, doc, bounds, open_)[0]
        yield from _messages(name, windows, [(windows.key, 8), (windows.extra[0], 2), (windows.doc_id.view(np.uint64), 8)],
                             buckets)
        del groups, ids, block, doc, open_, windows


def _cover(units: Units, late_units: np.ndarray, late_starts: np.ndarray) -> np.ndarray:
    """Which bytes of the group's buffer lie in a late window."""
    edge = np.zeros(int(units.sizes.sum()) + 1, np.int64)
    np.add.at(edge, units.low[late_units], 1)
    np.add.at(edge, units.high[late_units] + units.length, -1)
    np.add.at(edge, late_starts, 1)
    np.add.at(edge, late_starts + units.length, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut_out(batches: Iterator[pa.RecordBatch], length: int, units_at: str, windows_at: str) -> Iterator[pa.RecordBatch]:
    unit_replies, window_replies = Replies(units_at), Replies(windows_at)
    for name, groups, ids in _blocks(batches, length):
        block, doc, bounds = _unit_block(groups, ids)
        open_ = unit_replies.of(name, len(block.key), "open")
        late = unit_replies.of(name, len(block.key), "late")[block.entry] | (doc > block.doc_id[block.entry])
        windows, owner, rows = _window_block(groups, ids, block, doc, bounds, open_)
        late_window = (window_replies.of(name, len(windows.key), "late")[windows.entry]
                       | (owner > windows.doc_id[windows.entry]))
        at = 0
        for g, (batch, units) in enumerate(groups):
            start, _ = rows[g]
            covered = _cover(units, np.flatnonzero(late[bounds[g]:bounds[g + 1]]), start[late_window[at:at + len(start)]])
            at += len(start)
            spans, kept = [], []
            for text, begin, size in zip(C.utf8(batch), units.begins.tolist(), units.sizes.tolist(), strict=True):
                own = covered[begin:begin + size]
                step = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                spans.append([{"begin": a, "end": b} for a, b in step.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(text, np.uint8)[~own].tobytes() if len(step) else text)
            yield pa.RecordBatch.from_arrays(
                [C.column(batch, "doc_id"), pa.array(units.sizes),
                 pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
        del groups, ids, block, doc, open_, late, windows, owner, rows, late_window, batch, units, covered, spans, kept


def _ask(messages: DataFrame, judge, name: str) -> str:
    """Deal messages by bucket, judge each bucket, and write the replies by the task that asked."""
    replies = messages.groupBy("bucket").applyInArrow(judge, REPLY)
    path = C.fresh_path(messages.sparkSession, name)
    replies.repartition("part").write.partitionBy("part").parquet(path)
    return path


def dedup_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``docs``.

    ``spans`` are the removed runs (begin, end) in bytes of the UTF-8 text,
    ``kept`` the remaining bytes. Null text is empty. Texts shorter than
    ``length`` lose nothing. Rows without a doc_id rank after all others and
    lose what any document with an id holds; rows that share an id (or have
    none) take nothing from each other. An empty table gives an empty result;
    other columns are not read. ``length`` is at least 32.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"length must be at least {ANCHOR + 8}")
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(max(8, -(-total // BUCKET_BYTES)), 1 << TOP))
    how = {"length": length, "buckets": buckets}
    sent = C.map_arrow(narrow, partial(_send_units, **how), MESSAGE)
    units_at = _ask(sent, _rank_units, "units")
    sent = C.map_arrow(narrow, partial(_send_windows, units_at=units_at, **how), MESSAGE)
    windows_at = _ask(sent, _rank_windows, "windows")
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(narrow, partial(_cut_out, length=length, units_at=units_at, windows_at=windows_at),
                       f"doc_id {id_type}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")

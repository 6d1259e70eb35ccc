"""SimHash near-duplicates by pigeonhole blocks.

``fingerprints`` makes a 64-bit fingerprint per row from word shingles.
``link`` splits the 64 bits into six blocks: two fingerprints at distance two
or less agree in at least four of them, so the pairs meet in one of the
fifteen tables keyed by four blocks. A bucket of such a table fixes 42 bits or
more, so it holds at most 2**22 distinct fingerprints (32 MB): that bound is
what lets one task take a bucket whole. Inside it, every fingerprint is looked
up with each one- and two-bit mask over the free bits (linear in the bucket,
no pairs are written), and the bucket sends on a spanning forest.

Equal fingerprints meet before the blocks (one row per distinct value), so
groups of copies, however large, never reach a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm import common as C
from churnkit.llm.components import components

BITS = 64
CHUNK = 1 << 17                       # shingles whose bits are counted at once


def _hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    words = text.lower().split()      # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    grams = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(seed)), np.uint64)


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def _fingerprints(texts: list[bytes], size: int, seed: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    counts = np.zeros((len(texts), BITS), np.int64)
    totals = np.zeros(len(texts), np.int64)
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if waiting:
            starts = np.cumsum([0, *map(len, waiting[:-1])])
            np.add.at(counts, owners, _bit_counts(np.concatenate(waiting), starts))
            waiting.clear()
            owners.clear()

    held = 0
    for i, text in enumerate(texts):
        hashes = _hashes(text, size, seed)
        totals[i] = len(hashes)
        for at in range(0, len(hashes), CHUNK):
            waiting.append(hashes[at:at + CHUNK])
            owners.append(i)
            held += len(waiting[-1])
            if held >= CHUNK:
                flush()
                held = 0
    flush()
    majority = 2 * counts > totals[:, None]
    out[:] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in C.groups(batches, "_text"):
        fps = _fingerprints(C.utf8(batch, "_text"), size, seed)
        yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), pa.array(fps.view(np.int64))],
                                         names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the 64-bit pattern as a signed long.

    Words are the runs between ASCII white space of the text with A-Z lowered.
    Fewer words than ``shingle``: the whole sequence is the one shingle. Null,
    empty and blank texts: fingerprint zero. Other columns are not read.
    """
    narrow = docs.select("doc_id", F.col("text").alias("_text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(narrow, partial(_fingerprint_batches, size=shingle, seed=seed), f"doc_id {id_type}, fp long")


def _block_masks(distance: int, spare: int = 4) -> list[int]:
    """For each choice of ``spare`` of ``distance + spare`` blocks, the bits they cover."""
    n = distance + spare
    edges = [BITS * i // n for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(block, spare)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _forest(fps: np.ndarray, free: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member of its group) among the distinct values of one bucket."""
    v = np.unique(fps)
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    label = np.arange(len(v))
    pairs_a, pairs_b = [], []
    if len(v) <= 64:                                  # few: compare directly
        a, b = np.triu_indices(len(v), 1)
        near = np.bitwise_count(v[a] ^ v[b]) <= distance
        pairs_a, pairs_b = [a[near]], [b[near]]
    else:                                             # many: look up every mask
        for k in range(1, distance + 1):
            for flips in combinations(bits, k):
                want = v ^ np.uint64(sum(flips))
                at = np.minimum(np.searchsorted(v, want), len(v) - 1)
                hit = np.flatnonzero((v[at] == want) & (v < want))
                if len(hit):
                    pairs_a.append(hit)
                    pairs_b.append(at[hit])
    if not pairs_a or not sum(map(len, pairs_a)):
        return v[:0], v[:0]
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    while (label[label] != label).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(v)))
    return v[moved], v[label[moved]]


def _verify(batches: Iterator[pa.RecordBatch], masks: list[int], distance: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = C.column(batch, "block").to_numpy()
        lists = C.column(batch, "members")
        left, right = [], []
        for i, which in enumerate(tables):
            members = lists[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            a, b = _forest(members, ~masks[which] & ((1 << BITS) - 1), distance)
            left.append(a)
            right.append(b)
        if left and sum(map(len, left)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)],
                                             names=["a", "b"])


def link(classes: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): a spanning forest of the links between the distinct fingerprints ``classes.fp``."""
    masks = _block_masks(distance)
    keys = F.explode(F.array(*(
        F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for i, m in enumerate(masks))))
    buckets = (classes.select("fp", keys.alias("k")).groupBy("k.block", "k.bits")
               .agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
               .select("block", "members"))
    return C.map_arrow(buckets, partial(_verify, masks=masks, distance=distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest
    doc_id reachable over links of at most ``distance`` differing bits. Null,
    empty and blank texts share fingerprint zero and link like any other.
    Repeated rows stay repeated. A null doc_id takes part in linking but is
    never a component's id unless the component has no other (then null). An
    empty table gives an empty result. Further columns are ignored.
    """
    fps = C.stage(fingerprints(docs, shingle, seed), "simhash")
    classes = C.stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(link(classes.select("fp"), distance))              # (node, root), linked ones only
    member = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(ids, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return fps.join(named, fps["fp"] == named["class_fp"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` without near-duplicates: one row of each component stays, the
    one with the smallest doc_id (of equal ones, the text with the smallest
    hash; of rows that agree in both, the first by its whole content as JSON).

    Decided per row: doc_id may repeat, and every text of it is judged by its
    own fingerprint. Rows without a doc_id stay, and link others as in
    ``near_duplicates``. Null, empty and blank texts are one component. An
    empty table gives an empty result; columns may have any name.
    """
    text_hash = F.xxhash64("text")                    # tells the texts of one doc_id apart
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", text_hash.alias("text_hash")))
    found = near_duplicates(docs.select(row.alias("doc_id"), "text"), shingle, distance, seed)
    kept = (found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
            .select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.text_hash").alias("text_hash"), "n"))
    content = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select("doc_id", text_hash.alias("text_hash"), content.alias("content"))

    def matching(keys: DataFrame) -> DataFrame:
        return rows.join(keys, (rows["doc_id"] == keys["id"]) & (rows["text_hash"] == keys["text_hash"]), "left_semi")

    repeated = (matching(kept.where("n > 1")).groupBy("doc_id", "text_hash")
                .agg(F.min_by("content", F.to_json("content", {"ignoreNullFields": "false"})).alias("content")))
    return (matching(kept.where("n = 1")).select("content.*")
            .unionByName(repeated.select("content.*"))
            .unionByName(docs.where(F.col("doc_id").isNull())))

"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of the last two, one and zero bytes holds
counts of the byte that follows. A byte seen in a context is coded there; else
the context's escape is coded and the next shorter context codes it, without
the bytes the longer one had (method C, with exclusion), down to 256 equal
bytes. With frozen statistics this gives every text an exact code length under
each language; the shortest wins.

The counts cover every learning document. The tree has at most 65,536 + 256
contexts however much text it has seen; ``max_contexts`` bounds the longest
ones further (the richest stay, the others answer from the shorter context),
so the frozen table has at most 256 * (max_contexts + 256) * languages * 4
bytes, which is what the tasks are sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm import common as C

START = b"\n\n"                       # stands before every text
LETTER = regex.compile(r"\p{L}")
CHUNK = 1 << 19
UNKNOWN = "und"


def _grams(data: bytes) -> np.ndarray:
    """24-bit codes (two bytes of context, then the byte) of text that begins with START."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in C.groups(batches):
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(C.column(batch, "lang").to_pylist(), C.utf8(batch), strict=True):
            by_lang.setdefault(lang, []).append(_grams(START + text))
        for lang, parts in by_lang.items():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in held:
                old, m = held[lang]
                both = np.concatenate([old, code])
                code, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, np.concatenate([m, n])).astype(np.int64)
            held[lang] = code, n
    for lang, (code, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)),
                                          pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def byte_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): how often each byte follows each two bytes, per language, over all rows with text and lang."""
    rows = docs.where("text is not null and lang is not null").select("lang", "text")
    return C.map_arrow(rows, _count_batches, "lang string, code long, n long").groupBy("lang", "code").agg(
        F.sum("n").alias("n"))


def _with_escape(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of 256 bytes per row: seen ones by count, the rest by escape to ``lower``."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    rest = np.where(counts > 0, 0.0, lower)
    mass = rest.sum(1, keepdims=True)
    escape = np.where(kinds < 256, kinds, 0) / np.maximum(total + np.where(kinds < 256, kinds, 0), 1)
    seen = counts / np.maximum(total + np.where(kinds < 256, kinds, 0), 1)
    out = seen + escape * rest / np.where(mass > 0, mass, 1)
    return np.where(total > 0, out, lower)


class Models:
    """Frozen log-probabilities: ``table[row[context], byte, language]``."""

    def __init__(self, counts: pd.DataFrame, max_contexts: int = 1 << 14):
        self.langs = sorted(counts["lang"].unique())
        code = counts["code"].to_numpy()
        which = np.searchsorted(self.langs, counts["lang"].to_numpy())
        n = counts["n"].to_numpy().astype(np.float64)
        context, byte = code >> 8, code & 255
        weight = np.bincount(context, n, 1 << 16)
        found = np.flatnonzero(weight)
        kept = np.sort(found[np.argsort(-weight[found], kind="stable")[:max_contexts]])
        self.row = np.arange(1 << 16, dtype=np.int32) & 255          # the shorter context, by its last byte
        self.row[kept] = 256 + np.arange(len(kept), dtype=np.int32)
        self.table = np.empty((256 + len(kept), 256, len(self.langs)), np.float32)
        for i in range(len(self.langs)):
            own = which == i
            one = np.zeros((256, 256))
            np.add.at(one, (context[own] & 255, byte[own]), n[own])
            zero = _with_escape(one.sum(0, keepdims=True), np.full((1, 256), 1 / 256))
            first = _with_escape(one, np.broadcast_to(zero, (256, 256)))
            two = np.zeros((len(kept), 256))
            at = np.minimum(np.searchsorted(kept, context[own]), max(len(kept) - 1, 0))
            hit = kept[at] == context[own] if len(kept) else np.zeros(own.sum(), bool)
            np.add.at(two, (at[hit], byte[own][hit]), n[own][hit])
            self.table[:256, :, i] = np.log(first)
            self.table[256:, :, i] = np.log(_with_escape(two, first[kept & 255]))

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Nats of every text under every language."""
        out = np.zeros((len(texts), len(self.langs)))
        flat = self.table.reshape(-1, len(self.langs))
        waiting, owners, held = [], [], 0

        def flush() -> None:
            if waiting:
                code = np.concatenate(waiting)
                at = self.row[code >> 8].astype(np.int64) << 8 | (code & 255)
                starts = np.cumsum([0, *map(len, waiting[:-1])])
                np.add.at(out, owners, -np.add.reduceat(flat[at], starts, axis=0, dtype=np.float64))
                waiting.clear()
                owners.clear()

        for i, text in enumerate(texts):
            codes = _grams(START + text) if text else np.empty(0, np.uint32)
            for a in range(0, len(codes), CHUNK):
                waiting.append(codes[a:a + CHUNK])
                owners.append(i)
                held += len(waiting[-1])
                if held >= CHUNK:
                    flush()
                    held = 0
        flush()
        return out


def _predict_batches(batches: Iterator[pa.RecordBatch], models) -> Iterator[pa.RecordBatch]:
    frozen: Models = models.value
    for batch in C.groups(batches):
        lengths = frozen.code_lengths(C.utf8(batch))
        best = lengths.argmin(1)
        score = 1 / np.exp(np.maximum(lengths.min(1, keepdims=True) - lengths, -700)).sum(1)
        letters = np.array([bool(LETTER.search(t)) for t in C.texts(batch)], bool)
        yield pa.RecordBatch.from_arrays(
            [C.column(batch, "doc_id"),
             pa.array([frozen.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]),
             pa.array(np.where(letters, score, 0.0))], names=["doc_id", "lang_pred", "score"])


def learn(docs: DataFrame, max_contexts: int = 1 << 14) -> Models | None:
    """Models from all rows of ``docs`` with text and lang; None if there are none.

    What comes to the driver has at most 2**24 rows a language (one for each
    three bytes), whatever the corpus holds.
    """
    counts = byte_counts(docs).toPandas()
    return Models(counts, max_contexts) if len(counts) else None


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row: the language with the shortest code
    for the whole text; score is its share of the likelihood (0 to 1).

    ``und`` with score 0 where the text is null, empty or has no letter, and
    everywhere if nothing was learned. Ties go to the first language by name.
    Repeated rows and null ids stay; other columns are not read.
    """
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if models is None:
        return narrow.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(models)
    return C.map_arrow(narrow, partial(_predict_batches, models=sent), f"doc_id {id_type}, lang_pred string, score double")

"""Token counts under a byte-level BPE vocabulary by rank-synchronous merging.

A text is cut into pre-tokens; the distinct new pre-tokens of a group of texts
become ragged symbol arrays (one flat array plus sequence starts). In each
round every sequence finds the lowest merge rank among its neighbouring pairs,
and all pairs of that rank merge at once, left to right; sequences without a
known pair leave. A merged symbol only takes part in later ranks, so this
gives the same symbols as merging one pair at a time. The surviving symbols of
a pre-token are its count; a task keeps the counts of short pre-tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnkit.llm import common as C

# Fixed value: the published split pattern of this tokenizer family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters that Unicode versions may class differently (all below agree).
RARE = regex.compile(r"[^\x00-\u04ff]")
NONE = np.int64(1) << 40
KEEP_CHARS = 48                       # longer pre-tokens are counted but not kept
KEEP_ENTRIES = 1_000_000                # a task's table is emptied beyond this
ROUND_BYTES = 1 << 20                 # symbols merged together
GROUP = 2 << 20                       # bytes of text cut at once


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the rest follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge table of a vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.first[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[str, int] = {}
        self.letters: dict[str, bool] = {}
        self.library = Tokenizer.from_file(path)

    def _ranks(self, symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the pair that starts at each symbol (NONE: no such merge) and its row in the table."""
        pair = symbols[:-1] * self.size + symbols[1:]
        row = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        rank = np.where((self.key[row] == pair) & ~last[:-1], self.rank[row], NONE)
        return np.append(rank, NONE), np.append(row, 0)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte sequence."""
        sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = np.zeros(len(sequences), np.int64)
        symbols = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        who = np.arange(len(sequences))
        while len(who):
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            last = np.zeros(len(symbols), bool)
            last[starts + sizes - 1] = True
            rank, row = self._ranks(symbols, last)
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NONE
            out[who[done]] = sizes[done]
            hit = (rank == np.repeat(lowest, sizes)) & (rank < NONE)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # equal symbols in a row: of overlapping pairs take the first, third, ...
            begins = np.append(True, np.diff(at) != 1)
            head = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            symbols[at] = self.made[row[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sizes = sizes - np.bincount(owner[at], minlength=len(sizes))
            stay &= ~done[owner]
            symbols, sizes, who = symbols[stay], sizes[~done], who[~done]
        return out

    def _learn(self, pieces: set[str]) -> dict[str, int]:
        """Counts of pre-tokens not seen before, merged in groups."""
        found: dict[str, int] = {}
        group: list[str] = []
        held = 0
        for piece in pieces:
            group.append(piece)
            held += len(piece)
            if held > ROUND_BYTES:
                found.update(zip(group, self.count([p.encode() for p in group]).tolist(), strict=True))
                group, held = [], 0
        if group:
            found.update(zip(group, self.count([p.encode() for p in group]).tolist(), strict=True))
        if len(self.known) + len(found) > KEEP_ENTRIES:
            self.known.clear()
        self.known.update((p, n) for p, n in found.items() if len(p) <= KEEP_CHARS)
        return found

    def _differs(self, letter: str) -> bool:
        """Whether the library, built on another Unicode version, splits at this letter otherwise."""
        if letter not in self.letters:
            probe = f"a{letter}b1{letter}2 {letter} ."
            ours = [m.span() for m in self.split.finditer(probe)]
            self.letters[letter] = ours != [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(probe)]
        return self.letters[letter]

    def pieces(self, text: str) -> list[str]:
        if not text.isascii() and RARE.search(text) and any(map(self._differs, set(RARE.findall(text)))):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.split.findall(text)

    def tokens(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings inside a text are one token each."""
        cut, special = [], []
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            special.append(len(parts) - 1)
            cut.append(self.pieces(text) if len(parts) == 1 else [p for part in parts for p in self.pieces(part)])
        seen = set().union(*cut)
        table = {p: self.known[p] for p in seen if p in self.known}
        table |= self._learn(seen - table.keys())
        return [n + sum(map(table.__getitem__, pieces)) for n, pieces in zip(special, cut, strict=True)]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def _count_batches(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    table = merges(path)
    for batch in C.groups(batches, limit=GROUP):
        counts = table.tokens(C.texts(batch))
        sizes = pc.binary_length(C.column(batch, "text")).fill_null(0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [C.column(batch, "doc_id"), sizes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``path`` is the vocabulary file, readable on every executor. Null text
    counts as empty (0 bytes, 0 tokens, within the limit). No truncation: a
    very long text is counted whole. Repeated rows and null ids stay; an empty
    table gives an empty result; other columns are not read.
    """
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(narrow, partial(_count_batches, path=path, limit=limit),
                       f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")

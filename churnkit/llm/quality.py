"""Quality rules judged by an isolation forest over rule statistics.

``rule_statistics`` measures every whole text. Two base rules reject outright
(too few words, too much of the text in repeated 8-word windows). For the
rest an isolation forest, grown over random splits of the statistics of good
labelled rows, gives each document the mean depth at which it stands alone;
short paths are anomalies, and the cut between them is set on labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit.llm import common as C

WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks",
          "n_alpha", "n_digits", "n_distinct_words", "n_short_words", "n_echoes"]
RATIOS = ["mean_word", "symbols", "dup_lines", "repeat_words", "words_per_line", "upper", "marks", "alpha", "digits",
          "distinct_words", "short_words", "echoes"]
MARKS = "!?;:\"'()[]{}=/\\_~^+-"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    key = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = key[:n].copy()
    for step in range(1, window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + key[step:step + n]
    key = rolled
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    likely = np.zeros(n, bool)
    likely[order[1:][same]] = likely[order[:-1][same]] = True
    places: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(likely).tolist():         # equal hashes: compare the words themselves
        places.setdefault(tuple(words[i:i + window]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    found = np.array([i for at in places.values() if len(at) > 1 for i in at], np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def _measure(text: str) -> list[int]:
    data = text.encode()
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(C.WHITE)]
    raw = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = lambda letters: int(raw[list(letters.encode())].sum())
    return [len(words), len(text) - total(C.WHITE), total(SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), int(raw[65:91].sum()), total(MARKS),
            int(raw[65:91].sum() + raw[97:123].sum() + raw[192:256].sum()), int(raw[48:58].sum()),
            len(set(words)), sum(len(w) < 3 for w in words),
            sum(map(eq, words, words[1:]))]


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.groups(batches):
        rows = np.array([_measure(t) for t in C.texts(batch)], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))],
                                         names=["doc_id", *COUNTS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of COUNTS for every whole text (null: no words)."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(narrow, _stat_batches, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(min_words: int = 20, max_repeat_percent: int = 30):
    return ((F.col("n_words") < min_words)
            | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def features(counts: pd.DataFrame) -> np.ndarray:
    """The statistics as shares, so that long and short documents compare."""
    c = counts.astype(np.float64)
    words, chars, lines = (np.maximum(c[x].to_numpy(), 1) for x in ("n_words", "word_chars", "n_lines"))
    out = [c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
           np.log1p(words / lines), c["n_upper"] / chars, c["n_marks"] / chars, c["n_alpha"] / chars,
           c["n_digits"] / chars, c["n_distinct_words"] / words ** 0.9, c["n_short_words"] / words, c["n_echoes"] / words]
    return np.column_stack([np.asarray(x, np.float64) for x in out])


def _mean_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as flat arrays: split column (-1: leaf), split value, children, path length at a leaf."""

    column: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: np.ndarray
    sample: int
    cut: float = 0.6

    @classmethod
    def grow(cls, x: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        limit = int(np.ceil(np.log2(max(sample, 2)))) + 4
        size = 2 * sample
        column, value = np.full((trees, size), -1), np.zeros((trees, size))
        low, high, depth = np.zeros((trees, size), int), np.zeros((trees, size), int), np.zeros((trees, size))
        for t in range(trees):
            waiting, used = [(0, x[rng.choice(len(x), sample, replace=False)], 0)], 1
            while waiting:
                node, rows, level = waiting.pop()
                spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
                if level >= limit or not len(spread):
                    depth[t, node] = level + _mean_depth(len(rows))
                    continue
                j = rng.choice(spread)
                a, b = rows[:, j].min(), rows[:, j].max()
                # splits reach a little past what was seen, so that values beyond it stand alone early
                at = rng.uniform(a - (b - a) / 2, b + (b - a) / 2)
                column[t, node], value[t, node], low[t, node], high[t, node] = j, at, used, used + 1
                left = rows[:, j] < at
                if left.all() or not left.any():
                    empty = used + 1 if left.all() else used
                    depth[t, empty] = level + 1
                    other = used if left.all() else used + 1
                    if used + 2 + 2 * len(rows) < size and level + 1 < limit:
                        waiting.append((other, rows, level + 1))
                    else:
                        depth[t, other] = level + 1 + _mean_depth(len(rows))
                else:
                    waiting += [(used, rows[left], level + 1), (used + 1, rows[~left], level + 1)]
                used += 2
                if used + 2 >= size:
                    for node, rows, level in waiting:
                        depth[t, node] = level + _mean_depth(len(rows))
                    waiting = []
        return cls(column, value, low, high, depth, sample)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0..1; near 1: isolated after few splits."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.column)):
            node = np.zeros(len(x), int)
            while True:
                j = self.column[t, node]
                if (j < 0).all():
                    break
                step = np.where(x[rows, np.maximum(j, 0)] < self.value[t, node], self.low[t, node], self.high[t, node])
                node = np.where(j >= 0, step, node)
            total += self.depth[t, node]
        return 2.0 ** -(total / len(self.column) / max(_mean_depth(self.sample), 1e-9))

    def calibrate(self, x: np.ndarray, good: np.ndarray) -> None:
        """The cut with the fewest errors, both classes weighing the same."""
        if not good.any() or good.all():
            return
        s = self.score(x)
        order = np.argsort(s, kind="stable")
        bad_share = np.cumsum(~good[order]) / (~good).sum()
        good_share = np.cumsum(good[order]) / good.sum()
        gain = good_share - bad_share                 # keep everything up to this row
        step = np.append(s[order][1:] != s[order][:-1], True)
        best = int(np.argmax(np.where(step, gain, -1)))
        self.cut = float((s[order][best] + s[order][min(best + 1, len(s) - 1)]) / 2)


def _score_batches(frames: Iterator[pd.DataFrame], forest: Forest) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(anomaly=forest.score(features(frame)))


def fit(stats: DataFrame, labels: DataFrame, rows: int = 20_000, trees: int = 100, sample: int = 256,
        seed: int = 7) -> Forest | None:
    """A forest from a bounded sample of labelled rows that pass the base rules.

    ``rows`` bounds the sample (by the hash of the id), half of it to grow
    trees (the good rows), half to set the cut.
    Rows with a null label don't count; a document labelled twice counts by
    its lowest label. None when no good row is labelled.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    marked = stats.where(~base_failed()).join(known, "doc_id")
    picked = C.bounded_sample(marked, rows, seed).toPandas()
    picked = picked.sort_values([*stats.columns, "_good"]).sample(frac=1, random_state=seed)
    x, good = features(picked), (picked["_good"] == 1).to_numpy()
    grow = np.arange(len(x)) % 2 == 0
    if not (good & grow).any():
        return None
    forest = Forest.grow(x[good & grow], trees, sample, seed)
    forest.calibrate(x[~grow], good[~grow])
    return forest


def judge(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly and kept for every row of ``docs``.

    ``kept`` is false if a base rule fails, else whether the anomaly score is
    below the calibrated cut (all rows that pass the base rules are kept when
    nothing is labelled). Null, empty and blank texts have no words and fail.
    Repeated rows and null ids stay; an empty table gives an empty result;
    other columns are not read.
    """
    stats = C.stage(rule_statistics(docs), "rules")
    forest = fit(stats, labels, rows)
    if forest is None:
        scored = stats.withColumn("anomaly", F.lit(0.0))
        cut = 1.0
    else:
        C.ship_package(docs.sparkSession)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", anomaly double"
        scored = stats.mapInPandas(partial(_score_batches, forest=forest), schema)
        cut = forest.cut
    return scored.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") < cut))

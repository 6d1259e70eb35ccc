"""Line dedup over three-line windows, in DataFrame functions only.

Every run of three consecutive lines is a window, known by two chained 64-bit
hashes. A window that occurs in several places keeps its first occurrence
(smallest doc_id, then text hash, then line); the lines that any later
occurrence covers go. Overlapping later occurrences merge into one removed
range, since each simply marks its three lines.

The windows are counted with map-side combine, so a window that a third of
the documents hold costs one row per task; the join back to its places is one
that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column, size: int) -> Column:
    """Array of (h, g), one for each run of ``size`` lines."""
    def window(i: Column) -> Column:
        run = [F.element_at(lines, (i + k).cast("int")) for k in range(size)]
        return F.struct(F.xxhash64(*run).alias("h"), F.xxhash64(F.lit(1), *run).alias("g"))

    starts = F.when(F.size(lines) >= size, F.sequence(F.lit(1), F.size(lines) - (size - 1)))
    return F.transform(starts, window)


def removed_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, _hash, hits): for documents that lose lines, the first lines
    (from 1) of the later occurrences found in them."""
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("_hash"),
                                                 _lines(F.col("text")).alias("lines"))
    places = rows.select("doc_id", "_hash", F.posexplode(_windows(F.col("lines"), size)).alias("pos", "w")).select(
        F.struct("doc_id", "_hash", "pos").alias("place"), "w.h", "w.g")
    repeated = (places.groupBy("h", "g").agg(F.min("place").alias("first"), F.max("place").alias("last"))
                .where("first < last").select("h", "g", "first"))
    later = places.join(repeated, ["h", "g"]).where("place > first")
    return later.groupBy("place.doc_id", "place._hash").agg(F.collect_set(F.col("place.pos") + 1).alias("hits"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines, n_removed.

    Null text stays null with zero lines; an empty text is one empty line.
    Texts of fewer than ``size`` lines lose nothing. Rows equal in doc_id and
    text are one document; a null doc_id sorts first. All columns of ``docs``
    are kept, but n_lines and n_removed are replaced if it has them. An empty
    table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_removed")
    hits = removed_lines(docs.select("doc_id", "text"), size).select(
        F.col("doc_id").alias("_line_doc"), F.col("_hash").alias("_line_text"), F.col("hits").alias("_line_hits"))
    # the split text travels instead of the text: array_join gives it back exactly
    rows = docs.withColumn("_line_own", F.xxhash64("text")).withColumn("text", _lines(F.col("text")))
    joined = rows.join(
        hits, F.col("doc_id").eqNullSafe(F.col("_line_doc")) & (F.col("_line_own") == F.col("_line_text")), "left")
    found = F.col("_line_hits")
    covered = F.array_distinct(F.flatten(F.transform(found, lambda p: F.sequence(p, p + (size - 1)))))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size("text")), covered),
                       lambda i: F.element_at("text", i.cast("int")))
    text = F.array_join(F.when(found.isNull(), F.col("text")).otherwise(kept), "\n")
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("text")).cast("long").alias("n_lines"),
        F.when(found.isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_removed"))

"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.session import shared_path, ship_package

#: ASCII white space; everything else belongs to a word.
WORD_SPLIT = r"[ \t\n\x0B\f\r]+"
WHITE = " \t\n\x0b\x0c\r"
#: Texts wait in groups of at most about so many bytes inside a task.
GROUP_BYTES = 8 << 20
BATCH_BOUND, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
BATCH_DEFAULT = "67108864b"           # Spark's own bound, where the session sets none


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    return shared_path(spark, "churnkit-llm", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet below the shared folder; returns the folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("error").parquet(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: lineage ends at
    the files, and what was expensive to compute is computed once."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def read_shared(path: str, columns: list[str] | None = None, part: tuple[str, int] | None = None) -> pa.Table:
    """A small table below the shared folder, read inside a task; with ``part``
    only the folder of that value of a partition column."""
    store, at = pafs.FileSystem.from_uri(path)
    if part is None:
        return pads.dataset(at, filesystem=store, format="parquet").to_table(columns)
    rows = pads.dataset(at, filesystem=store, format="parquet", partitioning="hive")
    return rows.to_table(columns, filter=pads.field(part[0]) == part[1])


def shared_batches(path: str, columns: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A table below the shared folder, read inside a task a batch at a time."""
    store, at = pafs.FileSystem.from_uri(path)
    for found in store.get_file_info(pafs.FileSelector(at, recursive=True)):
        if found.base_name.endswith(".parquet"):
            with store.open_input_file(found.path) as source:
                yield from pq.ParquetFile(source, buffer_size=1 << 20).iter_batches(rows, columns=columns, use_threads=False)


def map_arrow(df: DataFrame, func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with the package importable in the workers and with
    batches of at most 4 MB (Spark's bound is 64 MB, and a task holds a batch on
    both sides); a bound that the session sets itself stays."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH_BOUND) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BOUND, str(BATCH_BYTES))
    return df.mapInArrow(partial(_tidy, func=func), schema)


def give_back() -> None:
    """Return freed memory to the system. A worker that has finished its task
    stays for a while beside the workers of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:                              # the C library of Linux has it, others tidy up by themselves
        trim(0)


class TaskCache:
    """A function's last result, kept in a worker process as long as its tasks
    go on asking for it: a task that does not gives it up."""

    every: list[TaskCache] = []

    def __init__(self, build: Callable):
        self.build, self.args, self.value, self.asked = build, None, None, False
        self.every.append(self)

    def __call__(self, *args):
        self.asked = True
        if self.args != args:
            self.args = self.value = None
            self.value, self.args = self.build(*args), args
        return self.value

    @classmethod
    def forget(cls) -> None:
        for cache in cls.every:
            if not cache.asked:
                cache.args = cache.value = None
            cache.asked = False


def _tidy(batches: Iterator[pa.RecordBatch], func) -> Iterator[pa.RecordBatch]:
    yield from func(batches)
    TaskCache.forget()
    give_back()


def groups(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column``
    (a longer single value stays whole, alone)."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(values).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.binary()).fill_null(b"").to_pylist()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(column)).fill_null("").to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def held_out(doc_id: str = "doc_id"):
    """The fifth of the documents kept away from learning: crc32 of the id as
    text, mod 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``df`` if it has at most ``rows`` rows, else about so many of them: those
    whose key hashes lowest, cut at the share that gives ``rows``. Tasks send
    their part of it only (a sort with a limit would send ``rows`` each)."""
    n = df.count()
    if n <= rows:
        return df
    cut = int(rows / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < cut)


def single(values: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return values.combine_chunks() if values.num_chunks != 1 else values.chunk(0)

"""Materialised pipeline stages.

The cleaned accounts table feeds every report, so it is computed once per
application and written as Parquet below the shared folder named by
``spark.checkpoint.dir``. Reports then scan it with column pruning and
filter pushdown, and lineage stops at the file: a lost executor costs a
re-read of Parquet, not a re-run of the cleaning joins and windows.

A stage is known by its name and the state of the tables it was made from
(path, files' sizes and times), so data replaced at a path within one session
makes a new stage instead of a stale answer. ``clear`` removes what the
application has written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from churnkit.session import shared_path
from churnkit.sources.files import hadoop_path

_DONE: dict[tuple[str, str], str] = {}
SOURCES = ("orders", "customer", "nation", "region")


def state(spark: SparkSession, sf_dir: str, tables=SOURCES) -> str:
    """A digest of the tables' files: sizes and modification times, from their listings."""
    seen = []
    for name in tables:
        fs, path = hadoop_path(spark, f"{sf_dir}/{name}.parquet")
        found = fs.getFileStatus(path)
        files = fs.listStatus(path) if found.isDirectory() else [found]
        seen += [(st.getPath().toString(), st.getLen(), st.getModificationTime()) for st in files]
    return hashlib.sha1(repr(sorted(seen)).encode()).hexdigest()[:16]


def key(spark: SparkSession, name: str, sf_dir: str) -> str:
    return hashlib.sha1(f"{name}:{sf_dir}:{state(spark, sf_dir)}".encode()).hexdigest()[:16]


def staged(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    app = spark.sparkContext.applicationId
    memo = (app, key(spark, name, sf_dir))
    if memo not in _DONE:
        path = shared_path(spark, "churnkit-stages", *memo)
        build().write.mode("overwrite").parquet(path)
        _DONE[memo] = path
    return spark.read.parquet(_DONE[memo])


def clear(spark: SparkSession) -> None:
    """Remove the application's stages."""
    app = spark.sparkContext.applicationId
    fs, folder = hadoop_path(spark, shared_path(spark, "churnkit-stages", app))
    fs.delete(folder, True)
    for memo in [m for m in _DONE if m[0] == app]:
        del _DONE[memo]

"""Session construction and cluster-sensitive settings."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: ANSI semantics (Spark 4 default), AQE for
# runtime re-planning (partition coalescing, skew splitting, join switching),
# UTC so timestamps agree with the DuckDB oracle.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "churnkit", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.

    ``master``/``shuffle_partitions`` are only applied when given, so on a
    cluster the submit-time configuration wins.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    That setting points at storage which driver and executors share and is
    used as is. Where it is unset, a local master (tests, a laptop) gets a
    private folder; on a cluster it is an error, since a machine-local folder
    would leave every executor with its own part of a table.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="churnkit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path or URI below the shared checkpoint folder (for lineage-cutting tables)."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), *parts])


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``churnkit`` importable in Python workers (needed only by the
    Arrow-batch operators). The zip is made on the driver; ``addPyFile`` has
    Spark hand it to every executor, also to those that start later."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="churnkit-py-")      # the driver serves the zip from here while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "churnkit.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for at, _, names in os.walk(pkg_dir):
            for name in names:
                if name.endswith(".py"):
                    source = os.path.join(at, name)
                    z.write(source, os.path.relpath(source, os.path.dirname(pkg_dir)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)

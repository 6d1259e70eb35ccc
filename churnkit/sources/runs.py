"""Scoring runs and the report catalogue.

Runs are one Parquet table partitioned by ``run_id``; saving a run replaces
only its own partition (dynamic overwrite), loading filters on it (partition
pruning). Report CSVs are catalogued with Spark's file metadata columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from churnkit import constants as K
from churnkit.functions.numeric import half_even
from churnkit.sources.files import hadoop_path, path_exists


def save_run(results: DataFrame, base: str, run_id: str) -> str:
    """Write one run's scored rows under ``run_id=<id>``."""
    (results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(base))
    return base


def read_runs(spark: SparkSession, base: str) -> DataFrame:
    """The run store; ``run_id`` stays text, also where all ids are digits."""
    found = spark.read.parquet(base)
    fields = [StructField(f.name, StringType() if f.name == "run_id" else f.dataType) for f in found.schema]
    return spark.read.schema(StructType(fields)).parquet(base)


def load_run(spark: SparkSession, base: str, run_id: str) -> DataFrame | None:
    """The run's rows, or None when the store or the run is absent; any
    other trouble with the store is an error."""
    if not path_exists(spark, f"{base.rstrip('/')}/run_id={run_id}"):
        return None
    return read_runs(spark, base).where(F.col("run_id") == run_id).drop("run_id")


def report_name(run_id: str) -> str:
    return f"{K.REPORT_PREFIX}{run_id}.csv"


def run_id_of(name_col) -> F.Column:
    """Run id from a report name (prefix + id + .csv), else null."""
    rx = "^" + K.REPORT_PREFIX.replace(".", r"\.") + r"(.+)\.csv$"
    return F.nullif(F.regexp_extract(name_col, rx, 1), F.lit(""))


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """(filename, length, modificationTime) of a folder through the Hadoop
    FileSystem API (works for HDFS/object stores; lists empty files too,
    which Spark's file sources skip). One row per file: metadata only."""
    fs, path = hadoop_path(spark, directory)
    rows = [(st.getPath().getName(), int(st.getLen()), int(st.getModificationTime()))
            for st in fs.listStatus(path) if st.isFile()]
    df = spark.createDataFrame(rows, "filename string, length long, mtime_ms long")
    return df.select("filename", "length", F.timestamp_millis("mtime_ms").alias("modificationTime"))


def report_catalogue(spark: SparkSession, reports_dir: str, runs_base: str | None = None) -> DataFrame:
    """Name, KB (1 decimal), modified time, rows (lines - 1, at least 0),
    whether the run can be reviewed; name descending.

    File size and time come from a file listing (empty files included);
    line counts from one text scan grouped by the file-name metadata column.
    """
    files = list_files(spark, reports_dir).where(F.lower("filename").endswith(".csv"))
    lines = (spark.read.text(reports_dir).select(F.col("_metadata.file_name").alias("filename"))
             .groupBy("filename").agg(F.count(F.lit(1)).alias("lines")))
    cat = files.join(lines, "filename", "left")
    cat = cat.withColumn("run_id", run_id_of(F.col("filename")))
    if runs_base and path_exists(spark, runs_base):
        runs = (read_runs(spark, runs_base).select("run_id").distinct()
                .withColumn("dashboard_available", F.lit(True)))
        cat = cat.join(runs, "run_id", "left")   # one row per run; AQE picks the join
    else:
        cat = cat.withColumn("dashboard_available", F.lit(None).cast("boolean"))
    return (cat.select("filename",
                       half_even(F.col("length") / F.lit(1024.0), 1).alias("size_kb"),
                       F.date_format("modificationTime", "dd MMM yyyy, hh:mm a").alias("modified"),
                       F.greatest(F.coalesce(F.col("lines"), F.lit(0)) - 1, F.lit(0)).alias("row_count"),
                       F.coalesce("dashboard_available", F.lit(False)).alias("dashboard_available"))
            .orderBy(F.desc("filename")))


def review_run(spark: SparkSession, filename: str, runs_base: str) -> DataFrame | None:
    """Re-open an old run by its report name (prefix and .csv required)."""
    if not (filename.startswith(K.REPORT_PREFIX) and filename.endswith(".csv")):
        return None
    return load_run(spark, runs_base, filename[len(K.REPORT_PREFIX):-4])


def reopened_kpis(spark: SparkSession, filename: str, runs_base: str) -> DataFrame | None:
    """The console KPI row (D21) of a run opened again by its report name."""
    from churnkit.operators.scoring import console_kpis
    rows = review_run(spark, filename, runs_base)
    return None if rows is None else console_kpis(rows)

"""CSV / Parquet scans and sinks, upload guards, query-file export, JDBC."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from churnkit import constants as K
from churnkit.operators import ordinal


class UploadError(ValueError):
    """The uploaded file cannot be scored (message as shown to the user)."""


def null_tokens(df: DataFrame, tokens=K.CSV_NULL_TOKENS) -> DataFrame:
    """pandas' missing-value tokens become null in every string column."""
    toks = [t for t in tokens]
    return df.withColumns({c: F.when(F.col(c).isin(toks), None).otherwise(F.col(c))
                           for c, t in df.dtypes if t == "string"})


#: Cells keep their text: empty ones become null by the token list only.
_NEVER = "\u0000"
_EXTRA = "__extra"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path or URI, for any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def content_bytes(spark: SparkSession, path: str) -> int:
    fs, p = hadoop_path(spark, path)
    return int(fs.getContentSummary(p).getLength())


def _csv_reader(spark: SparkSession, multi_line: bool):
    """RFC 4180 cells: a quote inside quotes is doubled."""
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
            .option("nullValue", _NEVER).option("emptyValue", "").option("multiLine", multi_line))


def read_csv(spark: SparkSession, path: str, multi_line: bool = False, strict: bool = True) -> DataFrame:
    """A1: header CSV as all-string columns (never ``inferSchema``), then the
    null-token mapping; ``row_no`` counts from 0 in input order (file path,
    block, position).

    ``multi_line`` reads quoted line breaks; such files can't be split. A row
    with fewer fields than the header ends in nulls; one with more is an
    :class:`UploadError` (``strict``) when it is read, never cut silently.
    """
    names = _csv_reader(spark, multi_line).csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in [*names, _EXTRA]])
    df = _csv_reader(spark, multi_line).schema(schema).csv(path)
    place = df.withColumns({"__split": F.struct("_metadata.file_path", "_metadata.file_block_start"),
                            "__at": F.monotonically_increasing_id()})
    if strict:
        # on the first column, which every reader of the table keeps in its scan
        first = f"`{names[0]}`"
        place = place.withColumn(names[0], F.when(F.col(_EXTRA).isNull(), F.col(first)).otherwise(
            F.raise_error(F.lit("more fields than the header has"))))
    numbered = ordinal.row_number(null_tokens(place.drop(_EXTRA)) if strict else null_tokens(place),
                                  [F.col("__at")], F.col("__split"), "row_no")
    return numbered.withColumn("row_no", F.col("row_no") - 1).drop("__split", "__at")


def allowed_file(filename: str) -> bool:
    return os.path.splitext(filename)[1].lower().lstrip(".") in K.ALLOWED_EXTENSIONS


def read_upload(spark: SparkSession, path: str | None, max_rows: int | None = None,
                multi_line: bool = True) -> DataFrame:
    """A4: guarded upload scan with the original error texts. The row cap is
    optional (off by default); it is checked with ``limit(cap + 1)``."""
    if not path:
        raise UploadError("No file was selected. Please choose a CSV file to upload.")
    if not allowed_file(path.rstrip("/").rsplit("/", 1)[-1]):
        raise UploadError("Invalid file type. Only .csv files are supported.")
    if content_bytes(spark, path) == 0:
        raise UploadError("The uploaded file is empty.")
    df = read_csv(spark, path, multi_line, strict=False)
    if df.columns in ([], [_EXTRA, "row_no"]):
        raise UploadError("The uploaded CSV file has no data.")
    if not df.where(F.col(_EXTRA).isNotNull()).isEmpty():
        raise UploadError("The uploaded file could not be parsed as a valid CSV.")
    df = df.drop(_EXTRA)
    if df.isEmpty():
        raise UploadError("The uploaded CSV contains no customer rows.")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise UploadError(f"The uploaded CSV has too many rows (max {max_rows:,}).")
    return df


def write_csv(df: DataFrame, path: str) -> str:
    """A5: header CSV without index (one directory of part files)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_segments(df: DataFrame, path: str, segment_col: str = "Risk_Segment",
                   fmt: str = "csv") -> str:
    """One output per segment in a single pass (``partitionBy``)."""
    (df.write.mode("overwrite").option("header", True).partitionBy(segment_col).format(fmt).save(path))
    return path


def write_layout(df: DataFrame, path: str, partition_col: str = "Contract",
                 sort_cols: tuple[str, ...] = ("ChurnValue", "tenure"), tasks: int | None = None) -> str:
    """The index access paths re-aimed as layout: directories by contract
    (partition pruning) and row groups sorted by churn value and tenure
    (min/max statistics let Parquet skip row groups on those filters).

    Rows are range-partitioned over contract and sort columns, so a contract
    that most customers have is written by many tasks (``tasks``; by default
    as many as the session's shuffle partitions)."""
    keys = [partition_col, *sort_cols]
    ranged = df.repartitionByRange(tasks, *keys) if tasks else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(partition_col).parquet(path)
    return path


def export_query(spark: SparkSession, sql_text: str, out_path: str, views: dict[str, DataFrame]) -> str:
    """A3: run a query text over named views and write the result as CSV."""
    result = spark.sql(sql_text, **views)
    return write_csv(result, out_path)


def read_sql(spark: SparkSession, url: str, query: str, properties: dict | None = None,
             partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
             num_partitions: int = 1) -> DataFrame:
    """A2: database query scan. With ``partition_column`` the read is split
    into ``num_partitions`` range queries that run in parallel. Untested here:
    no database is reachable from the test environment."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
             .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", num_partitions))
    else:
        r = r.option("query", query)
    return r.load()

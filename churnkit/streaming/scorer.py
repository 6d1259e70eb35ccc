"""Score customer records as they arrive (Structured Streaming).

Files with the scoring-input columns land in a folder; each micro-batch is
validated (B18), cleaned with a FROZEN MonthlyCharges median (a stream has no
batch to take the median of), given ids that no two rows of the stream share
(``ROW-<file>-<n>`` for the n-th blank id of a file), then scored with exactly
the batch operators. The job is stateless, so it needs
no watermark; ``foreachBatch`` writes results and rejects to per-batch
folders, which makes a replayed batch overwrite rather than duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from churnkit import constants as K
from churnkit.operators.clean import clean_accounts, validate_records
from churnkit.operators.scoring import bulk_results, score
from churnkit.sources.files import null_tokens

INPUT_SCHEMA = StructType([StructField(c, StringType(), True) for c in K.RAW_COLUMNS])


_FILE, _BLOCK, _AT = "__file", "__block", "__at"


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` of a file source with their file and the start of their split in it."""
    return rows.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK))


def fill_ids(batch: DataFrame) -> DataFrame:
    """Blank ids of placed rows become ``ROW-<hash of the file>-<n>``, n
    counting the file's blank ids in its order.

    A file belongs to one micro-batch, so ids stay unique over all batches, equal
    records get different ones, and a replayed batch gets the same again. Only
    rows with a blank id are numbered, file by file; a single file bounds the
    rows of a task."""
    blank = F.trim(F.coalesce(F.col("customerID"), F.lit(""))) == ""
    d = batch.withColumn(_AT, F.monotonically_increasing_id())        # rises inside a split
    nth = F.row_number().over(Window.partitionBy(_FILE).orderBy(_BLOCK, _AT))
    made = F.concat(F.lit("ROW-"), F.substring(F.sha2(F.col(_FILE), 256), 1, 16), F.lit("-"), nth.cast("string"))
    numbered = d.where(blank).withColumn("customerID", made)
    return d.where(~blank).unionByName(numbered).drop(_FILE, _BLOCK, _AT)


def score_batch(batch: DataFrame, frozen_monthly_median: float) -> tuple[DataFrame, DataFrame]:
    """Valid-row results and rejected rows of one batch (pure DataFrame work).
    Rows that are not ``placed`` get ids by a hash of their fields."""
    v = validate_records(null_tokens(batch))
    ok = v.where(F.col("validation_error").isNull()).drop("validation_error")
    bad = v.where(F.col("validation_error").isNotNull())
    ok = ok.withColumn("row_no", F.lit(None).cast("long"))
    results = bulk_results(score(clean_accounts(ok, id_mode="hash", frozen_monthly_median=frozen_monthly_median)))
    return results.drop("row_no"), bad


def start(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
          frozen_monthly_median: float, available_now: bool = True, max_files_per_trigger: int = 100):
    """Start the scorer; returns the StreamingQuery."""
    stream = (spark.readStream.schema(INPUT_SCHEMA).option("header", True).option("escape", '"')
              .option("maxFilesPerTrigger", max_files_per_trigger).csv(input_dir))
    stream = placed(stream)

    def sink(batch: DataFrame, batch_id: int) -> None:
        kept = fill_ids(batch).persist()                        # read once, written as results and as rejects
        try:
            results, rejected = score_batch(kept, frozen_monthly_median)
            results.write.mode("overwrite").parquet(f"{output_dir}/results/batch={batch_id}")
            rejected.write.mode("overwrite").parquet(f"{output_dir}/rejected/batch={batch_id}")
        finally:
            kept.unpersist()

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_results(spark: SparkSession, output_dir: str) -> DataFrame:
    return spark.read.parquet(f"{output_dir}/results")

"""Registered queries of sources, sinks, stores and the stream.

Each one takes the accounts rows, sends them out below the shared folder
through the sink, reads them back through the source, and returns what came
back; the oracle states the same rows from the tables alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.operators import clean as C
from churnkit.operators import features as FT
from churnkit.operators import scoring as S
from churnkit.plans import oracle_sql as O
from churnkit.plans.catalog import (_VALID_SQL, _missing_sql, _pyfloat_sql, campaign, cleaned, raw, register,
                                    scored)
from churnkit.session import shared_path
from churnkit.sources import files as FS
from churnkit.sources import runs as RS
from churnkit.streaming import scorer

_TEXT = list(K.RAW_COLUMNS)
_TOKENS = ", ".join(O.q(t) for t in K.CSV_NULL_TOKENS)
_READ_BACK = ", ".join(f"case when {c} in ({_TOKENS}) then null else {c} end as {c}" for c in _TEXT)


def _place(spark: SparkSession, name: str) -> str:
    return shared_path(spark, "churnkit-io", f"{name}-{uuid.uuid4().hex}")


def _in_order(df: DataFrame, columns) -> DataFrame:
    """Rows in input order over part files whose names follow it."""
    return df.repartitionByRange("row_no").sortWithinPartitions("row_no").select(*columns)


def _sent(spark: SparkSession, sf_dir: str, name: str) -> str:
    return FS.write_csv(_in_order(raw(spark, sf_dir), _TEXT), _place(spark, name) + ".csv")


_A1_SQL = O.with_raw(f"select row_number() over (order by row_no) - 1 as row_no, {_READ_BACK} from accounts_raw")


@register("a1_csv_round_trip", _A1_SQL)
def q_a1(spark, sf_dir):
    return FS.read_csv(spark, _sent(spark, sf_dir, "a1")).select("row_no", *_TEXT)


@register("a4_upload_rows", _A1_SQL)
def q_a4(spark, sf_dir):
    return FS.read_upload(spark, _sent(spark, sf_dir, "a4")).select("row_no", *_TEXT)


@register("a3_query_export", O.with_cleaned(
    "select Contract, cast(count(*) as varchar) as customers from cleaned group by Contract"))
def q_a3(spark, sf_dir):
    path = FS.export_query(spark, "select Contract, count(*) as customers from {accounts} group by Contract",
                           _place(spark, "a3"), {"accounts": cleaned(spark, sf_dir)})
    return FS.read_csv(spark, path).select("Contract", "customers")


_RESULT = ['"Customer ID"', '"Churn Probability"', '"Prediction"', '"Risk Level"', '"Monthly Charges"', '"Tenure"',
           '"Contract"', '"Recommendation"']
_RESULT_NAMES = [c.strip('"') for c in _RESULT]
_TYPED = {"Churn Probability": "double", "Monthly Charges": "double", "Tenure": "int"}


def _results(spark, sf_dir):
    return S.bulk_results(scored(spark, sf_dir))


@register("a5_results_csv", O.with_results(
    f"select row_number() over (order by row_no) - 1 as row_no, {', '.join(_RESULT)} from results"))
def q_a5(spark, sf_dir):
    path = FS.write_csv(_in_order(_results(spark, sf_dir), _RESULT_NAMES), _place(spark, "a5"))
    back = FS.read_csv(spark, path)
    return back.select("row_no", *(F.col(f"`{c}`").cast(_TYPED.get(c, "string")).alias(c) for c in _RESULT_NAMES))


_CAMPAIGN = ["row_no", "Churn_Probability", "Risk_Segment", "Retention_Recommendation", "Potential_Revenue_Saved"]


@register("a6_segment_outputs", O.with_campaign(f"select {', '.join(_CAMPAIGN)} from campaign"))
def q_a6(spark, sf_dir):
    path = FS.write_segments(campaign(spark, sf_dir).select(*_CAMPAIGN), _place(spark, "a6"), fmt="parquet")
    return spark.read.parquet(path).select(*_CAMPAIGN)


def _store(spark, sf_dir, name):
    """A run store with two runs whose ids are digits."""
    base, results = _place(spark, name), _results(spark, sf_dir)
    RS.save_run(results, base, "007")
    RS.save_run(results.where(F.col("Risk Level") == K.RISK_HIGH), base, "8")
    return base


@register("a7_run_store", O.with_results(
    f"select '007' as run, row_no, {', '.join(_RESULT)} from results union all "
    f"select '8', row_no, {', '.join(_RESULT)} from results where \"Risk Level\" = 'High Risk'"))
def q_a7(spark, sf_dir):
    base = _store(spark, sf_dir, "a7")
    one, two = (RS.load_run(spark, base, r).select(F.lit(r).alias("run"), "row_no", *_RESULT_NAMES) for r in ("007", "8"))
    return one.unionByName(two)


@register("a8_report_catalogue", O.with_results("""
select 'churn_predictions_007.csv' as filename, count(*) as row_count, true as dashboard_available from results
union all select 'other.csv', count(*), false from results"""))
def q_a8(spark, sf_dir):
    base, reports = _store(spark, sf_dir, "a8"), _place(spark, "a8-reports")
    fs, folder = FS.hadoop_path(spark, reports)
    fs.mkdirs(folder)
    for name in (RS.report_name("007"), "other.csv"):
        made = _place(spark, "a8-csv")
        FS.write_csv(_results(spark, sf_dir).coalesce(1), made)      # one report is one file, as the user downloads it
        part = next(st.getPath() for st in fs.listStatus(FS.hadoop_path(spark, made)[1]) if st.getPath().getName().startswith("part-"))
        fs.rename(part, FS.hadoop_path(spark, f"{reports}/{name}")[1])
    return RS.report_catalogue(spark, reports, base).select("filename", "row_count", "dashboard_available")


@register("a9_reopened_run", O.with_results("""
select count(*) as total_customers, count(*) filter (where "Prediction" = 'Likely to Churn') as predicted_churners,
  count(*) filter (where "Risk Level" = 'High Risk') as high_risk_count,
  """ + O.rint('avg("Churn Probability")', 1) + """ as avg_churn_probability,
  """ + O.rint('avg("Tenure")', 1) + """ as avg_tenure from results"""))
def q_a9(spark, sf_dir):
    base = _store(spark, sf_dir, "a9")
    return RS.reopened_kpis(spark, RS.report_name("007"), base).select(
        "total_customers", "predicted_churners", "high_risk_count", "avg_churn_probability", "avg_tenure")


@register("a11_layout", O.with_cleaned(
    "select Contract, ChurnValue, tenure, row_no from cleaned where Contract = 'Month-to-month' and ChurnValue = 1"))
def q_a11(spark, sf_dir):
    path = FS.write_layout(cleaned(spark, sf_dir), _place(spark, "a11"))
    return (spark.read.parquet(path).where((F.col("Contract") == "Month-to-month") & (F.col("ChurnValue") == 1))
            .select("Contract", "ChurnValue", "tenure", "row_no"))


# --- schema steps: B2-B5 --------------------------------------------------------------------------

_LEGACY = {v: k for k, v in K.ALIASES.items() if " " in k}


@register("b4_legacy_names", O.with_raw(f"select row_no, {', '.join(_TEXT)} from accounts_raw"))
def q_b4(spark, sf_dir):
    """The raw table under its legacy headers, brought to the canonical names."""
    legacy = raw(spark, sf_dir).select("row_no", *(F.col(c).alias(f" {_LEGACY.get(c, c)} ") for c in _TEXT))
    return C.require_columns(C.normalize_columns(legacy)).select("row_no", *_TEXT)


@register("b3_drop_columns", O.with_raw("select row_no, customerID, Contract, ChurnValue from accounts_raw"))
def q_b3(spark, sf_dir):
    kept = {"row_no", "customerID", "Contract", "ChurnValue"}
    df = raw(spark, sf_dir)
    strict = C.drop_columns(df, [c for c in df.columns if c not in kept])
    return C.drop_columns(strict, ["Count", "Lat_Long"], strict=False)


@register("b2_select_all", O.with_raw("select * from accounts_raw"))
def q_b2(spark, sf_dir):
    return raw(spark, sf_dir)


# --- I1, I3 -----------------------------------------------------------------------------------------

_LEVELS = {"Contract": ["Month-to-month", "One year", "Two year"],
           "PaymentMethod": ["Bank transfer (automatic)", "Credit card (automatic)", "Electronic check", "Mailed check"]}


@register("i1_one_hot", O.with_cleaned("select row_no, " + ", ".join(
    f"cast(case when {c} = {O.q(v)} then 1 else 0 end as integer) as {O.ident(c + '_' + v)}"
    for c, vs in _LEVELS.items() for v in vs[1:]) + " from cleaned"))
def q_i1(spark, sf_dir):
    df = cleaned(spark, sf_dir).select("row_no", *_LEVELS)
    return FT.one_hot_drop_first(df, list(_LEVELS), FT.category_levels(df, list(_LEVELS)))


@register("i3_vector", O.with_scored(
    "select row_no, cast(ChurnValue as double) as label, 30 as size, " + O.rint(" + ".join(
        f"{i + 1} * cast({O.ident(f)} as double)" for i, f in enumerate(K.FEATURE_COLUMNS)), 4)
    + " as weighted from features"))
def q_i3(spark, sf_dir):
    """The assembled vector; its places are checked by a place-weighted sum."""
    from pyspark.ml.functions import vector_to_array

    from churnkit.functions.numeric import half_even
    v = FT.assemble(FT.add_features(cleaned(spark, sf_dir))).withColumn("v", vector_to_array("features"))
    total = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("row_no", "label", F.size("v").alias("size"), half_even(total, 4).alias("weighted"))


# --- J1 ---------------------------------------------------------------------------------------------

_VALID = (_VALID_SQL.lstrip().lstrip(",").replace("\nselect row_no, case when", ",\nvalid as (select row_no, case when")
          .format(ten=_pyfloat_sql("tenure"), mon=_pyfloat_sql("MonthlyCharges"), missing=_missing_sql) + ")")


_ANY_ROW_ID = "case when \"Customer ID\" like 'ROW-%' then 'ROW' else \"Customer ID\" end"
_RESULT_BUT_ID = [f"{_ANY_ROW_ID} as \"Customer ID\"" if "Customer ID" in c else c for c in _RESULT]


def _streamed(spark, sf_dir, name):
    """Records streamed in as files, scored."""
    source = _sent(spark, sf_dir, name)
    out, marks = _place(spark, f"{name}-out"), _place(spark, f"{name}-marks")
    scorer.start(spark, source, out, marks, frozen_monthly_median=70.0).awaitTermination()
    return scorer.read_results(spark, out)


@register("j1_stream_scored", O.with_results(
    f"select {', '.join(_RESULT_BUT_ID)} from results where row_no in (select row_no from valid where validation_error is null)", _VALID))
def q_j1(spark, sf_dir):
    """Records streamed in as files come out as the batch scores them. A stream
    numbers blank ids by file, a batch over all rows; both are shown as ROW."""
    own = F.when(F.col("Customer ID").startswith("ROW-"), F.lit("ROW")).otherwise(F.col("Customer ID"))
    return _streamed(spark, sf_dir, "j1").withColumn("Customer ID", own).select(*_RESULT_NAMES)


@register("j1_stream_ids", O.with_results(
    "select count(*) as records, count(*) as ids from results where \"Customer ID\" like 'ROW-%' "
    "and row_no in (select row_no from valid where validation_error is null)", _VALID))
def q_j1c(spark, sf_dir):
    """Records that came with a blank id, and their different ids."""
    made = _streamed(spark, sf_dir, "j1i").where(F.col("Customer ID").startswith("ROW-"))
    return made.agg(F.count("*").alias("records"), F.count_distinct("Customer ID").alias("ids"))


@register("j1_stream_rejected", O.with_raw("").rstrip() + ", " + _VALID + """
select validation_error, count(*) as records from valid where validation_error is not null group by validation_error""")
def q_j1b(spark, sf_dir):
    """Records that fail validation, by the text they are turned away with."""
    source = _sent(spark, sf_dir, "j1r")
    out, marks = _place(spark, "j1r-out"), _place(spark, "j1r-marks")
    scorer.start(spark, source, out, marks, frozen_monthly_median=70.0).awaitTermination()
    return (spark.read.parquet(f"{out}/rejected").groupBy("validation_error").agg(F.count("*").alias("records")))

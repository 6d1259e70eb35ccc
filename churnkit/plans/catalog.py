"""Query catalogue: one entry per inventory ID.

Each entry pairs a Spark job ``(spark, sf_dir) -> DataFrame`` with the DuckDB
statement that computes the same result (or ``None`` where the operator is
not expressible in SQL, e.g. model training). ``__spark_entry__`` exposes
both dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window

from churnkit.functions.numeric import half_even
from churnkit.operators import clean as C
from churnkit.operators import kpi as KPI
from churnkit.plans import oracle_sql as O
from churnkit.plans.stages import key as stage_key
from churnkit.plans.stages import staged
from churnkit.session import shared_path
from churnkit.sources.tables import accounts_raw

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Job) -> Job:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracted accounts table (the original's extraction step writes it
    to a file; here Parquet below the shared checkpoint folder)."""
    return staged(spark, "raw", sf_dir, lambda: accounts_raw(spark, sf_dir))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned accounts (B19), materialised once per application."""
    return staged(spark, "cleaned", sf_dir, lambda: C.clean_accounts(raw(spark, sf_dir)))


# --- cleaning ---------------------------------------------------------------

CLEAN_COLS = ["row_no", "customerID", "gender", "SeniorCitizen", "Partner", "Dependents",
              "tenure", "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
              "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
              "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
              "MonthlyCharges", "TotalCharges"]


@register("b19_clean_accounts", O.with_cleaned(
    "select " + ", ".join(CLEAN_COLS) + " from cleaned"))
def q_b19(spark, sf_dir):
    return cleaned(spark, sf_dir).select(*CLEAN_COLS)


# --- KPI views ----------------------------------------------------------------

@register("d9_kpi_row", O.with_cleaned("""
select count(*) as TotalCustomers,
       cast(sum(case when ChurnValue = 1 then 1 else 0 end) as bigint) as ChurnedCustomers,
       cast(sum(case when ChurnValue = 0 then 1 else 0 end) as bigint) as RetainedCustomers
from cleaned"""))
def q_d9(spark, sf_dir):
    return KPI.kpi_row(cleaned(spark, sf_dir))


@register("d10_contract_analysis", O.with_cleaned("""
select Contract, count(*) as TotalCustomers,
       round_even(avg(MonthlyCharges) * 1000000.0e0, 0) / 1000000.0e0 as AvgMonthlyCharges
from cleaned group by Contract"""))
def q_d10(spark, sf_dir):
    return KPI.contract_analysis(cleaned(spark, sf_dir))


# --- raw-table checks (validation, nulls, duplicates) ------------------------------

from pyspark.sql import functions as F  # noqa: E402

from churnkit.operators import explain as X  # noqa: E402
from churnkit.operators import profile as PR  # noqa: E402
from churnkit.operators import scoring as S  # noqa: E402
from churnkit.operators.features import feature_frame  # noqa: E402

RAW_TEXT = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
            "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
            "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
            "PaymentMethod", "MonthlyCharges", "TotalCharges", "City", "State", "ZipCode", "ChurnReason"]


def scored(spark, sf_dir):
    return S.score(cleaned(spark, sf_dir))


def campaign(spark, sf_dir):
    return S.campaign_frame(scored(spark, sf_dir))


_nulls_sql = " union all ".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as null_count from accounts_raw"
    for c in ["row_no", "k"] + RAW_TEXT[:20] + ["City", "State", "ZipCode", "ChurnValue", "ChurnScore", "CLTV",
                                               "ChurnReason"])


@register("d2_null_counts", O.with_raw(_nulls_sql))
def q_d2(spark, sf_dir):
    return PR.null_counts(raw(spark, sf_dir))


@register("d2_null_customer_id", O.with_raw(
    "select count(*) filter (where customerID is null) as NullCustomerID from accounts_raw"))
def q_d2b(spark, sf_dir):
    return PR.null_count_of(raw(spark, sf_dir), "customerID", "NullCustomerID")


@register("d3_duplicate_keys", O.with_raw(
    "select customerID, count(*) as KeyCount from accounts_raw group by customerID having count(*) > 1"))
def q_d3(spark, sf_dir):
    return PR.duplicate_keys(raw(spark, sf_dir), "customerID")


_biz = ", ".join(["k"] + RAW_TEXT[:20] + ["City", "State", "ZipCode", "ChurnValue", "ChurnScore", "CLTV",
                                          "ChurnReason"])


@register("d4_repeated_rows", O.with_raw(
    f"select cast(coalesce(sum(c - 1), 0) as bigint) as DuplicateRows from "
    f"(select count(*) as c from accounts_raw group by {_biz})"))
def q_d4(spark, sf_dir):
    return PR.repeated_rows(raw(spark, sf_dir))


_VALID_SQL = r"""
, v as (select *, {ten} as ten, {mon} as mon from accounts_raw),
v2 as (select *, ten is not null and not isnan(ten) and abs(ten) <> 'inf'::double as ten_ok,
        case when ten >= 0 then floor(ten) else ceil(ten) end as ten_trunc,
        concat_ws(', ', {missing}) as missing from v)
select row_no, case when missing <> '' then 'Missing required field(s): ' || missing
  when not ten_ok then '''tenure'' must be a whole number of months.'
  when ten_trunc < 0 or ten_trunc > 100 then '''tenure'' must be between 0 and 100 months.'
  when mon is null then '''MonthlyCharges'' must be numeric.' end as validation_error
from v2"""


def _pyfloat_sql(c):
    pat = C.FLOAT_TEXT.replace("'", "''")
    return (f"(case when regexp_matches(cast({c} as varchar), '{pat}') then "
            f"try_cast(replace(trim(cast({c} as varchar)), '_', '') as double) end)")


_missing_sql = ", ".join(f"case when {c} is null or cast({c} as varchar) = '' then '{c}' end"
                         for c in RAW_TEXT[1:19])


@register("b18_validate_records", O.with_raw("").rstrip() + _VALID_SQL.format(
    ten=_pyfloat_sql("tenure"), mon=_pyfloat_sql("MonthlyCharges"), missing=_missing_sql))
def q_b18(spark, sf_dir):
    return C.validate_records(raw(spark, sf_dir)).select("row_no", "validation_error")


# --- B15, B16: offline cleaning ---------------------------------------------------------------

_B15_TEXT = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
             "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
             "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod", "City", "State", "ZipCode"]
_B15_ALL = ["k", *_B15_TEXT, "tenure", "MonthlyCharges", "TotalCharges", "ChurnValue", "ChurnScore", "CLTV", "ChurnReason"]


@register("b15_clean_for_analysis", O.with_raw("").rstrip() + ("""
, t as (select row_no, k, """ + ", ".join(f"trim({c}) as {c}" for c in _B15_TEXT) + """,
    cast(trunc(""" + O.parse("tenure") + """) as smallint) as tenure,
    cast(""" + O.parse("MonthlyCharges") + """ as float) as MonthlyCharges,
    cast(coalesce(""" + O.parse("TotalCharges") + """, (select median(""" + O.parse("TotalCharges") + """) from accounts_raw)) as float) as TotalCharges,
    cast(ChurnValue as tinyint) as ChurnValue, cast(ChurnScore as smallint) as ChurnScore, cast(CLTV as integer) as CLTV,
    coalesce(trim(ChurnReason), 'Not Churned') as ChurnReason from accounts_raw)
select min(row_no) as row_no, """ + ", ".join(_B15_ALL) + " from t group by all"))
def q_b15(spark, sf_dir):
    return C.clean_for_analysis(raw(spark, sf_dir)).select("row_no", *_B15_ALL)


# --- views and KPI ------------------------------------------------------------------------------

@register("a10_churn_summary_view", O.with_cleaned(
    "select customerID, gender, tenure, Contract, MonthlyCharges, TotalCharges, ChurnValue from cleaned"))
def q_a10(spark, sf_dir):
    return KPI.churn_summary_view(cleaned(spark, sf_dir))


_VIEW_TEXT = """
select 'contract' as source, Contract as name, TotalCustomers as customers from vw_Contract_Analysis
union all select 'kpi', 'churned', ChurnedCustomers from vw_KPI_Churn
union all select 'summary', gender, count(*) from vw_ChurnSummary where ChurnValue = 1 group by gender"""


@register("a10_named_views", O.with_cleaned(_VIEW_TEXT,
    "vw_ChurnSummary as (select customerID, gender, tenure, Contract, MonthlyCharges, TotalCharges, ChurnValue from cleaned)",
    "vw_KPI_Churn as (select cast(count(*) filter (where ChurnValue = 1) as bigint) as ChurnedCustomers from cleaned)",
    "vw_Contract_Analysis as (select Contract, count(*) as TotalCustomers from cleaned group by Contract)"))
def q_a10b(spark, sf_dir):
    """A SQL text over the registered views."""
    KPI.create_views(cleaned(spark, sf_dir))
    return spark.sql(_VIEW_TEXT)


@register("d1_total_records", O.with_cleaned("select count(*) as TotalRecords from cleaned"))
def q_d1(spark, sf_dir):
    return KPI.row_count(cleaned(spark, sf_dir))


@register("d5_churn_counts", O.with_cleaned(
    "select count(*) filter (where ChurnValue = 1) as ChurnedCustomers, "
    "count(*) filter (where ChurnValue = 0) as NotChurnedCustomers from cleaned"))
def q_d5(spark, sf_dir):
    return KPI.churn_counts(cleaned(spark, sf_dir))


@register("d6_churn_rate", O.with_cleaned(
    "select round(cast(count(*) filter (where ChurnValue = 1) as double) * 100.0e0 / cast(count(*) as double), 2) "
    "as ChurnRate from cleaned"))
def q_d6(spark, sf_dir):
    return KPI.churn_rate(cleaned(spark, sf_dir))


@register("d7_customers_by_contract", O.with_cleaned(
    "select Contract, count(*) as CustomerCount from cleaned group by Contract"))
def q_d7(spark, sf_dir):
    return KPI.customers_by_contract(cleaned(spark, sf_dir))


@register("d8_churn_by_contract", O.with_cleaned(
    "select Contract, case when ChurnValue = 1 then 'Churned' else 'Not Churned' end as ChurnStatus, "
    "count(*) as Customers from cleaned group by Contract, ChurnValue order by Contract"))
def q_d8(spark, sf_dir):
    return KPI.churn_by_contract(cleaned(spark, sf_dir))


# --- profiling -------------------------------------------------------------------------------------

@register("d11_value_counts_payment", O.with_cleaned(
    "select PaymentMethod, count(*) as count from cleaned where PaymentMethod is not null "
    "group by PaymentMethod order by count desc, PaymentMethod"))
def q_d11(spark, sf_dir):
    return PR.value_counts(cleaned(spark, sf_dir), "PaymentMethod")


@register("d12_churn_shares", O.with_cleaned(
    "select ChurnValue, count(*) as count, " + O.rint("count(*) * 100.0e0 / sum(count(*)) over ()", 6)
    + " as percent from cleaned where ChurnValue is not null group by ChurnValue"))
def q_d12(spark, sf_dir):
    return PR.value_shares(cleaned(spark, sf_dir), "ChurnValue")


def _crosstab_sql(a):
    return O.with_cleaned(
        f"select {a}, " + ", ".join(
            O.rint(f"count(*) filter (where ChurnValue = {v}) * 100.0e0 / count(*)", 6) + f' as "{v}"'
            for v in (0, 1))
        + f" from cleaned where {a} is not null and ChurnValue is not null group by {a}")


@register("d13_crosstab_contract_churn", _crosstab_sql("Contract"))
def q_d13(spark, sf_dir):
    return PR.crosstab_normalized(cleaned(spark, sf_dir), "Contract", "ChurnValue", [0, 1])


@register("d13_crosstab_payment_churn", _crosstab_sql("PaymentMethod"))
def q_d13b(spark, sf_dir):
    return PR.crosstab_normalized(cleaned(spark, sf_dir), "PaymentMethod", "ChurnValue", [0, 1])


@register("d13_crosstab_senior_churn", _crosstab_sql("SeniorCitizen"))
def q_d13c(spark, sf_dir):
    return PR.crosstab_normalized(cleaned(spark, sf_dir), "SeniorCitizen", "ChurnValue", [0, 1])


@register("d14_mean_charge_by_churn", O.with_cleaned(
    "select ChurnValue, " + O.rint("avg(MonthlyCharges)", 6) + " as mean_MonthlyCharges, "
    + O.rint("avg(tenure)", 6) + " as mean_tenure from cleaned where ChurnValue is not null group by ChurnValue"))
def q_d14(spark, sf_dir):
    return PR.group_mean(cleaned(spark, sf_dir), "ChurnValue", ["MonthlyCharges", "tenure"])


# every numeric column of the cleaned table but its row keys
DESCRIBE_COLS = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "ChurnValue", "ChurnScore", "CLTV"]


def _describe_sql():
    parts = []
    for c in DESCRIBE_COLS:
        x = f"cast({c} as double)"
        parts.append(
            f"select '{c}' as column_name, count({c}) as count, {O.rint(f'avg({x})', 6)} as mean, "
            f"{O.rint(f'stddev_samp({x})', 6)} as std, min({x}) as min, "
            f"{O.rint(f'quantile_cont({x}, 0.25)', 6)} as p25, {O.rint(f'quantile_cont({x}, 0.5)', 6)} as p50, "
            f"{O.rint(f'quantile_cont({x}, 0.75)', 6)} as p75, max({x}) as max from cleaned")
    return O.with_cleaned(" union all ".join(parts))


@register("d23_describe_numeric", _describe_sql())
def q_d23(spark, sf_dir):
    return PR.describe_numeric(cleaned(spark, sf_dir), DESCRIBE_COLS)


TEXT_COLS = [c for c in RAW_TEXT if c not in ("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges")]


@register("d24_describe_text", O.with_cleaned(" union all ".join(
    f"(select '{c}' as column_name, cast(sum(f) as bigint) as count, count(*) as \"unique\", "
    f"first({c} order by f desc, {c}) as top, max(f) as freq from "
    f"(select {c}, count(*) as f from cleaned where {c} is not null group by {c}))"
    for c in TEXT_COLS)))
def q_d24(spark, sf_dir):
    return PR.describe_text(cleaned(spark, sf_dir), TEXT_COLS)


@register("d25_correlation_matrix", O.with_cleaned(" union all ".join(
    f"select '{a}' as x, '{b}' as y, {O.rint(f'corr(cast({a} as double), cast({b} as double))', 6)} as corr from cleaned"
    for a in DESCRIBE_COLS for b in DESCRIBE_COLS)))
def q_d25(spark, sf_dir):
    return PR.correlation_matrix(cleaned(spark, sf_dir), DESCRIBE_COLS)


@register("d26_histogram_monthly", O.with_cleaned("""
, r as (select min(MonthlyCharges) as lo, max(MonthlyCharges) as hi from cleaned),
h as (select case when r.hi = r.lo then 0 else least(cast(floor((MonthlyCharges - r.lo) / ((r.hi - r.lo) / 10.0e0)) as integer), 9) end as bin,
             r.lo, r.hi from cleaned, r where MonthlyCharges is not null)
select bin, """ + O.rint("any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 10.0e0)", 6) + """ as bin_start,
       """ + O.rint("any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 10.0e0)", 6) + """ as bin_end,
       count(*) as count from h group by bin""").replace("\nselect 1", ""))
def q_d26(spark, sf_dir):
    return PR.histogram(cleaned(spark, sf_dir), "MonthlyCharges", 10)


@register("d26_density_monthly", O.with_cleaned("""
, b as (select cast(MonthlyCharges as double) as v from cleaned where MonthlyCharges is not null),
s as (select count(*) as n, stddev_samp(v) * pow(count(*), -0.2e0) as h, min(v) as lo, max(v) as hi from b),
g as (select cast(i as integer) as point, lo + i * ((hi - lo) / 199) as x from s, (select unnest(range(200)) as i))
select point, """ + O.rint("x", 6) + """ as x,
       """ + O.rint("(select sum(exp(-0.5e0 * ((x - v) / h) * ((x - v) / h))) from b) / (n * h * sqrt(2 * pi()))", 5) + """ as density
from g, s"""))
def q_d26_density(spark, sf_dir):
    return PR.density_curve(cleaned(spark, sf_dir), "MonthlyCharges", decimals=5)


@register("d26_density_mass", O.with_cleaned("select 1.0e0 as mass, true as within from cleaned limit 1"))
def q_d26_mass(spark, sf_dir):
    """The area below the curve drawn out to eight bandwidths on both sides."""
    mass = PR.curve_mass(PR.density_curve(cleaned(spark, sf_dir), "MonthlyCharges", cut=8.0))
    return mass.select(half_even("mass", 6).alias("mass"), (F.abs(F.col("mass") - 1) < 1e-6).alias("within"))


def _box_sql(c, by, long=None):
    g = f"{by}, " if by else ""
    gw = f"group by {by}" if by else ""
    j = f"using ({by})" if by else "on true"
    nn = f" and {by} is not null" if by else ""
    source = "values_long" if long else "cleaned"
    return O.with_cleaned(f"""
{", " + long if long else ""}
, b as (select {g}cast({c} as double) as v from {source} where {c} is not null{nn}),
q as (select {g}count(*) as n, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
             quantile_cont(v, 0.75) as q3 from b {gw}),
l as (select *, q1 - 1.5e0 * (q3 - q1) as lo_fence, q3 + 1.5e0 * (q3 - q1) as hi_fence from q)
select {g}any_value(n) as n, {O.rint('any_value(q1)', 6)} as q1, {O.rint('any_value(median)', 6)} as median,
       {O.rint('any_value(q3)', 6)} as q3,
       {O.rint('min(case when v >= lo_fence and v <= hi_fence then v end)', 6)} as whisker_low,
       {O.rint('max(case when v >= lo_fence and v <= hi_fence then v end)', 6)} as whisker_high,
       count(*) filter (where not (v >= lo_fence and v <= hi_fence)) as outliers
from b join l {j} {gw}""".replace("\nselect 1", ""))


@register("d27_box_tenure_by_churn", _box_sql("tenure", "ChurnValue"))
def q_d27(spark, sf_dir):
    return PR.box_stats(cleaned(spark, sf_dir), "tenure", "ChurnValue")


@register("d27_box_monthly_by_churn", _box_sql("MonthlyCharges", "ChurnValue"))
def q_d27c(spark, sf_dir):
    return PR.box_stats(cleaned(spark, sf_dir), "MonthlyCharges", "ChurnValue")


@register("d27_box_score_by_churn", _box_sql("ChurnScore", "ChurnValue"))
def q_d27d(spark, sf_dir):
    return PR.box_stats(cleaned(spark, sf_dir), "ChurnScore", "ChurnValue")


@register("d27_box_monthly", _box_sql("MonthlyCharges", None))
def q_d27b(spark, sf_dir):
    return PR.box_stats(cleaned(spark, sf_dir), "MonthlyCharges")


@register("d27_box_all_numeric", _box_sql("value", "column_name", "values_long as (" + " union all ".join(
    f"select '{c}' as column_name, cast({c} as double) as value from cleaned" for c in DESCRIBE_COLS) + ")"))
def q_d27e(spark, sf_dir):
    return PR.box_stats_all(cleaned(spark, sf_dir), DESCRIBE_COLS)


@register("d28_count_payment_by_churn", O.with_cleaned(
    "select PaymentMethod, ChurnValue, count(*) as count from cleaned "
    "where PaymentMethod is not null and ChurnValue is not null group by PaymentMethod, ChurnValue"))
def q_d28(spark, sf_dir):
    return PR.count_by(cleaned(spark, sf_dir), "PaymentMethod", "ChurnValue")


@register("d29_scatter_bins", O.with_cleaned(
    "select cast(floor(tenure / 6.0e0) as bigint) as x_bin, cast(floor(MonthlyCharges / 10.0e0) as bigint) as y_bin, "
    "ChurnValue, count(*) as count from cleaned where tenure is not null and MonthlyCharges is not null "
    "group by all"))
def q_d29(spark, sf_dir):
    return PR.scatter_bins(cleaned(spark, sf_dir), "tenure", "MonthlyCharges", "ChurnValue", 6.0, 10.0)


# --- features and scorecard ------------------------------------------------------------------------

from churnkit import constants as K  # noqa: E402


@register("i2_feature_frame", O.with_scored(
    "select row_no, customerID, " + ", ".join(O.ident(f) for f in K.FEATURE_COLUMNS) + " from features"))
def q_i2(spark, sf_dir):
    return feature_frame(cleaned(spark, sf_dir))


@register("i13_scorecard", O.with_scored("select row_no, customerID, churn_probability from scored"))
def q_i13(spark, sf_dir):
    return scored(spark, sf_dir).select("row_no", "customerID", "churn_probability")


@register("i24_bulk_results", O.with_results(
    'select row_no, "Customer ID", "Churn Probability", "Prediction", "Risk Level", "Monthly Charges", '
    '"Tenure", "Contract", "Recommendation" from results'))
def q_i24(spark, sf_dir):
    return S.bulk_results(scored(spark, sf_dir))


@register("d21_console_kpis", O.with_results(f"""
select count(*) as total_customers, count(*) filter (where "Prediction" = 'Likely to Churn') as predicted_churners,
  {O.rint("count(*) filter (where \"Prediction\" = 'Likely to Churn') / count(*) * 100.0e0", 1)} as churn_rate,
  {O.rint('avg("Churn Probability")', 1)} as avg_churn_probability,
  count(*) filter (where "Risk Level" = 'High Risk') as high_risk_count,
  count(*) filter (where "Risk Level" = 'Medium Risk') as medium_risk_count,
  count(*) filter (where "Risk Level" = 'Low Risk') as low_risk_count,
  {O.rint("count(*) filter (where \"Risk Level\" = 'High Risk') / count(*) * 100.0e0", 1)} as high_risk_pct,
  {O.rint("count(*) filter (where \"Risk Level\" = 'Medium Risk') / count(*) * 100.0e0", 1)} as medium_risk_pct,
  {O.rint("count(*) filter (where \"Risk Level\" = 'Low Risk') / count(*) * 100.0e0", 1)} as low_risk_pct,
  {O.rint('avg("Monthly Charges")', 2)} as avg_monthly_charges,
  {O.rint('avg("Tenure")', 1)} as avg_tenure,
  {O.rint("coalesce(sum(case when \"Risk Level\" in ('High Risk', 'Medium Risk') then \"Monthly Charges\" end), 0.0e0)", 2)} as at_risk_revenue,
  count(*) filter (where "Risk Level" in ('High Risk', 'Medium Risk')) as customers_at_risk,
  count(*) filter (where "Prediction" <> 'Likely to Churn') as likely_to_stay,
  {O.rint("count(*) filter (where \"Prediction\" <> 'Likely to Churn') / count(*) * 100.0e0", 1)} as likely_to_stay_pct
from results having count(*) > 0"""))
def q_d21(spark, sf_dir):
    return S.console_kpis(S.bulk_results(scored(spark, sf_dir)))


def _display_sql(order):
    return O.with_console(f"""
select row_no, customerID as id, {O.rint('churn_probability * 100.0e0', 1)} as probability_pct,
  case when churn_probability >= 0.5e0 then 'Likely to Churn' else 'Likely to Stay' end as prediction,
  risk_level, cast(least(5.0e0, greatest(1.0e0, round_even((1.0e0 - churn_probability) * 5.0e0, 0))) as integer) as signal_bars,
  {O.rint('MonthlyCharges', 2)} as monthly_charges, tenure, Contract as contract,
  array_to_string(plan, '|') as recommendations
from console order by {order}, row_no limit {K.MAX_DISPLAY_ROWS}""")


@register("f3_display_by_probability", _display_sql("probability_pct desc"))
def q_f3a(spark, sf_dir):
    return S.display_records(scored(spark, sf_dir), "probability")


@register("f3_display_by_charges", _display_sql("monthly_charges desc"))
def q_f3b(spark, sf_dir):
    return S.display_records(scored(spark, sf_dir), "charges")


@register("f3_display_by_tenure", _display_sql("tenure asc"))
def q_f3c(spark, sf_dir):
    return S.display_records(scored(spark, sf_dir), "tenure")


# --- linear attribution (SQL form) ---------------------------------------------------------------------

def _means_cte():
    return "bg as (select " + ", ".join(
        f"{O.rint(f'avg({O.ident(f)})', 6)} as m{i}" for i, f in enumerate(K.FEATURE_COLUMNS)) + " from scored)"


def _contrib_cte(src):
    parts = []
    for i, f in enumerate(K.FEATURE_COLUMNS):
        w = O.dbl(K.SCORECARD_WEIGHTS.get(f, 0.0))
        parts.append(f"select row_no, {i} as pos, '{f}' as feature, cast({O.ident(f)} as double) as value, "
                     f"{w} * (cast({O.ident(f)} as double) - bg.m{i}) as phi from {src}, bg")
    return "contrib as (" + " union all ".join(parts) + ")"


_names_case = "case feature " + " ".join(f"when {O.q(k)} then {O.q(v)}" for k, v in K.DRIVER_NAMES.items()) + \
    " else replace(feature, '_', ' ') end"
_numeric_in = ", ".join(O.q(x) for x in K.DRIVER_NUMERIC)


@register("f4_top_risk", O.with_console(f"""
select t.row_no, customerID as id, {O.rint('churn_probability * 100.0e0', 1)} as probability_pct, risk_level,
  cast(least(5.0e0, greatest(1.0e0, round_even((1.0e0 - churn_probability) * 5.0e0, 0))) as integer) as signal_bars,
  {O.rint('MonthlyCharges', 2)} as monthly_charges, tenure, Contract as contract, InternetService as internet_service,
  PaymentMethod as payment_method, d.top_drivers, array_to_string(plan, '|') as recommendations
from top t left join (
  select row_no, string_agg(name, '|' order by rn) as top_drivers from (
    select row_no, {_names_case} as name,
           row_number() over (partition by row_no order by phi desc, pos) as rn
    from contrib where phi > 0 and (feature in ({_numeric_in}) or value = 1.0e0))
  where rn <= {K.TOP_DRIVERS} group by row_no) d on d.row_no = t.row_no""",
    f"top as (select * from console order by churn_probability desc, row_no limit {K.TOP_N_WITH_DRIVERS})",
    _means_cte(), _contrib_cte("top")))
def q_f4(spark, sf_dir):
    return S.top_risk_records(scored(spark, sf_dir))


@register("i19_global_importance", O.with_scored(
    f"select feature as Feature, {O.rint('avg(abs(phi))', 6)} as Importance from contrib group by feature",
    _means_cte(), _contrib_cte("scored")))
def q_i19(spark, sf_dir):
    s = scored(spark, sf_dir)
    return X.global_importance(s, s)


@register("i20_dependence_monthly", O.with_scored(
    f"select row_no, value, {O.rint('phi', 6)} as phi from contrib where feature = 'Monthly Charges'",
    _means_cte(), _contrib_cte("scored")))
def q_i20(spark, sf_dir):
    s = scored(spark, sf_dir)
    return (X.attribution_long(s, s).where(F.col("feature") == "Monthly Charges")
            .select("row_no", "value", "phi"))


@register("i22_expected_value", O.with_scored(
    "select " + O.rint("(" + O.dbl(K.SCORECARD_INTERCEPT) + "".join(
        f" + {O.dbl(K.SCORECARD_WEIGHTS.get(f, 0.0))} * m{i}" for i, f in enumerate(K.FEATURE_COLUMNS)) + ")", 6)
    + " as base_margin, " + O.rint("1.0e0 / (1.0e0 + exp(-(" + O.dbl(K.SCORECARD_INTERCEPT) + "".join(
        f" + {O.dbl(K.SCORECARD_WEIGHTS.get(f, 0.0))} * m{i}" for i, f in enumerate(K.FEATURE_COLUMNS)) + ")))", 6)
    + " as base_probability from bg", _means_cte()))
def q_i22(spark, sf_dir):
    s = scored(spark, sf_dir)
    return X.expected_value(s)


# --- campaign ---------------------------------------------------------------------------------------

@register("h8_campaign_frame", O.with_campaign(
    "select row_no, Churn_Probability, Risk_Segment, Retention_Recommendation, Potential_Revenue_Saved "
    "from campaign"))
def q_h8(spark, sf_dir):
    return campaign(spark, sf_dir).select("row_no", "Churn_Probability", "Risk_Segment",
                                          "Retention_Recommendation", "Potential_Revenue_Saved")


@register("d15_segment_summary", O.with_campaign(
    f"select Risk_Segment, {O.rint('avg(Churn_Probability)', 2)} as Churn_Probability, "
    f"{O.rint('avg(\"Monthly Charges\")', 2)} as \"Monthly Charges\", "
    f"{O.rint('avg(\"Total Charges\")', 2)} as \"Total Charges\" from campaign group by Risk_Segment"))
def q_d15(spark, sf_dir):
    return S.segment_summary(campaign(spark, sf_dir))


@register("d11_segment_counts", O.with_campaign(
    "select Risk_Segment, count(*) as count from campaign where Risk_Segment is not null "
    "group by Risk_Segment order by count desc, Risk_Segment"))
def q_d11b(spark, sf_dir):
    return PR.value_counts(campaign(spark, sf_dir), "Risk_Segment")


@register("d16_revenue_by_segment", O.with_campaign(
    f"select Risk_Segment, {O.rint('sum(\"Monthly Charges\")', 6)} as \"Monthly Charges\" "
    f"from campaign group by Risk_Segment"))
def q_d16(spark, sf_dir):
    return S.revenue_by_segment(campaign(spark, sf_dir))


@register("d18_churn_rate_by_segment", O.with_campaign(
    f"select Risk_Segment, {O.rint('avg(ChurnValue) * 100.0e0', 6)} as Churn_Rate from campaign group by Risk_Segment"))
def q_d18(spark, sf_dir):
    return S.churn_rate_by_segment(campaign(spark, sf_dir))


@register("d17_retention_summary", O.with_campaign(
    f"select Retention_Recommendation, count(Risk_Segment) as Customer_Count, "
    f"{O.rint('avg(Churn_Probability)', 6)} as Avg_Churn_Probability, "
    f"{O.rint('avg(\"Monthly Charges\")', 6)} as Avg_Monthly_Charges, "
    f"{O.rint('sum(Potential_Revenue_Saved)', 6)} as Revenue_Saved from campaign group by Retention_Recommendation"))
def q_d17(spark, sf_dir):
    return S.retention_summary(campaign(spark, sf_dir))


@register("d11_strategy_distribution", O.with_campaign(
    "select Retention_Recommendation as Strategy, count(*) as Customer_Count from campaign "
    "group by Retention_Recommendation order by Customer_Count desc, Strategy"))
def q_d11c(spark, sf_dir):
    return S.strategy_distribution(campaign(spark, sf_dir))


@register("d16_revenue_saved_by_strategy", O.with_campaign(
    f"select Retention_Recommendation, {O.rint('sum(Potential_Revenue_Saved)', 6)} as Potential_Revenue_Saved "
    f"from campaign group by Retention_Recommendation"))
def q_d16b(spark, sf_dir):
    return S.revenue_saved_by_strategy(campaign(spark, sf_dir))


@register("d20_campaign_kpis", O.with_campaign(f"""
select count(*) as total_customers, count(*) filter (where Risk_Segment = 'High Risk') as high_risk_customers,
  {O.rint('sum(Potential_Revenue_Saved)', 2)} as total_potential_revenue_saved,
  {O.rint('avg(Churn_Probability)', 4)} as avg_churn_probability,
  (select Retention_Recommendation from campaign group by Retention_Recommendation
   order by count(*) desc, Retention_Recommendation limit 1) as most_common_strategy
from campaign"""))
def q_d20(spark, sf_dir):
    return S.campaign_kpis(campaign(spark, sf_dir))


@register("d19_most_common_contract", O.with_cleaned(
    "select (select Contract from cleaned where Contract is not null group by Contract "
    "order by count(*) desc, Contract limit 1) as mode"))
def q_d19(spark, sf_dir):
    return PR.most_frequent(cleaned(spark, sf_dir), "Contract")


@register("c3_segment_actions", O.with_campaign("""
, a as (select * from (values ('High Risk', 'Immediate Retention Call'), ('Medium Risk', 'Offer Discount / Promotion'),
                              ('Low Risk', 'Regular Monitoring')) t(Risk_Segment, "Recommended Action"))
select c.Risk_Segment, a."Recommended Action", count(*) as Customers
from campaign c left join a using (Risk_Segment) group by all""".replace("\n, a as", "a as", 0)))
def q_c3(spark, sf_dir):
    camp = S.with_segment_action(campaign(spark, sf_dir), spark)
    return camp.groupBy("Risk_Segment", "Recommended Action").agg(F.count(F.lit(1)).alias("Customers"))


@register("c1_dashboard_master", O.with_campaign("""
select c.row_no, c.customerID, c.Contract, c.MonthlyCharges, c.ChurnValue, m.Churn_Probability, m.Risk_Segment,
  m.Retention_Recommendation, m.Potential_Revenue_Saved,
  cast(coalesce(m.Churn_Probability >= 0.5e0, false) as integer) as Predicted_Churn
from cleaned c left join campaign m using (row_no)"""))
def q_c1(spark, sf_dir):
    return S.dashboard_master(campaign(spark, sf_dir)).select(
        "row_no", "customerID", "Contract", "MonthlyCharges", "ChurnValue", "Churn_Probability",
        "Risk_Segment", "Retention_Recommendation", "Potential_Revenue_Saved", "Predicted_Churn")


@register("c1_key_uniqueness", O.with_cleaned(
    "select cast(sum(c) as bigint) as rows, count(*) as distinct_keys, max(c) <= 1 as is_unique "
    "from (select customerID, count(*) as c from cleaned group by customerID)"))
def q_c1b(spark, sf_dir):
    return S.key_uniqueness(cleaned(spark, sf_dir))


# --- split and evaluation ----------------------------------------------------------------------

from churnkit.operators import evaluate as EV  # noqa: E402

SPLIT_CTES = [
    "sp as (select *, md5(concat_ws('|', customerID, cast(row_no as varchar), '42')) as h "
    "from scored where ChurnValue is not null)",
    "sp2 as (select *, row_number() over (partition by ChurnValue order by h, row_no) as rk, "
    "count(*) over (partition by ChurnValue) as n from sp)",
    "splitted as (select *, case when rk <= round(0.2e0 * n) then 'test' else 'train' end as split from sp2)",
    "ev as (select row_no, ChurnValue as label, churn_probability as score, "
    "case when churn_probability >= 0.5e0 then 1 else 0 end as prediction from splitted where split = 'test')",
]


def with_eval(select_sql):
    return O.with_scored(select_sql, *SPLIT_CTES)


def split_scored(spark, sf_dir):
    return EV.stratified_split(scored(spark, sf_dir))


def test_scores(spark, sf_dir):
    return (split_rows(spark, sf_dir).where(F.col("split") == "test")
            .select("row_no", F.col("ChurnValue").alias("label"), F.col("churn_probability").alias("score"),
                    (F.col("churn_probability") >= K.CHURN_CUTOFF).cast("int").alias("prediction")))


@register("i4_stratified_split", with_eval("select row_no, customerID, ChurnValue, split from splitted"))
def q_i4(spark, sf_dir):
    return split_scored(spark, sf_dir).select("row_no", "customerID", "ChurnValue", "split")


@register("i4_split_sizes", with_eval("select split, ChurnValue, count(*) as rows from splitted group by all"))
def q_i4b(spark, sf_dir):
    return EV.split_sizes(split_scored(spark, sf_dir))


@register("x7_campaign_by_split", O.with_campaign(
    "select splitted.split, campaign.Risk_Segment, count(*) as customers "
    "from campaign join splitted using (row_no) group by all", *SPLIT_CTES[:3]))
def q_x7(spark, sf_dir):
    """Segments of training and held-out customers apart."""
    camp = S.campaign_frame(split_scored(spark, sf_dir))
    return camp.groupBy("split", "Risk_Segment").agg(F.count("*").alias("customers"))


def _r(x):
    return O.rint(x, 6)


_tp = "count(*) filter (where label = 1 and prediction = 1)"
_tn = "count(*) filter (where label = 0 and prediction = 0)"
_fp = "count(*) filter (where label = 0 and prediction = 1)"
_fn = "count(*) filter (where label = 1 and prediction = 0)"


def _div(a, b):
    return f"coalesce(cast({a} as double) / nullif(cast({b} as double), 0), 0.0e0)"


@register("i10_scorecard_metrics", with_eval(
    f"select {_r(_div(f'{_tp} + {_tn}', 'count(*)'))} as accuracy, {_r(_div(_tp, f'{_tp} + {_fp}'))} as precision, "
    f"{_r(_div(_tp, f'{_tp} + {_fn}'))} as recall, {_r(_div(f'2 * {_tp}', f'2 * {_tp} + {_fp} + {_fn}'))} as f1 from ev"))
def q_i10(spark, sf_dir):
    return EV.binary_metrics(test_scores(spark, sf_dir))


@register("i11_confusion_matrix", with_eval(
    "select a.actual, a.predicted, count(ev.row_no) as count from "
    "(select * from (values (0, 0), (0, 1), (1, 0), (1, 1)) t(actual, predicted)) a "
    "left join ev on ev.label = a.actual and ev.prediction = a.predicted group by all"))
def q_i11(spark, sf_dir):
    return EV.confusion_matrix(test_scores(spark, sf_dir))


@register("i12_classification_report", with_eval(f"""
, cm as (select {_tp} as tp, {_tn} as tn, {_fp} as fp, {_fn} as fn from ev),
m as (select *, {_div('tp', 'tp + fp')} as p1, {_div('tp', 'tp + fn')} as r1, {_div('2 * tp', '2 * tp + fp + fn')} as f1,
             {_div('tn', 'tn + fn')} as p0, {_div('tn', 'tn + fp')} as r0, {_div('2 * tn', '2 * tn + fn + fp')} as f0,
             cast(tp + fn as double) as s1, cast(tn + fp as double) as s0 from cm)
select '0' as class, {_r('p0')} as precision, {_r('r0')} as recall, {_r('f0')} as f1_score, cast(s0 as bigint) as support from m
union all select '1', {_r('p1')}, {_r('r1')}, {_r('f1')}, cast(s1 as bigint) from m
union all select 'accuracy', null, null, {_r(_div('tp + tn', 's0 + s1'))}, cast(s0 + s1 as bigint) from m
union all select 'macro avg', {_r('(p0 + p1) / 2')}, {_r('(r0 + r1) / 2')}, {_r('(f0 + f1) / 2')}, cast(s0 + s1 as bigint) from m
union all select 'weighted avg', {_r(_div('p0 * s0 + p1 * s1', 's0 + s1'))}, {_r(_div('r0 * s0 + r1 * s1', 's0 + s1'))},
  {_r(_div('f0 * s0 + f1 * s1', 's0 + s1'))}, cast(s0 + s1 as bigint) from m"""))
def q_i12(spark, sf_dir):
    return EV.classification_report(test_scores(spark, sf_dir))


@register("i14_roc_auc", with_eval(f"""
, s as (select score, count(*) filter (where label = 1) as pos, count(*) filter (where label <> 1) as neg
        from ev where score is not null and label is not null group by score),
c as (select *, sum(neg) over (order by score rows between unbounded preceding and current row) - neg as neg_below from s)
select {_r('sum(pos * (neg_below + neg * 0.5e0)) / (cast(sum(pos) as double) * sum(neg))')} as roc_auc from c"""))
def q_i14(spark, sf_dir):
    return EV.roc_auc(test_scores(spark, sf_dir))


_CUM_DESC = f"""
, s as (select score, count(*) filter (where label = 1) as pos, count(*) filter (where label <> 1) as neg
        from ev where score is not null and label is not null group by score),
c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as tps,
             sum(neg) over (order by score desc rows between unbounded preceding and current row) as fps,
             sum(pos) over () as P, sum(neg) over () as N from s)"""


@register("i15_roc_curve", with_eval(_CUM_DESC + f"""
select null::double as threshold, 0.0e0 as fpr, 0.0e0 as tpr
union all select score, {_r('cast(fps as double) / N')}, {_r('cast(tps as double) / P')} from c"""))
def q_i15(spark, sf_dir):
    return EV.roc_curve(test_scores(spark, sf_dir))


@register("pr_curve", with_eval(_CUM_DESC + f"""
select score as threshold, {_r('cast(tps as double) / (tps + fps)')} as precision, {_r('cast(tps as double) / P')} as recall from c"""))
def q_pr(spark, sf_dir):
    return EV.precision_recall_curve(test_scores(spark, sf_dir))


# --- trained models (checked by what every fit must satisfy) --------------------------------------------------

from churnkit.operators import models as MD  # noqa: E402


def split_rows(spark, sf_dir):
    """Keys, label, the 30 features and the split: what training and testing read, written once."""
    return staged(spark, "split", sf_dir, lambda: split_scored(spark, sf_dir).select(
        "row_no", "customerID", "ChurnValue", "churn_probability", "split", *[F.col(f"`{f}`") for f in K.FEATURE_COLUMNS]))


def _train_test(spark, sf_dir):
    sp = split_rows(spark, sf_dir)
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


def fitted(spark, sf_dir, name):
    """The model family trained on the train split at the original's sizes;
    trained and saved once per application (A12), loaded after that."""
    path = shared_path(spark, "churnkit-models", spark.sparkContext.applicationId, stage_key(spark, name, sf_dir))
    model = MD.load_model(path)
    if model is None:
        train, _ = _train_test(spark, sf_dir)
        n = train.count() if name == "logistic_regression" else None
        MD.save_model(MD.fit(train, name, **({"n_train": n} if n else {})), path)
        model = MD.load_model(path)
    return model


def _model_check(name, keeps_mean):
    """Rows scored and probabilities outside 0..1 per split and label. A model
    whose fit keeps the mean (an unpenalised intercept, leaf averages) must
    give the train split's share of churners back as its mean probability."""
    def job(spark, sf_dir):
        scored_rows = MD.predict(fitted(spark, sf_dir, name), split_rows(spark, sf_dir))
        p = F.col("churn_probability")
        cells = scored_rows.groupBy("split", F.col("ChurnValue").alias("label")).agg(
            F.count("*").alias("rows"), F.count_if(p.isNull() | ~p.between(0.0, 1.0)).alias("outside"), F.sum(p).alias("p"))
        out = cells.select(F.lit(MD.DISPLAY_NAMES[name]).alias("Model"), "split", "label", "rows", "outside", "p")
        if keeps_mean:
            w = Window.partitionBy("split")           # two labels
            gap = F.abs(F.sum("p").over(w) - F.sum(F.col("rows") * F.col("label")).over(w)) / F.sum("rows").over(w)
            out = out.withColumn("mean_kept", F.when(F.col("split") == "train", gap < 1e-3))
        return out.drop("p")
    mean = ", case when split = 'train' then true end as mean_kept" if keeps_mean else ""
    sql = with_eval(f"select '{MD.DISPLAY_NAMES[name]}' as Model, split, ChurnValue as label, count(*) as rows, "
                    f"cast(0 as bigint) as outside{mean} from splitted group by split, ChurnValue")
    return sql, job


for _key, _name, _mean in (("i5_logistic_regression", "logistic_regression", True), ("i6_random_forest", "random_forest", False),
                           ("i7_gradient_boosting", "gradient_boosting", False),
                           ("i8_gradient_boosting_fast", "gradient_boosting_fast", False), ("decision_tree", "decision_tree", True)):
    _sql, _job = _model_check(_name, _mean)
    register(_key, _sql)(_job)


# --- scaling, selection, cross-validation ----------------------------------------------------------

from churnkit.operators import selection as SEL  # noqa: E402

_LONG_TRAIN = ("select ChurnValue as label, unnest([" + ", ".join(
    f"struct_pack(pos := {i}, feature := {O.q(f)}, x := cast({O.ident(f)} as double))" for i, f in enumerate(K.FEATURE_COLUMNS))
    + "], recursive := true) from splitted where split = 'train'")


@register("selection_f_values", with_eval(f"""
, long as ({_LONG_TRAIN}),
m as (select *, avg(x) over (partition by pos) as grand, avg(x) over (partition by pos, label) as mean from long),
v as (select pos, feature, sum((mean - grand) * (mean - grand)) / (count(distinct label) - 1)
             / nullif(sum((x - mean) * (x - mean)) / (count(*) - count(distinct label)), 0) as f from m group by pos, feature),
p as (select *, row_number() over (order by {O.rint('f', 4)} desc nulls last, pos) as place from v)
select feature, {O.rint('f', 4)} as f_value, cast(place as integer) as place, f is not null and place <= 15 as chosen from p"""))
def q_f_values(spark, sf_dir):
    return SEL.f_values(_train_test(spark, sf_dir)[0], 15)


@register("scaled_features", with_eval(
    ", st as (select " + ", ".join(f"avg(cast({O.ident(f)} as double)) as m{i}, stddev_samp(cast({O.ident(f)} as double)) as s{i}"
                                   for i, f in enumerate(K.FEATURE_COLUMNS))
    + " from splitted where split = 'train') select row_no, " + ", ".join(
        O.rint(f"case when s{i} > 0 then (cast({O.ident(f)} as double) - m{i}) / s{i} else 0e0 end", 6) + f" as {O.ident(f)}"
        for i, f in enumerate(K.FEATURE_COLUMNS)) + " from splitted, st"))
def q_scaled(spark, sf_dir):
    """All rows of the split, scaled by what the training rows give."""
    return SEL.standardised(split_rows(spark, sf_dir), _train_test(spark, sf_dir)[0], decimals=6)


_FOLD = "cast(('0x' || substr(md5(concat_ws('|', customerID, cast(row_no as varchar), '42')), 1, 8))::bigint % 5 as integer)"


@register("cv_fold_sizes", with_eval(
    f"select {_FOLD} as fold, ChurnValue as label, count(*) as rows from splitted group by all"))
def q_cv_sizes(spark, sf_dir):
    dealt = SEL.with_fold(split_rows(spark, sf_dir), 5)
    return dealt.groupBy("fold", F.col("ChurnValue").alias("label")).agg(F.count("*").alias("rows"))


@register("cv_out_of_fold", with_eval(f"""
, d as (select {_FOLD} as fold, row_no from splitted)
select fold, count(*) as rows, count(distinct row_no) as row_nos, (select count(*) from d) - count(*) as trained_on,
       cast(0 as bigint) as outside, true as finite from d group by fold"""))
def q_cv(spark, sf_dir):
    """Each row scored once by a tree that was trained on the other folds."""
    scored_rows = SEL.out_of_fold(split_rows(spark, sf_dir).drop("churn_probability"), "decision_tree", 5)
    p = F.col("churn_probability")
    cells = scored_rows.groupBy("fold").agg(
        F.count("*").alias("rows"), F.count_distinct("row_no").alias("row_nos"), F.max("trained_on").alias("trained_on"),
        F.count_if(p.isNull() | ~p.between(0.0, 1.0)).alias("outside"))
    numbers = [F.col(c) for c in ("accuracy", "precision", "recall", "f1")]
    finite = F.forall(F.array(*numbers), lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0))
    return cells.join(SEL.fold_metrics(scored_rows).select("fold", finite.alias("finite")), "fold")


# --- more views: waterfall, derived fields, geography, drift, filters, preview --------------------

from churnkit.functions import rules as R  # noqa: E402


@register("i21_waterfall_first_customer", O.with_scored(f"""
select row_no, feature, value, {O.rint('phi', 6)} as phi,
  row_number() over (order by abs(phi) desc, pos) as step,
  {O.rint('(select ' + O.rint(O.dbl(K.SCORECARD_INTERCEPT) + ''.join(f' + {O.dbl(K.SCORECARD_WEIGHTS.get(f, 0.0))} * m{i}' for i, f in enumerate(K.FEATURE_COLUMNS)), 6) + ' from bg) + sum(phi) over (order by abs(phi) desc, pos rows between unbounded preceding and current row)', 6)} as cumulative_margin
from contrib where row_no = (select min(row_no) from scored)""", _means_cte(),
    _contrib_cte("(select * from scored where row_no = (select min(row_no) from scored))")))
def q_i21(spark, sf_dir):
    s = scored(spark, sf_dir)
    return X.waterfall(s, s, s.select(F.min("row_no")).scalar())


_services = ["PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
             "TechSupport", "StreamingTV", "StreamingMovies"]


@register("h13_derived_fields", O.with_cleaned(
    "select row_no, (" + " + ".join(f"(case when {c} = 'Yes' then 1 else 0 end)" for c in _services)
    + " + (case when InternetService <> 'No' then 1 else 0 end)) as Service_Count, "
    + O.rint("TotalCharges / nullif(cast(tenure as double), 0)", 6) + " as Revenue_Per_Month, "
    + O.rint("MonthlyCharges * tenure", 6) + " as Customer_Value from cleaned"))
def q_h13(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "row_no", R.service_count().alias("Service_Count"),
        half_even(R.revenue_per_month(), 6).alias("Revenue_Per_Month"),
        half_even(R.customer_value(), 6).alias("Customer_Value"))


@register("geo_churn_by_state_city", O.with_cleaned(
    "select State, City, count(*) as Customers, count(*) filter (where ChurnValue = 1) as Churned, "
    + O.rint("count(*) filter (where ChurnValue = 1) * 100.0e0 / count(*)", 6)
    + " as ChurnRate from cleaned where State is not null and City is not null group by State, City"))
def q_geo(spark, sf_dir):
    return PR.churn_by_geography(cleaned(spark, sf_dir))


PSI_EDGES = [30.0, 45.0, 60.0, 75.0, 90.0, 105.0]


def _psi_sql():
    b = " + ".join(f"(case when MonthlyCharges >= {O.dbl(e)} then 1 else 0 end)" for e in PSI_EDGES)
    return with_eval(f"""
, e as (select {b} as bin, count(*) * 1.0e0 / sum(count(*)) over () as e from splitted
        where split = 'train' and MonthlyCharges is not null group by bin),
a as (select {b} as bin, count(*) * 1.0e0 / sum(count(*)) over () as a from splitted
        where split = 'test' and MonthlyCharges is not null group by bin),
j as (select greatest(coalesce(e, 0.0e0), 1e-06) as e, greatest(coalesce(a, 0.0e0), 1e-06) as a
      from e full outer join a using (bin))
select {O.rint('sum((a - e) * ln(a / e))', 6)} as psi from j""")


@register("psi_monthly_train_vs_test", _psi_sql())
def q_psi(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    return EV.population_stability(train, test, "Monthly Charges", PSI_EDGES)


@register("b17_high_risk_actions", O.with_campaign(
    "select row_no, customerID, Retention_Recommendation, Potential_Revenue_Saved from campaign "
    "where Risk_Segment = 'High Risk'"))
def q_b17(spark, sf_dir):
    return (C.where_equals(campaign(spark, sf_dir), "Risk_Segment", K.RISK_HIGH)
            .select("row_no", "customerID", "Retention_Recommendation", "Potential_Revenue_Saved"))


@register("b20_preview", O.with_cleaned(
    "select row_no, customerID, Contract, MonthlyCharges from cleaned order by row_no limit 5"))
def q_b20(spark, sf_dir):
    return C.preview(cleaned(spark, sf_dir), ["customerID", "Contract", "MonthlyCharges"], 5)


_TYPE_NAME = ("case typeof({c}) when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' "
              "when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' end")


_CLEAN_ORDER = ["row_no", "k", *RAW_TEXT[:20], "City", "State", "ZipCode", "ChurnValue", "ChurnScore", "CLTV",
                "ChurnReason"]
_PANDAS_NAME = ("case typeof({c}) when 'BIGINT' then 'int64' when 'INTEGER' then 'int32' "
                "when 'VARCHAR' then 'string' when 'DOUBLE' then 'float64' end")


@register("d30_schema_listing", O.with_cleaned(" union all ".join(
    f"(select {i} as ordinal_position, '{c}' as column_name, {_TYPE_NAME.format(c=c)} as data_type, "
    f"{_PANDAS_NAME.format(c=c)} as pandas_dtype, 'YES' as is_nullable from cleaned limit 1)"
    for i, c in enumerate(_CLEAN_ORDER, start=1))))
def q_d30(spark, sf_dir):
    return PR.schema_listing(spark, cleaned(spark, sf_dir))


_RAW_COLS = ["k"] + RAW_TEXT[:20] + ["City", "State", "ZipCode", "ChurnValue", "ChurnScore", "CLTV", "ChurnReason"]


def _d31_sql():
    parts = [
        "select 'rows' as \"check\", null::varchar as column_name, cast(count(*) as varchar) as value from accounts_raw",
        f"select 'columns', null, '{len(_RAW_COLS)}'",
        *[f"select 'missing', '{c}', cast(count(*) filter (where {c} is null) as varchar) from accounts_raw"
          for c in _RAW_COLS],
        f"select 'duplicate_rows', null, cast(coalesce(sum(n - 1), 0) as varchar) from "
        f"(select count(*) as n from accounts_raw group by {', '.join(_RAW_COLS)})",
        *[f"(select 'dtype', '{c}', {_TYPE_NAME.format(c=c)} from accounts_raw limit 1)" for c in _RAW_COLS],
    ]
    return O.with_raw(" union all ".join(parts))


@register("d31_validation_report", _d31_sql())
def q_d31(spark, sf_dir):
    return PR.validation_report(spark, raw(spark, sf_dir))


def _all_models(spark, sf_dir):
    split_rows(spark, sf_dir)                         # written before the trainings ask for it
    return MD.together({name: partial(fitted, spark, sf_dir, name) for name in MD.MODEL_NAMES})


def _model_scores(spark, sf_dir):
    """Every model's class and probability of each test row, scored once and written: all comparisons read it."""
    return staged(spark, "model_scores", sf_dir, lambda: MD.predictions(
        _all_models(spark, sf_dir), _train_test(spark, sf_dir)[1], keep=("row_no", "churn_probability")))


@register("i16_model_comparison")
def q_i16(spark, sf_dir):
    """I16 + I17: every model family on the same test split, each scored once;
    ``best`` marks the X8 choice."""
    return MD.compare(_all_models(spark, sf_dir), _train_test(spark, sf_dir)[1], scored=_model_scores(spark, sf_dir))


@register("i16_model_totals", with_eval(
    "select m.Model, (select count(*) from ev) as rows, (select count(*) from ev where label = 1) as churners, "
    "cast(0 as bigint) as outside from (select unnest(["
    + ", ".join(O.q(MD.DISPLAY_NAMES[n]) for n in MD.MODEL_NAMES) + "]) as Model) m"))
def q_i16_totals(spark, sf_dir):
    """What the comparison rests on: rows and labelled churners (TP + FN) per model, and predictions that are no class."""
    rows = _model_scores(spark, sf_dir)
    outside = F.col("prediction").isNull() | ~F.col("prediction").isin(0, 1)
    return rows.groupBy("Model").agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 1).alias("churners"),
                                     F.count_if(outside).alias("outside"))


@register("i17_saved_best", with_eval(
    "select label, count(*) as rows, cast(0 as bigint) as differing, true as is_best from ev group by label"))
def q_i17(spark, sf_dir):
    """The best model of the comparison is saved, loaded again and scores the test
    split; ``differing`` rows have another probability than before saving, and ``is_best``
    says that the loaded model's own F1 is the highest of the comparison."""
    models, (_, test), scored_rows = _all_models(spark, sf_dir), _train_test(spark, sf_dir), _model_scores(spark, sf_dir)
    path = shared_path(spark, "churnkit-models", spark.sparkContext.applicationId, stage_key(spark, "best", sf_dir))
    name = MD.save_best(models, test, path, scored=scored_rows)
    again = (MD.predict(MD.load_model(path, force_reload=True), test)
             .select("row_no", "ChurnValue", "churn_probability", "predicted").checkpoint(eager=True))     # read twice
    before = scored_rows.where(F.col("Model") == MD.DISPLAY_NAMES[name]).select("row_no", F.col("churn_probability").alias("before"))
    own = EV.binary_metrics(again, label="ChurnValue", pred="predicted").select("f1")
    highest = MD.compare(models, test, scored=scored_rows).agg(F.max("f1").alias("f1"))
    return again.join(before, "row_no").groupBy(F.col("ChurnValue").alias("label")).agg(
        F.count("*").alias("rows"), F.count_if(~F.col("churn_probability").eqNullSafe(F.col("before"))).alias("differing")
    ).withColumn("is_best", own.scalar() == highest.scalar())


# --- I18: tree attribution (Arrow batches) -------------------------------------------------------------

from churnkit.operators import tree_shap as TS  # noqa: E402


def _explained(spark, sf_dir):
    """Attributions of the whole test split by the 200-tree forest, written once."""
    _, test = _train_test(spark, sf_dir)
    return staged(spark, "explained", sf_dir, lambda: TS.explain(
        test, fitted(spark, sf_dir, "random_forest"), tasks=spark.sparkContext.defaultParallelism))


@register("i18_tree_additivity", with_eval("select count(*) as rows, cast(0 as bigint) as violations from ev"))
def q_i18a(spark, sf_dir):
    """Base value plus attributions is the forest's probability on every test row."""
    model = fitted(spark, sf_dir, "random_forest")
    trees, weights, _ = TS.read_trees(spark, model)
    predicted = MD.predict(model, _train_test(spark, sf_dir)[1]).select("row_no", F.col("churn_probability").alias("output"))
    return TS.additivity(_explained(spark, sf_dir), predicted, TS.expected_value(trees, weights), tolerance=1e-8)


@register("i18_tree_explained_cells", with_eval(
    "select f.feature, count(*) as rows from ev, (select unnest([" + ", ".join(O.q(f) for f in K.FEATURE_COLUMNS)
    + "]) as feature) f group by f.feature"))
def q_i18c(spark, sf_dir):
    return _explained(spark, sf_dir).groupBy("feature").agg(F.count("*").alias("rows"))


@register("i18_tree_importance")
def q_i18b(spark, sf_dir):
    return TS.importance(_explained(spark, sf_dir))


@register("i18_tree_importance_sums", with_eval(
    f"select cast({len(K.FEATURE_COLUMNS)} as bigint) as features, cast(0 as bigint) as differing"))
def q_i18_sums(spark, sf_dir):
    """Each feature's importance is its mean absolute attribution over the test split, within rounding."""
    plain = _explained(spark, sf_dir).groupBy(F.col("feature").alias("Feature")).agg(
        (F.sum(F.abs("phi")) / _train_test(spark, sf_dir)[1].agg(F.count("*")).scalar()).alias("mean_abs"))
    both = TS.importance(_explained(spark, sf_dir)).join(plain, "Feature", "full")
    same = F.coalesce(F.abs(F.col("Importance") - F.col("mean_abs")) <= 1e-6, F.lit(False))
    return both.agg(F.count("*").alias("features"), F.count_if(~same).alias("differing"))


@register("i18_tree_top10_holds", with_eval(
    f"select least({K.TOP_N_WITH_DRIVERS}, count(*)) as rows, cast(0 as bigint) as higher_left_out, "
    "cast(0 as bigint) as without_drivers from ev"))
def q_i18_top(spark, sf_dir):
    """The top list holds test rows with drivers only, and no test row left out has a higher probability."""
    top = q_i18(spark, sf_dir)
    low = top.agg(F.min("churn_probability"))
    rest = (MD.predict(fitted(spark, sf_dir, "random_forest"), _train_test(spark, sf_dir)[1])
            .select("row_no", "churn_probability").join(top.select("row_no"), "row_no", "left_anti")
            .where(F.col("churn_probability") > low.scalar()).agg(F.count("*")))
    empty = F.col("top_drivers").isNull() | (F.col("top_drivers") == "")
    return top.agg(F.count("*").alias("rows"), F.count_if(empty).alias("without_drivers")).select(
        "rows", rest.scalar().alias("higher_left_out"), "without_drivers")


@register("i18_tree_drivers_top10")
def q_i18(spark, sf_dir):
    """The ten most at-risk customers of the test split by the forest's
    probability with their top drivers."""
    _, test = _train_test(spark, sf_dir)
    top = (MD.predict(fitted(spark, sf_dir, "random_forest"), test)
           .orderBy(F.desc("churn_probability"), F.asc("row_no")).limit(K.TOP_N_WITH_DRIVERS)
           .select("row_no", F.col("customerID").alias("id"), "churn_probability"))
    drivers = TS.top_drivers(_explained(spark, sf_dir).join(top.select("row_no"), "row_no", "left_semi"))
    return top.join(drivers, "row_no", "left").select(
        "row_no", "id", "churn_probability", F.array_join("top_drivers", "|").alias("top_drivers"))

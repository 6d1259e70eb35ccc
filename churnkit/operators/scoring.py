"""Scoring, segmentation, recommendations and dashboards (I13, I24, I25, H*,
D15-D22, F3, F4, C1, C3).

The scorecard (I13) is a fixed logistic model written as one Catalyst
expression, so scoring a batch is a narrow projection: no shuffle, no Python,
and the same numbers can be restated in SQL. Trained Spark ML models plug in
through :func:`score_with_model` and produce the same ``churn_probability``
column, after which every downstream operator is identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions import rules as R
from churnkit.functions.cache import session_cached
from churnkit.functions.numeric import half_even, sigmoid
from churnkit.operators.features import add_features

P = "churn_probability"


# --- I13 -------------------------------------------------------------------------

def scorecard_margin(weights: dict[str, float] = K.SCORECARD_WEIGHTS,
                     intercept: float = K.SCORECARD_INTERCEPT) -> Column:
    z = F.lit(float(intercept))
    for f in K.FEATURE_COLUMNS:
        z = z + F.lit(float(weights.get(f, 0.0))) * F.col(f"`{f}`")
    return z


def scorecard_probability(weights: dict[str, float] = K.SCORECARD_WEIGHTS,
                          intercept: float = K.SCORECARD_INTERCEPT) -> Column:
    def build():
        return R.clip_probability(half_even(sigmoid(scorecard_margin(weights, intercept)), K.PROB_DECIMALS))
    if weights is K.SCORECARD_WEIGHTS and intercept == K.SCORECARD_INTERCEPT:
        return session_cached("scorecard", build)
    return build()


def score(cleaned: DataFrame, weights: dict[str, float] = K.SCORECARD_WEIGHTS,
          intercept: float = K.SCORECARD_INTERCEPT) -> DataFrame:
    """Features plus ``churn_probability`` (logistic link, 6 decimals half-even, clipped)."""
    return add_features(cleaned).withColumn(P, scorecard_probability(weights, intercept))


def score_with_model(cleaned: DataFrame, model) -> DataFrame:
    """Class-1 probability of a fitted Spark ML PipelineModel/classifier."""
    from pyspark.ml.functions import vector_to_array
    from churnkit.operators.features import assemble
    feats = assemble(add_features(cleaned), label=None)
    out = model.transform(feats)
    p = vector_to_array(F.col("probability"))[1]
    drop = [c for c in ("features", "rawPrediction", "probability", "prediction") if c in out.columns]
    return out.withColumn(P, R.clip_probability(p)).drop(*drop)


# --- I24: bulk results ----------------------------------------------------------------

def with_console_fields(scored: DataFrame) -> DataFrame:
    """Risk level (console preset) and the retention plan array."""
    s = scored.withColumn("risk_level", session_cached("risk_console", lambda: R.risk_level(F.col(P), "console")))
    return s.withColumn("plan", session_cached("plan", lambda: R.retention_plan(P, "risk_level")))


def bulk_results(scored: DataFrame) -> DataFrame:
    """The eight-column result table of a bulk run (plus ``row_no``)."""
    s = with_console_fields(scored)
    return s.select(
        "row_no",
        F.col("customerID").alias("Customer ID"),
        R.probability_percent(P).alias("Churn Probability"),
        R.prediction_label(P).alias("Prediction"),
        F.col("risk_level").alias("Risk Level"),
        half_even("MonthlyCharges", 2).alias("Monthly Charges"),
        F.col("tenure").alias("Tenure"),
        F.col("Contract"),
        R.plan_summary("plan").alias("Recommendation"))


def console_kpis(results: DataFrame) -> DataFrame:
    """D21 + D22: the console KPI row. Empty input gives no row."""
    n = F.count(F.lit(1))
    churners = F.count_if(F.col("Prediction") == K.LABEL_CHURN)

    def pct(x):
        return half_even(F.try_divide(x.cast("double"), n.cast("double")) * F.lit(100.0), 1)

    hi = F.count_if(F.col("Risk Level") == K.RISK_HIGH)
    med = F.count_if(F.col("Risk Level") == K.RISK_MEDIUM)
    lo = F.count_if(F.col("Risk Level") == K.RISK_LOW)
    at_risk = F.coalesce(F.sum(F.when(F.col("Risk Level").isin(K.RISK_HIGH, K.RISK_MEDIUM),
                                      F.col("Monthly Charges"))), F.lit(0.0))
    out = results.agg(
        n.alias("total_customers"), churners.alias("predicted_churners"),
        pct(churners).alias("churn_rate"),
        half_even(F.avg("Churn Probability"), 1).alias("avg_churn_probability"),
        hi.alias("high_risk_count"), med.alias("medium_risk_count"), lo.alias("low_risk_count"),
        pct(hi).alias("high_risk_pct"), pct(med).alias("medium_risk_pct"), pct(lo).alias("low_risk_pct"),
        half_even(F.avg("Monthly Charges"), 2).alias("avg_monthly_charges"),
        half_even(F.avg("Tenure"), 1).alias("avg_tenure"),
        half_even(at_risk, 2).alias("at_risk_revenue"),
        (hi + med).alias("customers_at_risk"),
        (n - churners).alias("likely_to_stay"),
        pct(n - churners).alias("likely_to_stay_pct"))
    return out.where(F.col("total_customers") > 0)


# --- F3, F4 ---------------------------------------------------------------------------------

SORT_KEYS = {                     # key -> (column, descending)
    "probability": ("probability_pct", True),
    "charges": ("monthly_charges", True),
    "tenure": ("tenure", False),
}


def display_records(scored: DataFrame, sort_by: str = "probability",
                    limit: int = K.MAX_DISPLAY_ROWS) -> DataFrame:
    """one of three display orders (unknown key: probability), stable on
    input order, first ``limit`` rows (a distributed top-k)."""
    s = with_console_fields(scored)
    rec = s.select(
        "row_no", F.col("customerID").alias("id"),
        R.probability_percent(P).alias("probability_pct"),
        R.prediction_label(P).alias("prediction"),
        F.col("risk_level"), R.signal_bars(P).alias("signal_bars"),
        half_even("MonthlyCharges", 2).alias("monthly_charges"),
        F.col("tenure"), F.col("Contract").alias("contract"),
        F.array_join("plan", "|").alias("recommendations"))
    c, desc = SORT_KEYS.get(sort_by, SORT_KEYS["probability"])
    return rec.orderBy(F.desc(c) if desc else F.asc(c), F.asc("row_no")).limit(limit)


def top_risk_records(scored: DataFrame, n: int = K.TOP_N_WITH_DRIVERS,
                     drivers_fn=None) -> DataFrame:
    """the ``n`` most at-risk customers on the unrounded probability,
    with drivers and plan. The limit is applied before attribution, so the
    driver work touches ``n`` rows only."""
    from churnkit.operators.explain import top_drivers
    top = with_console_fields(scored).orderBy(F.desc(P), F.asc("row_no")).limit(n)
    drivers = (drivers_fn or (lambda d: top_drivers(d, background=scored)))(top)
    return drivers.select(
        "row_no", F.col("customerID").alias("id"),
        R.probability_percent(P).alias("probability_pct"), "risk_level",
        R.signal_bars(P).alias("signal_bars"),
        half_even("MonthlyCharges", 2).alias("monthly_charges"), "tenure",
        F.col("Contract").alias("contract"),
        F.col("InternetService").alias("internet_service"),
        F.col("PaymentMethod").alias("payment_method"),
        F.array_join("top_drivers", "|").alias("top_drivers"),
        F.array_join("plan", "|").alias("recommendations"))


# --- I25: one record -----------------------------------------------------------------------

def single_prediction(spark: SparkSession, record: dict, frozen_monthly_median: float = 65.0,
                      means=None, model_name: str = "Scorecard") -> DataFrame:
    """Validate one record and score it with the same operators, in one
    lazy row: probability, labels, plan, drivers, model name and the cleaned
    record. An invalid record raises its validation text when the row is read.

    Batch statistics mean nothing for one row, so the median is frozen, and so
    are ``means``, the 30 background means the drivers compare with (without
    them ``top_drivers`` is null)."""
    from churnkit.operators.clean import clean_accounts, validate_records
    from churnkit.operators.explain import frozen_means, top_drivers
    rec = {str(k): (None if v is None else str(v)) for k, v in record.items()}
    rec.setdefault("TotalCharges", None)            # X13: optional for one record
    if not (rec.get("customerID") or "").strip():
        rec["customerID"] = "ROW-1"                 # the only record is the first blank
    df = spark.range(1).select(F.lit(0).cast("long").alias("row_no"),
                               *(F.lit(v).cast("string").alias(c) for c, v in rec.items()))
    checked = validate_records(df)
    scored = with_console_fields(score(clean_accounts(checked, id_mode="hash",
                                                      frozen_monthly_median=frozen_monthly_median)))
    if means is None:
        scored = scored.withColumn("top_drivers", F.lit(None).cast("array<string>"))
    else:
        scored = top_drivers(scored, None, means=frozen_means(means))
    kept = [c for c in rec if c in scored.columns]
    valid = F.when(F.col("validation_error").isNull(), F.col(P)).otherwise(
        F.raise_error(F.col("validation_error")).cast("double"))
    return scored.select(
        F.col("customerID"), valid.alias("probability"),
        R.probability_percent(P).alias("probability_pct"),
        R.prediction_label(P).alias("prediction_label"), R.will_churn(P).alias("will_churn"),
        "risk_level", R.signal_bars(P).alias("signal_bars"), "plan", "top_drivers",
        F.lit(model_name).alias("model_name"), F.struct(*kept).alias("cleaned_record"))


# --- campaign (notebooks 07-08) -----------------------------------------------------------------

def campaign_frame(scored: DataFrame) -> DataFrame:
    """Segments (campaign preset), recommendation and revenue saved per customer."""
    s = (scored.withColumnRenamed(P, "Churn_Probability")
         .withColumn("Risk_Segment", R.risk_level(F.col("Churn_Probability"), "campaign")))
    return s.withColumns({
        "Retention_Recommendation": session_cached("campaign_rec", R.campaign_recommendation),
        "Potential_Revenue_Saved": R.revenue_saved("Monthly Charges"),
    })


def segment_summary(campaign: DataFrame) -> DataFrame:
    """Mean probability, monthly and total charge per segment, 2 decimals."""
    return campaign.groupBy("Risk_Segment").agg(
        half_even(F.avg("Churn_Probability"), 2).alias("Churn_Probability"),
        half_even(F.avg("Monthly Charges"), 2).alias("Monthly Charges"),
        half_even(F.avg("Total Charges"), 2).alias("Total Charges"))


def revenue_by_segment(campaign: DataFrame, decimals: int = 6) -> DataFrame:
    """Sum of monthly charges per segment."""
    return campaign.groupBy("Risk_Segment").agg(
        half_even(F.sum("Monthly Charges"), decimals).alias("Monthly Charges"))


def churn_rate_by_segment(campaign: DataFrame, decimals: int = 6) -> DataFrame:
    """Actual churn rate per segment, percent."""
    return campaign.groupBy("Risk_Segment").agg(
        half_even(F.avg("ChurnValue") * F.lit(100.0), decimals).alias("Churn_Rate"))


def retention_summary(campaign: DataFrame, decimals: int = 6) -> DataFrame:
    """Count, mean probability, mean charge and revenue per strategy."""
    return campaign.groupBy("Retention_Recommendation").agg(
        F.count("Risk_Segment").alias("Customer_Count"),
        half_even(F.avg("Churn_Probability"), decimals).alias("Avg_Churn_Probability"),
        half_even(F.avg("Monthly Charges"), decimals).alias("Avg_Monthly_Charges"),
        half_even(F.sum("Potential_Revenue_Saved"), decimals).alias("Revenue_Saved"))


def strategy_distribution(campaign: DataFrame) -> DataFrame:
    """D11 on strategies: (Strategy, Customer_Count), count descending."""
    return (campaign.groupBy(F.col("Retention_Recommendation").alias("Strategy"))
            .agg(F.count(F.lit(1)).alias("Customer_Count"))
            .orderBy(F.desc("Customer_Count"), F.asc("Strategy")))


def revenue_saved_by_strategy(campaign: DataFrame, decimals: int = 6) -> DataFrame:
    """Potential revenue saved per strategy."""
    return campaign.groupBy("Retention_Recommendation").agg(
        half_even(F.sum("Potential_Revenue_Saved"), decimals).alias("Potential_Revenue_Saved"))


def campaign_kpis(campaign: DataFrame) -> DataFrame:
    """Customers, high-risk count, revenue saved (2 dp), mean
    probability (4 dp), commonest strategy (smallest on ties)."""
    return campaign.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("Risk_Segment") == K.RISK_HIGH).alias("high_risk_customers"),
        half_even(F.sum("Potential_Revenue_Saved"), 2).alias("total_potential_revenue_saved"),
        half_even(F.avg("Churn_Probability"), 4).alias("avg_churn_probability"),
        F.mode("Retention_Recommendation", True).alias("most_common_strategy"))


def segment_actions(spark: SparkSession) -> DataFrame:
    """The three-row segment -> action table."""
    return spark.createDataFrame(K.SEGMENT_ACTIONS, "`Risk Segment` string, `Recommended Action` string")


def with_segment_action(campaign: DataFrame, spark: SparkSession) -> DataFrame:
    """C3 join: constant 3-row table, broadcast (size fixed by construction)."""
    actions = segment_actions(spark).withColumnRenamed("Risk Segment", "Risk_Segment")
    return campaign.join(F.broadcast(actions), "Risk_Segment", "left")


def dashboard_master(campaign: DataFrame) -> DataFrame:
    """The cleaned table with probability, segment, recommendation, revenue
    and ``Predicted_Churn`` on every row.

    The original joins its two files back by customer id. Both sides come
    from the same rows here, so the campaign frame already is that join, also
    for ids that occur twice; no shuffle is needed.
    """
    return campaign.withColumn("Predicted_Churn",
                               F.coalesce(F.col("Churn_Probability") >= K.CHURN_CUTOFF, F.lit(False)).cast("int"))


def key_uniqueness(df: DataFrame, key: str = "customerID") -> DataFrame:
    """Rows, distinct keys and whether the key is unique (one aggregation pair)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
    return per_key.agg(F.sum("__c").cast("long").alias("rows"),
                       F.count(F.lit(1)).alias("distinct_keys"),
                       (F.max("__c") <= 1).alias("is_unique"))

"""Boundary rows for the business rules (risk, signal, plans, campaign, cleaning)."""

import pytest
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions import rules as R
from churnkit.operators import clean as C


def one(spark, col, **row):
    cols = list(row)
    df = spark.createDataFrame([tuple(row[c] for c in cols)], cols) if cols else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("p,console,campaign", [
    (0.0, "Low Risk", "Low Risk"), (0.2999, "Low Risk", "Low Risk"), (0.30, "Medium Risk", "Low Risk"),
    (0.4999, "Medium Risk", "Low Risk"), (0.50, "Medium Risk", "Medium Risk"),
    (0.5999, "Medium Risk", "Medium Risk"), (0.60, "High Risk", "Medium Risk"),
    (0.7999, "High Risk", "Medium Risk"), (0.80, "High Risk", "High Risk"), (1.0, "High Risk", "High Risk")])
def test_risk_presets(spark, p, console, campaign):
    assert one(spark, R.risk_level(F.col("p"), "console"), p=p) == console
    assert one(spark, R.risk_level(F.col("p"), "campaign"), p=p) == campaign


@pytest.mark.parametrize("p,bars", [(0.0, 5), (0.5, 2), (0.3, 4), (0.7, 2), (0.9, 1), (1.0, 1), (0.1, 4)])
def test_signal_half_even(spark, p, bars):
    # round((1-p)*5) with half-even on the binary value, clamped to 1..5
    assert one(spark, R.signal_bars(F.col("p")), p=p) == max(1, min(5, round((1 - p) * 5)))
    assert one(spark, R.signal_bars(F.col("p")), p=p) == bars


def _plan(spark, **kw):
    base = dict(churn_probability=0.2, risk_level="Low Risk", Contract="Two year", MonthlyCharges=50.0,
                tenure=5, TechSupport="Yes", OnlineSecurity="Yes", InternetService="DSL",
                PaymentMethod="Mailed check", PaperlessBilling="No")
    base.update(kw)
    return one(spark, R.retention_plan(), **base)


def test_plan_fallbacks(spark):
    assert _plan(spark) == [K.PLAN_LOW_FALLBACK]
    assert _plan(spark, risk_level="Medium Risk") == [K.PLAN_OTHER_FALLBACK]


def test_plan_two_issues_no_priority(spark):
    plan = _plan(spark, Contract="Month-to-month", MonthlyCharges=80.0)
    assert plan == [K.PLAN_CONTRACT, K.PLAN_PRICING]


def test_plan_three_issues_priority_first_and_cut_to_four(spark):
    plan = _plan(spark, Contract="Month-to-month", MonthlyCharges=85.0, TechSupport="No",
                 OnlineSecurity="No", PaymentMethod="Electronic check")
    assert plan[0] == K.PLAN_PRIORITY and len(plan) == 4
    assert plan[1:] == [K.PLAN_CONTRACT, K.PLAN_PRICING, K.PLAN_SUPPORT]


def test_plan_no_internet_suppresses_addons_and_paperless_is_not_an_issue(spark):
    plan = _plan(spark, TechSupport="No", OnlineSecurity="No", InternetService="No",
                 PaperlessBilling="Yes", risk_level="High Risk", churn_probability=0.7)
    assert plan == [K.PLAN_DIGITAL]


def test_plan_loyal_and_fiber(spark):
    plan = _plan(spark, tenure=24, churn_probability=0.65, risk_level="High Risk",
                 InternetService="Fiber optic", MonthlyCharges=85.0)
    assert K.PLAN_LOYAL in plan and K.PLAN_FIBER in plan and K.PLAN_PRICING in plan
    assert plan[0] == K.PLAN_PRIORITY


def _camp(spark, **kw):
    base = {"Risk_Segment": "High Risk", "Monthly Charges": 50.0, "Tenure Months": 20.0,
            "Online Security_Yes": 1, "Tech Support_Yes": 1, "Contract_One year": 1,
            "Contract_Two year": 0, "CLTV": 100}
    base.update(kw)
    cols = list(base)
    df = spark.createDataFrame([tuple(base[c] for c in cols)], [c for c in cols])
    return df.select(R.campaign_recommendation().alias("x")).first()["x"]


def test_campaign_rules(spark):
    assert _camp(spark) == K.REC_HIGH_CALL
    assert _camp(spark, **{"Monthly Charges": 80.01}) == K.REC_HIGH_DISCOUNT
    assert _camp(spark, **{"Monthly Charges": 80.0, "Tenure Months": 11.0}) == K.REC_HIGH_WELCOME
    assert _camp(spark, **{"Tenure Months": 12.0, "Online Security_Yes": 0}) == K.REC_HIGH_SECURITY
    assert _camp(spark, **{"Tech Support_Yes": 0}) == K.REC_HIGH_SUPPORT
    assert _camp(spark, **{"Contract_One year": 0}) == K.REC_HIGH_CONTRACT
    assert _camp(spark, Risk_Segment="Medium Risk", **{"Monthly Charges": 81.0}) == K.REC_MED_DISCOUNT
    assert _camp(spark, Risk_Segment="Medium Risk", **{"Online Security_Yes": 0}) == K.REC_MED_SECURITY
    assert _camp(spark, Risk_Segment="Medium Risk") == K.REC_MED_LOYALTY
    assert _camp(spark, Risk_Segment="Low Risk", CLTV=5000) == K.REC_LOW_STANDARD
    assert _camp(spark, Risk_Segment="Low Risk", CLTV=5001) == K.REC_LOW_VIP


def test_driver_names(spark):
    assert one(spark, R.driver_name(F.col("f")), f="Tenure Months") == "Short account tenure"
    assert one(spark, R.driver_name(F.col("f")), f="Streaming TV_Yes") == "Streaming TV Yes"


def test_cleaning_boundaries(spark):
    rows = [("a", " Yes ", "maybe", "Yes", " ", "1.7", "-3", "12.7", None, "Male", " One year ")]
    df = spark.createDataFrame(rows, "customerID string, Partner string, Dependents string, PhoneService string, "
                                     "PaperlessBilling string, SeniorCitizen string, tenure string, "
                                     "MonthlyCharges string, TotalCharges string, gender string, Contract string")
    for c in ["MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
              "TechSupport", "StreamingTV", "StreamingMovies", "PaymentMethod"]:
        df = df.withColumn(c, F.lit(None).cast("string"))
    r = C.clean_accounts(df.withColumn("row_no", F.lit(1).cast("long"))).first()
    assert (r.Partner, r.Dependents, r.PhoneService, r.PaperlessBilling) == ("Yes", "No", "Yes", "No")
    assert r.SeniorCitizen == 1 and r.tenure == 0 and r.MonthlyCharges == 12.7
    assert r.TotalCharges == 0.0            # tenure 0 x monthly
    assert r.Contract == "One year" and r.TechSupport == "No internet service"
    assert r.PaymentMethod == "Mailed check" and r.gender == "Male"


def test_validation_messages(spark):
    cols = K.REQUIRED_COLUMNS
    good = {c: "x" for c in cols}
    good.update(tenure="10", MonthlyCharges="5.5", TotalCharges=None)
    cases = [
        ({}, None),
        ({"gender": ""}, "Missing required field(s): gender"),
        ({"tenure": "abc"}, "'tenure' must be a whole number of months."),
        ({"tenure": "100.9"}, None),
        ({"tenure": "101"}, "'tenure' must be between 0 and 100 months."),
        ({"tenure": "-0.5"}, None),
        ({"tenure": "nan"}, "'tenure' must be a whole number of months."),
        ({"MonthlyCharges": " "}, "'MonthlyCharges' must be numeric."),
        ({"MonthlyCharges": "1_000"}, None),
    ]
    for change, msg in cases:
        rec = dict(good, **change)
        df = spark.createDataFrame([tuple(rec[c] for c in cols)], ", ".join(f"{c} string" for c in cols))
        assert C.validate_records(df).first()["validation_error"] == msg, change


def test_feature_list_order_and_count():
    assert len(K.FEATURE_COLUMNS) == 30
    assert K.FEATURE_COLUMNS[:5] == ["Tenure Months", "Monthly Charges", "Total Charges", "Gender_Male",
                                     "Senior Citizen_Yes"]
    assert K.FEATURE_COLUMNS[-1] == "Payment Method_Mailed check"

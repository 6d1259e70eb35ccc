"""Stream scoring equals batch scoring; run store, report catalogue, upload guards."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.operators.clean import clean_accounts
from churnkit.operators.scoring import bulk_results, score, single_prediction
from churnkit.sources import files as FS
from churnkit.sources import runs as RS
from churnkit.sources.tables import accounts_raw
from churnkit.streaming import scorer


def _raw_csv(spark, sf_dir, out):
    raw = accounts_raw(spark, sf_dir).select(*K.RAW_COLUMNS)
    raw.repartition(3).write.mode("overwrite").option("header", True).csv(out)
    return raw


def test_stream_equals_batch(spark, sf_dir):
    tmp = tempfile.mkdtemp(prefix="churnkit-stream-")
    src = os.path.join(tmp, "in")
    raw = _raw_csv(spark, sf_dir, src)
    q = scorer.start(spark, src, os.path.join(tmp, "out"), os.path.join(tmp, "ckpt"), frozen_monthly_median=70.0)
    q.awaitTermination(300)
    streamed = scorer.read_results(spark, os.path.join(tmp, "out"))
    batch_in = scorer.fill_ids(scorer.placed(spark.read.option("header", True).schema(scorer.INPUT_SCHEMA).csv(src)))
    expected, rejected = scorer.score_batch(batch_in, 70.0)
    cols = [c for c in expected.columns]
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in expected.select(*cols).collect())
    assert a == b and len(a) > 0
    n_rej = spark.read.parquet(os.path.join(tmp, "out", "rejected")).count()
    assert n_rej == rejected.count() and len(a) + n_rej == raw.count()


def test_run_store_and_catalogue(spark, sf_dir):
    tmp = tempfile.mkdtemp(prefix="churnkit-runs-")
    runs, reports = os.path.join(tmp, "runs"), os.path.join(tmp, "reports")
    results = bulk_results(score(clean_accounts(accounts_raw(spark, sf_dir))))
    RS.save_run(results, runs, "r1")
    RS.save_run(results.limit(5), runs, "r2")
    assert RS.load_run(spark, runs, "r1").count() == results.count()
    assert RS.load_run(spark, runs, "r2").count() == 5
    assert RS.load_run(spark, runs, "nope") is None
    FS.write_csv(results.limit(7).coalesce(1), os.path.join(tmp, "tmpcsv"))
    os.makedirs(reports)
    part = [f for f in os.listdir(os.path.join(tmp, "tmpcsv")) if f.endswith(".csv")][0]
    os.replace(os.path.join(tmp, "tmpcsv", part), os.path.join(reports, RS.report_name("r1")))
    open(os.path.join(reports, RS.report_name("zz")), "w").close()       # empty report, no run
    cat = {r.filename: r for r in RS.report_catalogue(spark, reports, runs).collect()}
    assert cat[RS.report_name("r1")].row_count == 7 and cat[RS.report_name("r1")].dashboard_available
    assert cat[RS.report_name("zz")].row_count == 0 and not cat[RS.report_name("zz")].dashboard_available
    assert RS.review_run(spark, RS.report_name("r2"), runs).count() == 5
    assert RS.review_run(spark, "other.csv", runs) is None


def test_upload_guards(spark):
    tmp = tempfile.mkdtemp(prefix="churnkit-up-")
    with pytest.raises(FS.UploadError, match="No file"):
        FS.read_upload(spark, None)
    with pytest.raises(FS.UploadError, match="Invalid file type"):
        FS.read_upload(spark, os.path.join(tmp, "a.txt"))
    empty = os.path.join(tmp, "e.csv")
    open(empty, "w").close()
    with pytest.raises(FS.UploadError, match="empty"):
        FS.read_upload(spark, empty)
    ok = os.path.join(tmp, "ok.csv")
    with open(ok, "w") as f:
        f.write("customerID,tenure\nA,1\nB,NA\nC,3\n")
    df = FS.read_upload(spark, ok)
    assert df.where(F.col("tenure").isNull()).count() == 1
    with pytest.raises(FS.UploadError, match="too many rows"):
        FS.read_upload(spark, ok, max_rows=2)


def test_single_prediction(spark):
    rec = {"gender": "Female", "SeniorCitizen": "0", "Partner": "Yes", "Dependents": "No", "tenure": "5",
           "PhoneService": "Yes", "MultipleLines": "No", "InternetService": "Fiber optic",
           "OnlineSecurity": "No", "OnlineBackup": "No", "DeviceProtection": "No", "TechSupport": "No",
           "StreamingTV": "Yes", "StreamingMovies": "Yes", "Contract": "Month-to-month",
           "PaperlessBilling": "Yes", "PaymentMethod": "Electronic check", "MonthlyCharges": "95.5"}
    r = single_prediction(spark, rec).first()
    assert r.customerID == "ROW-1" and 0.0 <= r.probability <= 1.0
    assert r.risk_level in (K.RISK_LOW, K.RISK_MEDIUM, K.RISK_HIGH)
    assert r.plan[0] == K.PLAN_PRIORITY and len(r.plan) == 4
    assert r.top_drivers is None and r.model_name == "Scorecard" and r.cleaned_record["tenure"] == 5
    r = single_prediction(spark, rec, means=[32.0, 65.0, 2200.0] + [0.3] * 27).first()
    assert 1 <= len(r.top_drivers) <= 4 and "High monthly charges" in r.top_drivers
    with pytest.raises(Exception, match="tenure"):
        single_prediction(spark, dict(rec, tenure="200")).first()


def test_segment_outputs_layout_and_export(spark, sf_dir):
    from churnkit.operators.scoring import campaign_frame
    tmp = tempfile.mkdtemp(prefix="churnkit-out-")
    camp = campaign_frame(score(clean_accounts(accounts_raw(spark, sf_dir)))).select(
        "row_no", "Risk_Segment", "Retention_Recommendation", "Potential_Revenue_Saved")
    FS.write_segments(camp, os.path.join(tmp, "segments"))                       # A6
    seg_dirs = sorted(d for d in os.listdir(os.path.join(tmp, "segments")) if d.startswith("Risk_Segment="))
    assert seg_dirs and all(d.split("=")[1] in ("High Risk", "Medium Risk", "Low Risk") for d in seg_dirs)
    cleaned = clean_accounts(accounts_raw(spark, sf_dir))
    FS.write_layout(cleaned, os.path.join(tmp, "layout"))                         # A11
    q = spark.read.parquet(os.path.join(tmp, "layout")).where(F.col("Contract") == "Two year")
    assert "PartitionFilters: [isnotnull(Contract" in q._jdf.queryExecution().executedPlan().toString()
    assert q.count() == cleaned.where(F.col("Contract") == "Two year").count()
    FS.export_query(spark, "select Contract, count(*) as n from {t} group by Contract",   # A3
                    os.path.join(tmp, "export"), {"t": cleaned})
    back = spark.read.option("header", True).csv(os.path.join(tmp, "export"))
    assert back.count() == cleaned.select("Contract").distinct().count()


def test_saving_a_run_leaves_other_overwrites_alone(spark, sf_dir):
    """A run replaces its own partition only; a segment output still replaces all of its folder."""
    tmp = tempfile.mkdtemp(prefix="churnkit-runs-")
    results = bulk_results(score(clean_accounts(accounts_raw(spark, sf_dir))))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", None)
    out = os.path.join(tmp, "segments")
    FS.write_segments(results, out, "Risk Level")
    RS.save_run(results.limit(3), os.path.join(tmp, "runs"), "r1")
    RS.save_run(results.limit(4), os.path.join(tmp, "runs"), "r1")
    RS.save_run(results.limit(2), os.path.join(tmp, "runs"), "r2")
    assert RS.read_runs(spark, os.path.join(tmp, "runs")).count() == 6
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode", None) == before
    FS.write_segments(results.limit(1), out, "Risk Level")
    assert len([d for d in os.listdir(out) if "=" in d]) == 1


def test_equal_records_with_blank_ids_get_different_ids(spark):
    """Over several batches, and the same ones when a batch is read again in other splits."""
    src = os.path.join(tempfile.mkdtemp(prefix="churnkit-ids-"), "in")
    rows = [("",) + ("x",) * (len(K.RAW_COLUMNS) - 1)] * 40 + [("known",) + ("x",) * (len(K.RAW_COLUMNS) - 1)] * 5
    names = ["customerID", *[c for c in K.RAW_COLUMNS if c != "customerID"]]
    spark.createDataFrame(rows, names).select(*K.RAW_COLUMNS).repartition(4).write.option("header", True).csv(src)
    read = scorer.placed(spark.read.option("header", True).schema(scorer.INPUT_SCHEMA).csv(src))
    ids = [r.customerID for r in scorer.fill_ids(read).collect()]
    made = [i for i in ids if i.startswith("ROW-")]
    assert len(made) == len(set(made)) == 40 and ids.count("known") == 5
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        assert sorted(r.customerID for r in scorer.fill_ids(read.select("*")).collect()) == sorted(ids)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

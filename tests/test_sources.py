"""CSV scan and upload guard: quotes, line breaks, long and short rows, input order; stores by URI."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from churnkit import session
from churnkit.operators import models as MD
from churnkit.sources import files as FS
from churnkit.sources import runs as RS
from churnkit.streaming import scorer


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def _rows(df):
    return [tuple(r) for r in df.orderBy("row_no").drop("row_no").collect()]


def test_quotes_commas_and_tokens(spark, tmp_path):
    path = _file(tmp_path, "q.csv", 'name,tenure\n"a ""b"", c",1\n NA ,NA\n"",""\nx,null\n')
    assert _rows(FS.read_csv(spark, path)) == [('a "b", c', "1"), (" NA ", None), (None, None), ("x", None)]


def test_quoted_line_break(spark, tmp_path):
    path = _file(tmp_path, "m.csv", 'name,tenure\n"two\nlines",1\nb,2\n')
    assert _rows(FS.read_csv(spark, path, multi_line=True)) == [("two\nlines", "1"), ("b", "2")]
    assert FS.read_upload(spark, path).count() == 2


def test_long_rows_are_never_cut(spark, tmp_path):
    path = _file(tmp_path, "l.csv", "name,tenure\na,1,extra,more\nb,2\nc\n")
    with pytest.raises(FS.UploadError, match="could not be parsed"):
        FS.read_upload(spark, path)
    with pytest.raises(PySparkException, match="more fields"):
        FS.read_csv(spark, path).collect()
    short = _file(tmp_path, "s.csv", "name,tenure\nb,2\nc\n")
    assert _rows(FS.read_upload(spark, short)) == [("b", "2"), ("c", None)]


def test_headers_without_rows(spark, tmp_path):
    with pytest.raises(FS.UploadError, match="no customer rows"):
        FS.read_upload(spark, _file(tmp_path, "h.csv", "name,tenure\n"))


def test_row_no_is_input_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    _file(folder, "a.csv", "v\n" + "".join(f"a{i}\n" for i in range(10)))
    _file(folder, "b.csv", "v\n" + "".join(f"b{i}\n" for i in range(20_000)))
    _file(folder, "c.csv", "v\nc0\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")          # several blocks of one file
    try:
        rows = FS.read_csv(spark, str(folder)).orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["row_no"] for r in rows] == list(range(20_011))
    assert [r["v"] for r in rows] == [f"a{i}" for i in range(10)] + [f"b{i}" for i in range(20_000)] + ["c0"]


def test_stream_takes_null_tokens_as_the_batch_does(spark, tmp_path):
    names = scorer.INPUT_SCHEMA.names
    good = {"customerID": "A", "gender": "Female", "SeniorCitizen": "0", "Partner": "Yes", "Dependents": "No", "tenure": "5",
            "PhoneService": "Yes", "MultipleLines": "No", "InternetService": "Fiber optic", "OnlineSecurity": "No",
            "OnlineBackup": "No", "DeviceProtection": "No", "TechSupport": "No", "StreamingTV": "Yes", "StreamingMovies": "Yes",
            "Contract": "One year", "PaperlessBilling": "Yes", "PaymentMethod": "Electronic check", "MonthlyCharges": "95.5",
            "TotalCharges": "NaN"}
    rows = [good, good | {"customerID": "B", "Contract": "NA"}, good | {"customerID": "C", "tenure": "nan"}]
    folder = tmp_path / "in"
    folder.mkdir()
    _file(folder, "x.csv", ",".join(names) + "\n" + "".join(",".join(r[c] for c in names) + "\n" for r in rows))
    out = f"file://{tmp_path}/out"
    scorer.start(spark, f"file://{folder}", out, f"file://{tmp_path}/marks", 70.0).awaitTermination()
    want, rejected = scorer.score_batch(FS.read_csv(spark, str(folder)), 70.0)
    cols = want.columns
    got = sorted(tuple(r) for r in scorer.read_results(spark, out).select(*cols).collect())
    assert got == sorted(tuple(r) for r in want.collect()) and [r[0] for r in got] == ["A"]
    assert spark.read.parquet(f"{out}/rejected").count() == rejected.count() == 2


def test_stores_by_uri_and_digit_run_ids(spark, tmp_path):
    base = f"file://{tmp_path}/runs"
    assert RS.load_run(spark, base, "1") is None
    df = spark.range(3).select(F.col("id").alias("row_no"))
    RS.save_run(df, base, "007")
    RS.save_run(df, base, "8")
    assert RS.load_run(spark, base, "007").count() == 3 and RS.load_run(spark, base, "7") is None
    reports = tmp_path / "reports"
    reports.mkdir()
    _file(reports, RS.report_name("007"), "h\n1\n")
    _file(reports, RS.report_name("monday"), "h\n")
    cat = {r["filename"]: r for r in RS.report_catalogue(spark, f"file://{reports}", base).collect()}
    assert cat[RS.report_name("007")]["dashboard_available"] and not cat[RS.report_name("monday")]["dashboard_available"]
    (tmp_path / "runs" / "run_id=9").mkdir()
    (tmp_path / "runs" / "run_id=9" / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception, match="not a Parquet file"):
        RS.load_run(spark, base, "9").collect()
    assert not MD.is_model_available(f"file://{tmp_path}/model") and MD.load_model(f"file://{tmp_path}/model") is None


def test_cluster_without_a_shared_folder_is_an_error(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Cluster())


def test_layout_writes_a_large_contract_in_many_files(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") % 7).cast("int").alias("tenure"), (F.col("id") % 2).cast("int").alias("ChurnValue"),
                                    F.when(F.col("id") % 10 == 0, "One year").otherwise("Month-to-month").alias("Contract"))
    path = FS.write_layout(df, str(tmp_path / "layout"), tasks=8)
    assert len([f for f in os.listdir(f"{path}/Contract=Month-to-month") if f.endswith(".parquet")]) >= 4
    assert spark.read.parquet(path).count() == 20_000

"""Unit checks for the smaller cleaning and feature operators."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnkit.operators import clean as C
from churnkit.operators import features as FE


def test_drop_strict_and_lenient(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.drop_columns(df, ["a"]).columns == ["b"]
    assert C.drop_columns(df, ["zz"], strict=False).columns == ["a", "b"]
    with pytest.raises(C.PreprocessingError):
        C.drop_columns(df, ["zz"])


def test_normalize_and_require(spark):
    df = spark.createDataFrame([("x", "1")], "` Customer ID ` string, `Tenure_Months` string")
    out = C.normalize_columns(df)
    assert out.columns == ["customerID", "tenure"]
    with pytest.raises(C.PreprocessingError, match="missing required column"):
        C.require_columns(out)
    clash = spark.createDataFrame([("a", "b")], "Gender string, gender string")
    with pytest.raises(C.PreprocessingError, match="collide"):
        C.normalize_columns(clash)


def test_fill_trim_narrow_dedupe(spark):
    df = spark.createDataFrame([(1, " a ", None, "5"), (2, " a ", None, "5"), (3, "b", "x", "7")],
                               "row_no long, s string, r string, n string")
    out = C.fill_constant(C.trim_strings(df), "r", "Not Churned")
    out = C.narrow_types(C.coerce_numeric(out, ["n"]), {"n": "short"})
    rows = sorted(C.drop_duplicate_rows(out).collect())
    assert [(r.row_no, r.s, r.r, r.n) for r in rows] == [(1, "a", "Not Churned", 5), (3, "b", "x", 7)]
    assert dict(out.dtypes)["n"] == "smallint"


def test_ordinal_customer_ids(spark):
    ids = ["a", " ", None, "b", "", "c"]
    df = spark.createDataFrame([(i * 10, v) for i, v in enumerate(ids)], "row_no long, customerID string")
    out = {r.row_no: r.customerID for r in C.fill_customer_ids(df, bucket_width=16).collect()}
    assert [out[i * 10] for i in range(6)] == ["a", "ROW-1", "ROW-2", "b", "ROW-3", "c"]
    no_col = spark.createDataFrame([(5,), (7,)], "row_no long")
    assert sorted(r.customerID for r in C.fill_customer_ids(no_col).collect()) == ["ROW-1", "ROW-2"]


def test_one_hot_drop_first_matches_pandas(spark):
    data = [("x", "u"), ("y", "u"), ("z", None), ("x", "v")]
    df = spark.createDataFrame(data, "a string, b string")
    got = FE.one_hot_drop_first(df, ["a", "b"]).toPandas()
    want = pd.get_dummies(pd.DataFrame(data, columns=["a", "b"]), columns=["a", "b"], drop_first=True).astype(int)
    assert sorted(got.columns) == sorted(want.columns)
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist()


def test_assemble_vector_order(spark, sf_dir):
    from churnkit.plans import catalog as CAT
    from churnkit import constants as K
    row = FE.assemble(CAT.scored(spark, sf_dir)).orderBy("row_no").first()
    assert row.features.size == 30
    assert row.features[0] == float(row["Tenure Months"]) and row.features[29] == float(row[K.FEATURE_COLUMNS[-1]])

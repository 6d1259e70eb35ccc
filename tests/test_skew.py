"""One key holding a third of the rows: results stay exact (pandas brute force)."""

import pandas as pd
from pyspark.sql import functions as F

from churnkit.operators import clean as C
from churnkit.operators import evaluate as EV
from churnkit.operators import scoring as S
from churnkit.sources.tables import accounts_raw


def _skewed(spark, sf_dir):
    raw = accounts_raw(spark, sf_dir)
    # every third row gets the same id; every fifth of those a blank id
    hot = F.when(F.col("row_no") % 15 == 0, F.lit(" ")).when(F.col("row_no") % 3 == 0, F.lit("HOT"))
    return raw.withColumn("customerID", F.coalesce(hot, F.col("customerID")))


def test_ids_split_and_uniqueness_under_skew(spark, sf_dir):
    raw = _skewed(spark, sf_dir)
    cleaned = C.clean_accounts(raw)
    pdf = raw.select("row_no", "customerID").toPandas().sort_values("row_no")
    blank = pdf["customerID"].fillna("").str.strip() == ""
    expect = pdf["customerID"].where(~blank, ["ROW-%d" % (i + 1) for i in blank.cumsum() - 1])
    got = cleaned.select("row_no", "customerID").toPandas().sort_values("row_no")
    assert got["customerID"].tolist() == expect.tolist()

    sp = EV.stratified_split(cleaned).select("row_no", "customerID", "ChurnValue", "split").toPandas()
    for label, g in sp.groupby("ChurnValue"):
        assert (g["split"] == "test").sum() == round(0.2 * len(g))

    u = S.key_uniqueness(cleaned).first()
    assert u.rows == len(pdf) and not u.is_unique
    assert u.distinct_keys == got["customerID"].nunique()


def test_dedupe_and_counts_under_skew(spark, sf_dir):
    raw = _skewed(spark, sf_dir).select("row_no", "customerID", "Contract", "ChurnValue")
    out = C.drop_duplicate_rows(raw).toPandas()
    pdf = raw.toPandas().sort_values("row_no")
    want = pdf.drop_duplicates(subset=["customerID", "Contract", "ChurnValue"], keep="first")
    assert sorted(out["row_no"]) == sorted(want["row_no"])
    counts = {r.customerID: r.KeyCount for r in
              raw.groupBy("customerID").agg(F.count(F.lit(1)).alias("KeyCount")).where("KeyCount > 1").collect()}
    assert counts["HOT"] == int((pdf["customerID"] == "HOT").sum()) >= len(pdf) // 4
    assert pd.notna(counts["HOT"])

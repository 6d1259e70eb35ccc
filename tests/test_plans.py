"""Plan guards for scale: no window over all rows in one task, pruned scans."""

import re

import pytest

import __spark_entry__ as E

WINDOW = re.compile(r"Window \[.*\], \[(.*?)\], \[(.*?)\]")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["b19_clean_accounts", "i4_stratified_split", "i15_roc_curve", "pr_curve",
                                  "i14_roc_auc", "d23_describe_numeric", "d27_box_tenure_by_churn",
                                  "d12_churn_shares", "i19_global_importance"])
def test_no_unpartitioned_window_over_rows(spark, sf_dir, name):
    """A window without PARTITION BY may only run over the per-bucket offset
    table (one row per bucket), never over data rows."""
    if name == "b19_clean_accounts":   # the stage itself: check the cleaning plan, not the Parquet read
        from churnkit.operators.clean import clean_accounts
        from churnkit.sources.tables import accounts_raw
        df = clean_accounts(accounts_raw(spark, sf_dir))
    else:
        df = E.queries()[name](spark, sf_dir)
    for part, order in WINDOW.findall(_plan(df)):
        if not part.strip():
            assert order.startswith("__bkt"), (name, order)


def test_split_and_stability_read_their_input_once(spark, sf_dir):
    assert _plan(E.queries()["i4_stratified_split"](spark, sf_dir)).count("FileScan") == 1
    assert "Exchange" not in _plan(E.queries()["i4_stratified_split"](spark, sf_dir))
    assert _plan(E.queries()["psi_monthly_train_vs_test"](spark, sf_dir)).count("FileScan") == 2      # one for each side


def test_staged_reports_prune_columns(spark, sf_dir):
    plan = _plan(E.queries()["d9_kpi_row"](spark, sf_dir))
    assert "ReadSchema: struct<ChurnValue:int>" in plan
    plan = _plan(E.queries()["d14_mean_charge_by_churn"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(ChurnValue)]" in plan

"""Split and evaluation operators (inventory I4, I10-I12, I14-I16).

Everything is an aggregation over (label, score) pairs. Rank-dependent
metrics (AUC, ROC) first collapse rows to one row per distinct score, then
take running sums with the bucketed helper in :mod:`ordinal`, so no global
sort runs in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit.functions.numeric import half_even
from churnkit.operators import ordinal


# --- I4 ------------------------------------------------------------------------

def stratified_split(df: DataFrame, label: str = "ChurnValue", key: str = "customerID",
                     order_col: str = "row_no", test_fraction: float = 0.2, seed: int = 42,
                     hex_digits: int = 4, border_rows: int = 100_000, max_labels: int = 1000) -> DataFrame:
    """Exact-size stratified split: per label, the first ``round(f * n)``
    rows in ``md5(key|order|seed)`` order go to ``test``. Rows with a null
    label are not split.

    Only each label's border row is looked for. One pass counts rows per label
    and hash prefix (16**hex_digits of them); running sums over that small
    table name the prefix that holds the border. Where the rows of these
    prefixes are more than ``border_rows``, longer prefixes are counted inside
    them; else the border rows are read off them. Every row is then compared with
    its label's border in a projection: no row of ``df`` is shuffled, and the
    result's own plan reads ``df`` once.
    """
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(order_col).cast("string"), F.lit(str(seed))))
    base = df.where(F.col(label).isNotNull())
    rows = base.select(F.col(label).alias("__label"), h.alias("__h"), F.col(order_col).alias("__order"))
    left: dict = {}                                   # label: (rows still to take inside the prefix, the prefix)
    inside, digits = rows, hex_digits
    while True:
        counts = inside.groupBy("__label", F.substring("__h", 1, digits).alias("__prefix")).agg(F.count("*").alias("__c"))
        if not left:
            counts = counts.checkpoint(eager=True)    # at most 16**hex_digits rows a label, read twice
            sizes = counts.groupBy("__label").agg(F.sum("__c").alias("__n"))
            take = F.round(F.lit(float(test_fraction)) * F.col("__n")).cast("long")
            wanted = {r["__label"]: r["__k"] for r in sizes.select("__label", take.alias("__k")).limit(max_labels + 1).collect()}
            if len(wanted) > max_labels:
                raise ValueError(f"{label} has more than {max_labels} different labels")
        else:
            wanted = {name: k for name, (k, _) in left.items()}
        k = _per_label(wanted)
        before = F.sum("__c").over(Window.partitionBy("__label").orderBy("__prefix")) - F.col("__c")
        border = (counts.withColumn("__before", before).withColumn("__k", k)
                  .where((F.col("__before") < F.col("__k")) & (F.col("__before") + F.col("__c") >= F.col("__k"))).collect())
        left = {r["__label"]: (r["__k"] - r["__before"], r["__prefix"]) for r in border}       # one row a label
        inside = rows.where(F.substring("__h", 1, digits) == _per_label({name: p for name, (_, p) in left.items()}))
        if sum(r["__c"] for r in border) <= border_rows or digits >= 32:
            break
        digits = min(32, 2 * digits)
    nth = F.row_number().over(Window.partitionBy("__label").orderBy("__h", "__order"))
    last = inside.withColumn("__nth", nth).where(F.col("__nth") == _per_label({name: k for name, (k, _) in left.items()})).collect()
    key_of, order_of = ({r["__label"]: r[c] for r in last} for c in ("__h", "__order"))
    last_of = F.struct(_per_label(key_of, F.col(label)).cast("string").alias("h"),
                       _per_label(order_of, F.col(label)).cast(df.schema[order_col].dataType).alias("o"))
    is_test = F.struct(h.alias("h"), F.col(order_col).alias("o")) <= last_of       # no border: nothing is below it
    return base.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def _per_label(values: dict, name: Column | None = None) -> Column:
    """The value of a row's label, null for other labels."""
    name = F.col("__label") if name is None else name
    out = F.lit(None)
    for own, value in values.items():
        out = F.when(name == F.lit(own), F.lit(value)).otherwise(out)
    return out


def split_sizes(split: DataFrame, label: str = "ChurnValue") -> DataFrame:
    """Rows per (split, label): the shape check of the saved label files."""
    return split.groupBy("split", label).agg(F.count(F.lit(1)).alias("rows"))


# --- I10-I12 --------------------------------------------------------------------

def _cells(df: DataFrame, label: str, pred: str):
    y, p = F.col(label), F.col(pred)
    return dict(tp=F.count_if((y == 1) & (p == 1)), tn=F.count_if((y == 0) & (p == 0)),
                fp=F.count_if((y == 0) & (p == 1)), fn=F.count_if((y == 1) & (p == 0)))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _binary(label: str, pred: str, df: DataFrame, decimals: int) -> list:
    c = _cells(df, label, pred)
    tp, tn, fp, fn = c["tp"], c["tn"], c["fp"], c["fn"]
    return [half_even(_ratio(tp + tn, tp + tn + fp + fn), decimals).alias("accuracy"),
            half_even(_ratio(tp, tp + fp), decimals).alias("precision"),
            half_even(_ratio(tp, tp + fn), decimals).alias("recall"),
            half_even(_ratio(2 * tp, 2 * tp + fp + fn), decimals).alias("f1")]


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                   decimals: int = 6) -> DataFrame:
    """Accuracy, precision, recall, F1 for class 1 (0 when undefined)."""
    return df.agg(*_binary(label, pred, df, decimals))


def binary_metrics_by(df: DataFrame, by: str, label: str = "label", pred: str = "prediction",
                      decimals: int = 6) -> DataFrame:
    """I10 for each value of ``by``, in one aggregation."""
    return df.groupBy(by).agg(*_binary(label, pred, df, decimals))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """All four cells (zero-filled) as (actual, predicted, count)."""
    c = _cells(df, label, pred)
    wide = df.agg(*[v.alias(k) for k, v in c.items()])
    return wide.selectExpr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, count)")


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction",
                          decimals: int = 6) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and
    weighted averages, from one aggregation."""
    c = _cells(df, label, pred)
    w = df.agg(*[v.alias(k) for k, v in c.items()])
    tp, tn, fp, fn = (F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn"))
    # class 1 and class 0 (for class 0 the roles of tp/tn and fp/fn swap)
    p1, r1, f1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = w.select(
        F.struct(F.lit("0").alias("class"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1_score"), s0.alias("support")).alias("a"),
        F.struct(F.lit("1").alias("class"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1_score"), s1.alias("support")).alias("b"),
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), _ratio(tp + tn, n).alias("f1_score"), n.alias("support")).alias("c"),
        F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1_score"), n.alias("support")).alias("d"),
        F.struct(F.lit("weighted avg").alias("class"), _ratio(p0 * s0 + p1 * s1, n).alias("precision"),
                 _ratio(r0 * s0 + r1 * s1, n).alias("recall"), _ratio(f0 * s0 + f1 * s1, n).alias("f1_score"),
                 n.alias("support")).alias("e"))
    long = rows.select(F.explode(F.array("a", "b", "c", "d", "e")).alias("r")).select("r.*")
    return long.select("class", *[half_even(k, decimals).alias(k) for k in ("precision", "recall", "f1_score")],
                       F.col("support").cast("long").alias("support"))


# --- I14, I15 ---------------------------------------------------------------------

def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(score).alias("score"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", decimals: int = 6) -> DataFrame:
    """ROC-AUC = P(score_pos > score_neg) + 0.5 P(tie), i.e. the rank-sum
    statistic with average ranks."""
    cum = _running_counts(df, label, score)           # from the top: negatives below = N - fps
    below = F.col("N") - F.col("fps") + F.col("neg") * F.lit(0.5)
    part = cum.agg(F.sum(F.col("pos") * below).alias("num"), F.max("P").alias("P"), F.max("N").alias("N"))
    return part.select(half_even(F.try_divide(F.col("num"), F.col("P").cast("double") * F.col("N")),
                                 decimals).alias("roc_auc"))


def _running_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg, tps, fps, P, N): counts at and above every distinct
    score, and the totals, from one bucketed pass."""
    counts = _score_counts(df, label, score)
    return ordinal.running_sums(counts, "score", {"pos": ("tps", "P"), "neg": ("fps", "N")}, descending=True)


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", decimals: int = 6) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus (null, 0, 0)."""
    cum = _running_counts(df, label, score)
    pts = cum.select(F.col("score").alias("threshold"),
                     half_even(F.try_divide(F.col("fps").cast("double"), F.col("N")), decimals).alias("fpr"),
                     half_even(F.try_divide(F.col("tps").cast("double"), F.col("P")), decimals).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def precision_recall_curve(df: DataFrame, label: str = "label", score: str = "score", decimals: int = 6) -> DataFrame:
    """Claimed precision-recall analysis: (threshold, precision, recall) at every distinct score."""
    cum = _running_counts(df, label, score)
    return cum.select(F.col("score").alias("threshold"),
                      half_even(F.try_divide(F.col("tps").cast("double"), (F.col("tps") + F.col("fps")).cast("double")),
                                decimals).alias("precision"),
                      half_even(F.try_divide(F.col("tps").cast("double"), F.col("P").cast("double")), decimals).alias("recall"))


def comparison_table(rows: list[tuple[str, DataFrame]]) -> DataFrame:
    """I16: one metrics row per model (name, accuracy, f1, ...), F1 first."""
    out = None
    for name, metrics in rows:
        m = metrics.select(F.lit(name).alias("Model"), "*")
        out = m if out is None else out.unionByName(m)
    return out.orderBy(F.desc("f1"), F.desc("accuracy"), F.asc("Model"))


def population_stability(expected: DataFrame, actual: DataFrame, c: str, edges: list[float],
                         eps: float = 1e-6) -> DataFrame:
    """Claimed drift check: population stability index of ``c`` between two
    frames over fixed bin edges (two binned counts and one join of <= len(edges)+1 rows)."""
    def binned(df, name):
        b = F.lit(0)
        for e in edges:
            b = b + F.when(F.col(c) >= F.lit(float(e)), 1).otherwise(0)
        counts = df.where(F.col(c).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))    # a row per bin
    j = binned(expected, "e").join(binned(actual, "a"), "bin", "full_outer").select(
        "bin", F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(eps)).alias("e"),
        F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(eps)).alias("a"))
    return j.agg(half_even(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))), 6).alias("psi"))

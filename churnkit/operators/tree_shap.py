"""Exact path-dependent Shapley values for Spark ML tree models.

The fitted model's node table is read back from its saved Parquet form
(``treeID, nodeData{id, impurityStats, leftChild, rightChild, split}``), held
by the driver like the model itself and broadcast; rows are explained in
Arrow batches by ``mapInPandas``, one NumPy lookup per small subtree over the batch.

Value explained: class-1 probability for random forests and decision trees
(mean of the per-tree normalised leaf class counts, as Spark predicts), raw
margin for gradient-boosted trees. Cover = training weight reaching a node.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.session import ship_package, shared_path


class Tree:
    __slots__ = ("left", "right", "feature", "threshold", "value", "cover")

    def __init__(self, left, right, feature, threshold, value, cover):
        self.left, self.right, self.feature = left, right, feature
        self.threshold, self.value, self.cover = threshold, value, cover


def _trees_from_nodes(pdf: pd.DataFrame, kind: str) -> list[Tree]:
    trees = []
    for _, g in pdf.groupby("treeID", sort=True):
        g = g.sort_values("id")
        index = {int(i): k for k, i in enumerate(g["id"])}
        n = len(g)
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        feature = np.full(n, -1, dtype=np.int64)
        threshold = np.zeros(n)
        value = np.zeros(n)
        cover = np.zeros(n)
        for k, row in enumerate(g.itertuples(index=False)):
            stats = np.asarray(row.impurityStats, dtype=float)
            if kind == "classification":
                tot = stats.sum()
                cover[k] = tot
                value[k] = stats[1] / tot if tot > 0 and len(stats) > 1 else 0.0
            else:                                   # variance stats: count, sum, sum of squares
                cover[k] = stats[0]
                value[k] = row.prediction
            if row.leftChild >= 0:
                if row.numCategories >= 0:
                    raise ValueError("categorical splits are not supported")
                left[k], right[k] = index[int(row.leftChild)], index[int(row.rightChild)]
                feature[k] = int(row.featureIndex)
                threshold[k] = float(row.threshold[0])
        trees.append(Tree(left, right, feature, threshold, value, cover))
    return trees


def read_trees(spark: SparkSession, model) -> tuple[list[Tree], np.ndarray, str]:
    """Node tables of a fitted tree model (or the last stage of a
    PipelineModel): trees, per-tree weights, and the explained output."""
    est = model.stages[-1] if hasattr(model, "stages") else model
    path = shared_path(spark, "churnkit-models", f"explain-{uuid.uuid4().hex}")
    est.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:            # ensembles: (treeID, nodeData struct)
        data = data.select("treeID", "nodeData.*")
    else:                                     # a single tree: flat node rows
        data = data.withColumn("treeID", F.lit(0))
    nodes = data.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild",
                        F.col("split.featureIndex").alias("featureIndex"),
                        F.col("split.leftCategoriesOrThreshold").alias("threshold"),
                        F.col("split.numCategories").alias("numCategories"))
    pdf = nodes.toPandas()        # model-sized (trees x nodes), not data-sized
    name = type(est).__name__
    if name.startswith("GBT"):
        trees = _trees_from_nodes(pdf, "regression")
        weights = np.asarray(est.treeWeights, dtype=float)
        return trees, weights, "margin"
    trees = _trees_from_nodes(pdf, "classification")
    return trees, np.full(len(trees), 1.0 / len(trees)), "probability"


# --- attribution of a batch of rows --------------------------------------------------

class Twig:
    """A subtree with all that its attributions depend on.

    ``conditions`` are (feature, low, high), each a bit of a row's code: first
    the merged interval of every feature on the way to the subtree, then the
    threshold of every node inside it. A leaf has for each of the twig's
    features the share of training weight that went its way and the bits that a
    row's code must show (``need``, ``want``) where the row follows it; a feature
    that is not on the leaf's way asks for nothing and has share 1.
    """

    __slots__ = ("conditions", "features", "values", "share", "need", "want")

    def __init__(self, tree: Tree, root: int, way: dict[int, tuple[float, float, float]]):
        self.conditions = [(f, low, high) for f, (low, high, _) in way.items()]
        start = {f: (share, 1 << i, 1 << i) for i, (f, (_, _, share)) in enumerate(way.items())}
        leaves, waiting = [], [(root, start)]
        while waiting:
            node, steps = waiting.pop()
            if tree.left[node] < 0:
                if steps and tree.value[node] != 0:
                    leaves.append((tree.value[node], steps))
                continue
            f, bit = int(tree.feature[node]), 1 << len(self.conditions)
            self.conditions.append((f, -np.inf, tree.threshold[node]))
            share, need, want = steps.get(f, (1.0, 0, 0))
            for child, seen in ((tree.left[node], bit), (tree.right[node], 0)):
                part = tree.cover[child] / tree.cover[node]
                waiting.append((child, {**steps, f: (share * part, need | bit, want | seen)}))
        self.features = sorted({f for _, steps in leaves for f in steps})
        self.values = [value for value, _ in leaves]
        cells = [[steps.get(f, (1.0, 0, 0)) for f in self.features] for _, steps in leaves]
        self.share, self.need, self.want = ([[cell[i] for cell in row] for row in cells] for i in range(3))


def twigs(tree: Tree, bits: int | None = None) -> list[Twig]:
    """The tree cut into the largest subtrees whose codes have at most ``bits``
    bits; a leaf with more features on its way is a twig of its own."""
    bits = DENSE_BITS if bits is None else bits
    inner = np.zeros(len(tree.left), np.int64)         # nodes with a split, in each subtree
    order, waiting = [], [0]
    while waiting:
        node = waiting.pop()
        order.append(node)
        if tree.left[node] >= 0:
            waiting += [int(tree.left[node]), int(tree.right[node])]
    for node in reversed(order):
        if tree.left[node] >= 0:
            inner[node] = 1 + inner[tree.left[node]] + inner[tree.right[node]]
    out, waiting = [], [(0, {})]
    while waiting:
        node, way = waiting.pop()
        if not inner[node] or len(way) + inner[node] <= bits:
            twig = Twig(tree, node, way)
            if twig.values:
                out.append(twig)
            continue
        f, at = int(tree.feature[node]), tree.threshold[node]
        low, high, share = way.get(f, (-np.inf, np.inf, 1.0))
        for child, own in ((tree.left[node], (low, min(high, at))), (tree.right[node], (max(low, at), high))):
            waiting.append((int(child), {**way, f: (*own, share * tree.cover[child] / tree.cover[node])}))
    return out


class Conditions:
    """The different conditions of a model, and which rows meet them."""

    def __init__(self):
        self.number: dict[tuple[int, float, float], int] = {}

    def add(self, conditions) -> list[int]:
        return [self.number.setdefault(c, len(self.number)) for c in conditions]

    def met(self, x: np.ndarray) -> np.ndarray:
        """Conditions x rows. As in a tree, what is not at most the threshold goes right."""
        out = np.empty((len(self.number), len(x)), bool)
        columns = np.ascontiguousarray(x.T)
        for (f, low, high), i in self.number.items():
            out[i] = columns[f] <= high if high < np.inf else True
            if low > -np.inf:
                out[i] &= ~(columns[f] <= low)
        return out


class TwigTable:
    """Twigs with the same numbers of conditions, features and leaves, as arrays.

    A row's attribution by a twig depends only on its code, so each (twig,
    code) is computed once and kept while the tables live: rows only look it
    up. What is kept is bounded by ``limit`` codes; beyond that, codes of a
    batch are computed for it alone.
    """

    def __init__(self, found: list[tuple[float, Twig]], conditions: Conditions, limit: int):
        self.conditions = conditions
        self.which = np.array([conditions.add(t.conditions) for _, t in found], np.int64)        # twig x bit
        self.bits = self.which.shape[1]
        self.features = np.array([t.features for _, t in found], np.int64)                       # twig x m
        self.m = self.features.shape[1]
        self.value = np.array([[w * v for v in t.values] for w, t in found]).T                   # leaf x twig
        self.share, self.need, self.want = (np.ascontiguousarray(np.moveaxis(np.array([getattr(t, k) for _, t in found]), 0, 2))
                                            for k in ("share", "need", "want"))                  # leaf x m x twig
        points, weights = np.polynomial.legendre.leggauss(self.m // 2 + 1)
        self.t, self.weights = (points + 1) / 2, weights / 2
        self.limit = limit
        self.keys = np.empty(0, np.int64)
        self.known = np.empty((0, self.m))

    def shapley(self, keys: np.ndarray) -> np.ndarray:
        """Shapley values of the features of each (twig, code), summed over the twig's leaves.

        A feature that is known sends the row its own way, an unknown one by
        training weight. The average over all orders of getting known is an
        integral over t of the product of (1 - t) * share + t * follows over the
        other features, a polynomial that Gauss-Legendre points integrate exactly.
        """
        out = np.empty((len(keys), self.m))
        for a in range(0, len(keys), STEP):
            twig, code = keys[a:a + STEP] >> self.bits, keys[a:a + STEP] & ((1 << self.bits) - 1)
            each = np.zeros((self.m, len(code)))
            for value, shares, need, want in zip(self.value, self.share, self.need, self.want, strict=True):
                share = shares[:, twig]                                                           # m x key
                follows = ((code & need[:, twig]) == want[:, twig]).astype(float)
                total = np.zeros_like(share)
                for t, weight in zip(self.t, self.weights, strict=True):
                    factor = share * (1 - t) + follows * t
                    total += weight * factor.prod(0) / factor
                each += value[twig] * (follows - share) * total
            out[a:a + STEP] = each.T
        return out

    def lookup(self, wanted: np.ndarray) -> np.ndarray:
        """The attributions of different keys in ascending order."""
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        old = self.keys[at] == wanted if len(self.keys) else np.zeros(len(wanted), bool)
        found = np.empty((len(wanted), self.m))
        found[old] = self.known[at[old]]
        fresh = wanted[~old]
        found[~old] = self.shapley(fresh)
        if len(fresh) and len(self.keys) + len(fresh) <= self.limit:
            keys_now = np.concatenate([self.keys, fresh])
            order = np.argsort(keys_now, kind="stable")
            self.keys, self.known = keys_now[order], np.concatenate([self.known, found[~old]])[order]
        return found

    def add(self, met: np.ndarray, phi: np.ndarray) -> None:
        """Add the attributions of the rows of ``met`` (conditions x rows) by these twigs to ``phi`` (features x rows)."""
        dense = self.bits <= DENSE_BITS
        code = np.zeros((len(self.which), met.shape[1]), np.int16 if dense else np.int64)
        for bit in range(self.bits):
            code |= met[self.which[:, bit]].astype(code.dtype) << code.dtype.type(bit)
        first = np.arange(len(self.which), dtype=np.int64) << self.bits
        if not dense:
            wanted, place = np.unique(first[:, None] + code, return_inverse=True)
            each = self.lookup(wanted).T
            for i, at in enumerate(place.reshape(code.shape)):
                for f, values in zip(self.features[i], each, strict=True):
                    phi[f] += values[at]
            return
        code = code.astype(np.intp)
        wanted = np.concatenate([np.flatnonzero(np.bincount(own, minlength=1)) + a for own, a in zip(code, first, strict=True)])
        each = np.empty((self.m, len(first) << self.bits))
        each[:, wanted] = self.lookup(wanted).T
        for i, at in enumerate(code):
            for f, values in zip(self.features[i], each[:, first[i]:first[i] + (1 << self.bits)], strict=True):
                phi[f] += values[at]


DENSE_BITS = 11                       # codes up to this are looked up by place; also where trees are cut
ROWS = 1 << 16                        # rows looked at together
CELLS = 64 << 20                      # (condition, row) bits looked at together
STEP = 1 << 12                        # (twig, code) pairs computed together
KEPT_CELLS = 16 << 20                 # attributions kept by all tables of a task
TWIGS = 16                            # twigs of a table


def leaf_tables(trees: list[Tree], weights: np.ndarray) -> list[TwigTable]:
    """A model's twigs by the shape of their arrays."""
    by_shape: dict[tuple[int, int, int], list[tuple[float, Twig]]] = {}
    for tree, weight in zip(trees, weights, strict=True):
        for twig in twigs(tree):
            by_shape.setdefault((len(twig.conditions), len(twig.features), len(twig.values)), []).append((weight, twig))
    total = sum(len(found) * m for (_, m, _), found in by_shape.items()) or 1
    conditions, out = Conditions(), []
    for _, found in sorted(by_shape.items()):
        for a in range(0, len(found), TWIGS):
            part = found[a:a + TWIGS]
            out.append(TwigTable(part, conditions, KEPT_CELLS * len(part) // total))
    return out


def shap_batch(tables: list[TwigTable], x: np.ndarray) -> np.ndarray:
    """Attributions (rows x features)."""
    phi = np.zeros((x.shape[1], len(x)))
    if tables:
        step = max(1, min(ROWS, CELLS // max(1, len(tables[0].conditions.number))))
        for a in range(0, len(x), step):
            met, part = tables[0].conditions.met(x[a:a + step]), np.zeros((x.shape[1], len(x[a:a + step])))
            for table in tables:
                table.add(met, part)
            phi[:, a:a + step] = part
    return np.ascontiguousarray(phi.T)


def expected_value(trees: list[Tree], weights: np.ndarray) -> float:
    """Cover-weighted mean leaf value = the root's value per tree."""
    return float(sum(w * t.value[0] for t, w in zip(trees, weights)))


def _gathered(batches, rows: int = ROWS):
    """The same rows in batches of about ``rows``: each distinct code of a batch is computed once."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def explain(df: DataFrame, model, features=K.FEATURE_COLUMNS, keys=("row_no",),
            tasks: int | None = None) -> DataFrame:
    """Long table (keys..., pos, feature, value, phi) of tree attributions for
    every row of ``df``. ``tasks`` deals the rows out first: attribution costs
    far more per row than reading it, and a small input is often one partition."""
    spark = df.sparkSession
    ship_package(spark)
    trees, weights, _ = read_trees(spark, model)
    sent = spark.sparkContext.broadcast(leaf_tables(trees, weights))   # model-sized, still empty of attributions
    feats, keys = list(features), list(keys)

    def run(batches):
        tables = sent.value                           # one per Python process: later batches find what earlier ones computed
        for pdf in _gathered(batches):
            x = pdf[feats].to_numpy(dtype=float)
            phi = shap_batch(tables, x)
            out = pdf[keys].loc[pdf.index.repeat(len(feats))].reset_index(drop=True)
            yield out.assign(pos=np.tile(np.arange(len(feats), dtype=np.int32), len(pdf)),
                             feature=feats * len(pdf), value=x.ravel(), phi=phi.ravel())

    key_schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)
    schema = f"{key_schema}, pos int, feature string, value double, phi double"
    # lineage is cut before the Python stage: a lost executor never makes upstream work run again
    inputs = df.select(*keys, *[F.col(f"`{f}`") for f in feats]).checkpoint(eager=True)
    return (inputs.repartition(tasks) if tasks else inputs).mapInPandas(run, schema)


def importance(long: DataFrame, decimals: int = 6) -> DataFrame:
    """I19 on tree attributions: mean absolute value per feature."""
    from churnkit.functions.numeric import half_even
    return long.groupBy(F.col("feature").alias("Feature")).agg(half_even(F.avg(F.abs("phi")), decimals).alias("Importance"))


def additivity(long: DataFrame, predicted: DataFrame, base: float, keys=("row_no",), tolerance: float = 1e-9) -> DataFrame:
    """(rows, violations): base plus a row's attributions is the model's output (``predicted.output``)."""
    total = long.groupBy(*keys).agg(F.sum("phi").alias("__phi"))
    off = F.abs(F.lit(float(base)) + F.col("__phi") - F.col("output")) > F.lit(tolerance)
    return predicted.join(total, list(keys), "left").agg(
        F.count("*").alias("rows"), F.count_if(F.coalesce(off, F.lit(True))).alias("violations"))


def top_drivers(long: DataFrame, n: int = K.TOP_DRIVERS, keys=("row_no",)) -> DataFrame:
    """I23 on tree attributions: positive phi, feature numeric (four named) or
    set to 1, largest first (ties in feature order), readable names, at most
    ``n``; rows without any driver are absent (null drivers)."""
    from pyspark.sql import Window
    from churnkit.functions.rules import driver_name
    keys = list(keys)
    kept = long.where((F.col("phi") > 0) & (F.col("feature").isin(K.DRIVER_NUMERIC) | (F.col("value") == 1.0)))
    w = Window.partitionBy(*keys).orderBy(F.desc("phi"), F.asc("pos"))
    ranked = (kept.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
              .withColumn("name", driver_name(F.col("feature"))))
    return ranked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("__d")) \
        .select(*keys, F.col("__d.name").alias("top_drivers"))

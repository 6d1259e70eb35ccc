"""Tree attribution: additivity (base + sum phi = model output) and driver rules."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnkit.operators import models as MD
from churnkit.operators import tree_shap as TS
from churnkit.plans import catalog as CAT


@pytest.mark.parametrize("name,kw", [("decision_tree", {"max_depth": 5}),
                                     ("random_forest", {"num_trees": 5, "max_depth": 4}),
                                     ("gradient_boosting_fast", {"rounds": 4})])
def test_additivity(spark, sf_dir, name, kw):
    data = CAT.scored(spark, sf_dir)
    model = MD.fit(data, name, **kw)
    rows = data.orderBy("row_no").limit(6)
    long = TS.explain(rows, model).groupBy("row_no").agg(F.sum("phi").alias("s"))
    trees, weights, output = TS.read_trees(spark, model)
    base = TS.expected_value(trees, weights)
    pred = model.transform(rows)
    col = (vector_to_array("probability")[1] if output == "probability"
           else vector_to_array("rawPrediction")[1])      # GBT raw = (-F, F); F is explained
    want = {r.row_no: r.v for r in pred.select("row_no", col.alias("v")).collect()}
    got = {r.row_no: r.s for r in long.collect()}
    assert set(got) == set(want)
    for k in want:
        assert abs(base + got[k] - want[k]) < 1e-9, (k, base + got[k], want[k])


def test_tree_drivers(spark, sf_dir):
    data = CAT.scored(spark, sf_dir)
    model = MD.fit(data, "decision_tree", max_depth=4)
    top = data.orderBy(F.desc("churn_probability"), "row_no").limit(3)
    d = TS.top_drivers(TS.explain(top, model)).collect()
    for r in d:
        assert 1 <= len(r.top_drivers) <= 4


def _brute(tree, x, n):
    """Shapley values by definition: every subset of features."""
    from itertools import combinations
    from math import factorial

    def value(known, node=0):
        if tree.left[node] < 0:
            return tree.value[node]
        f = tree.feature[node]
        if f in known:
            return value(known, tree.left[node] if x[f] <= tree.threshold[node] else tree.right[node])
        a, b = tree.left[node], tree.right[node]
        return (tree.cover[a] * value(known, a) + tree.cover[b] * value(known, b)) / tree.cover[node]

    out = []
    for j in range(n):
        rest = [f for f in range(n) if f != j]
        out.append(sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (value({*s, j}) - value(set(s)))
                       for k in range(n) for s in combinations(rest, k)))
    return out


def test_batch_equals_the_definition():
    rng = np.random.default_rng(5)
    n = 5
    for _ in range(6):
        left, right, feature, threshold, value, cover = [], [], [], [], [], []

        def grow(depth, weight):
            node = len(left)
            for a, v in ((left, -1), (right, -1), (feature, -1), (threshold, 0.0), (value, rng.normal()), (cover, weight)):
                a.append(v)
            if depth:
                feature[node], threshold[node] = int(rng.integers(n)), rng.normal()
                part = weight * rng.uniform(0.1, 0.9)
                left[node] = grow(depth - 1, part)
                right[node] = grow(depth - 1, weight - part)
            return node

        grow(4, 100.0)
        tree = TS.Tree(*map(np.array, (left, right, feature, threshold, value, cover)))
        x = rng.normal(size=(7, n))
        tables = TS.leaf_tables([tree], np.array([1.0]))
        got = TS.shap_batch(tables, x)
        assert np.array_equal(TS.shap_batch(tables, x), got)         # looked up, not computed
        for table in (none := TS.leaf_tables([tree], np.array([1.0]))):
            table.limit = 0
        assert np.array_equal(TS.shap_batch(none, x), got) and not any(len(t.keys) for t in none)
        want = np.array([_brute(tree, row, n) for row in x])
        assert np.abs(got - want).max() < 1e-10


def _grown(rng, depth, n):
    left, right, feature, threshold, value, cover = [], [], [], [], [], []

    def grow(depth, weight):
        node = len(left)
        for a, v in ((left, -1), (right, -1), (feature, -1), (threshold, 0.0), (value, rng.normal()), (cover, weight)):
            a.append(v)
        if depth:
            feature[node], threshold[node] = int(rng.integers(n)), rng.normal()
            part = weight * rng.uniform(0.1, 0.9)
            left[node] = grow(depth - 1, part)
            right[node] = grow(depth - 1, weight - part)
        return node

    grow(depth, 1000.0)
    return TS.Tree(*map(np.array, (left, right, feature, threshold, value, cover)))


def test_subtrees_are_looked_up_whole(monkeypatch):
    """A table has one lookup for several leaves; leaves alone, with codes too long to be places, give the same."""
    rng = np.random.default_rng(11)
    tree, x = _grown(rng, 7, 9), rng.normal(size=(50, 9))
    x[3, 4] = x[7, 0] = np.nan                            # goes right at every split, as in the tree
    tables = TS.leaf_tables([tree], np.array([1.0]))
    assert sum(len(t.which) for t in tables) <= 128 // 3
    got = TS.shap_batch(tables, x)
    monkeypatch.setattr(TS, "DENSE_BITS", 2)
    alone = TS.leaf_tables([tree], np.array([1.0]))
    assert max(t.bits for t in alone) > 2
    assert np.abs(TS.shap_batch(alone, x) - got).max() < 1e-12
    monkeypatch.setattr(TS, "ROWS", 7)
    assert np.abs(TS.shap_batch(tables, x) - got).max() < 1e-12
    for row, phi in zip(x, got, strict=True):
        node = 0
        while tree.left[node] >= 0:
            node = (tree.left if row[tree.feature[node]] <= tree.threshold[node] else tree.right)[node]
        base, at = 0.0, [(0, 1.0)]
        while at:
            i, share = at.pop()
            if tree.left[i] < 0:
                base += share * tree.value[i]
            else:
                at += [(c, share * tree.cover[c] / tree.cover[i]) for c in (tree.left[i], tree.right[i])]
        assert abs(base + phi.sum() - tree.value[node]) < 1e-10

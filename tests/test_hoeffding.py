"""Hoeffding trees: splits that the rows settle, against a plain search and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridge.operators import hoeffding as ho


def best_cut(x, y, bins):
    """(gain, limit) of the best of equal-width cuts by squared distance from the mean."""
    lo, hi = x.min(), x.max()
    b = np.minimum((x - lo) / (hi - lo) * bins // 1, bins - 1)
    spread = lambda v: ((v - v.mean()) ** 2).sum() if len(v) else 0.0
    gains = [(spread(y) - spread(y[b < c]) - spread(y[b >= c])) / len(y) for c in range(1, bins)]
    return max(gains), lo + (int(np.argmax(gains)) + 1) * (hi - lo) / bins


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random(12_000), rng.random(12_000)
    label = np.where(a < 0.5, "p", np.where(b < 0.25, "q", "r"))
    rows = [(float(x), float(y), str(v), 3.0 if x < 0.5 else 2 * float(y) + 7, k) for k, (x, y, v) in enumerate(zip(a, b, label, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c string, y double, node long")


def test_classes(points):
    tree = ho.grow(points, ["b", "a", "node"], "c", rounds=4, bins=16)
    assert tree.splits[1][0] == "a" and abs(tree.splits[1][1] - 0.5) < 0.04
    assert tree.splits[3][0] == "b" and abs(tree.splits[3][1] - 0.25) < 0.04
    by = {}
    for r in ho.leaves(points, tree, "c").collect():
        by.setdefault(r["node"], []).append(r["n"])
    assert sum(map(max, by.values())) > 0.97 * 12_000 and sum(map(sum, by.values())) == 12_000
    again = ho.grow(points.repartition(5), ["b", "a", "node"], "c", rounds=4, bins=16)
    assert again == tree


def test_values(points):
    tree = ho.grow(points, ["a", "b"], "y", classes=False, rounds=1, depth=1, bins=16)
    own = points.toPandas()
    gains = {f: best_cut(own[f].to_numpy(), own["y"].to_numpy(), 16) for f in "ab"}
    assert gains["a"][0] > gains["b"][0] and tree.splits == {1: ("a", pytest.approx(gains["a"][1]))}
    side = own["a"] < tree.splits[1][1]
    got = {r["node"]: r for r in ho.means(points, tree, "y").collect()}
    assert {n: (r["n"], r["mean"]) for n, r in got.items()} == {2: (side.sum(), pytest.approx(own["y"][side].mean())), 3: ((~side).sum(), pytest.approx(own["y"][~side].mean()))}
    line = {r["node"]: r for r in ho.lines(points.where("abs(a - 0.5) > 0.05"), tree, "b", "y").collect()}
    assert line[3]["slope"] == pytest.approx(2) and line[3]["intercept"] == pytest.approx(7) and line[2]["slope"] == pytest.approx(0)


def test_odd_rows(spark, points):
    """Nulls and NaN go right, unlabelled rows and constant columns say nothing, infinite values are the ends; few rows, or ties of two features, settle nothing."""
    odd = spark.createDataFrame([(None, 1.0, "n")] * 900 + [(math.nan, 1.0, "n")] * 100 + [(float(i % 7), 1.0, "v") for i in range(1000)] + [(math.inf, 1.0, "v"), (-math.inf, 1.0, "v"), (1.0, None, None)], "a double, b double, c string")
    tree = ho.grow(odd, ["a", "b"], "c", rounds=1, depth=1)
    assert tree.splits == {1: ("a", math.inf)}
    assert {(r["node"], r["label"]): r["n"] for r in ho.leaves(odd, tree, "c").collect()} == {(2, "v"): 1001, (3, "n"): 1000, (3, "v"): 1, (2, None): 1}
    assert ho.grow(odd, ["b"], "c") == ho.grow(odd.limit(0), ["a", "b"], "c") == ho.grow(points.limit(100), ["a"], "c") == ho.Tree()
    twins = points.withColumn("b", F.col("a"))
    assert ho.grow(twins, ["a", "b"], "c", tie=0.0) == ho.Tree()
    assert ho.grow(twins, ["a", "b"], "c", rounds=1, depth=1).splits[1][0] == "a"

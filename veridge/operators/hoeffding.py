"""Decision trees that split a leaf once the rows seen so far settle which split is best, with a stated chance of error."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridge.runtime import written


@dataclass
class Tree:
    """Splits by node: a row goes to node 2i if its feature is under the limit, else, or if it is null, to 2i + 1. The root is node 1."""

    splits: dict[int, tuple[str, float]] = field(default_factory=dict)

    def node(self, at: int = 1) -> Column:
        """The leaf of a row."""
        if at not in self.splits:
            return F.lit(at).cast("long")
        feature, limit = self.splits[at]
        return F.when(F.col(feature) < limit, self.node(2 * at)).otherwise(self.node(2 * at + 1))


def _counted(rows: DataFrame, node: Column, limits: dict[str, tuple[float, float]], classes: bool, bins: int) -> DataFrame:
    """``(node, feature, bin, label, n, s, ss)``: how many rows of a leaf have a feature in a bin and, for classes, a label; else the sums of labels and their squares. Summed within tasks before anything is shuffled."""
    cells = []
    for i, (f, (lo, hi)) in enumerate(limits.items()):
        x = F.greatest(F.least(F.col(f), F.lit(hi)), F.lit(lo))
        b = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)) if hi > lo else F.lit(0)
        cells.append(F.struct(F.lit(i).alias("feature"), F.when(F.col(f).isNull(), bins).otherwise(b.cast("int")).alias("bin")))
    y = F.lit(0.0) if classes else F.col("__y")
    own = rows.select(node.alias("node"), (F.col("__y").cast("string") if classes else F.lit("")).alias("label"), y.alias("y"), F.explode(F.array(*cells)).alias("c"))
    return own.groupBy("node", "c.feature", "c.bin", "label").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))


def _spread(n: np.ndarray, s: np.ndarray, ss: np.ndarray, classes: bool) -> np.ndarray:
    """How unlike the rows of each side are: the Gini impurity or the sum of squared distances from the mean, times their number. Labels come last."""
    total = n.sum(-1)
    many = np.maximum(total, 1)
    return total - (n * n).sum(-1) / many if classes else ss.sum(-1) - s.sum(-1) ** 2 / many


def _best(n: np.ndarray, s: np.ndarray, ss: np.ndarray, classes: bool) -> tuple[float, int]:
    """The greatest gain of a feature's cuts and the first bin of its right side; nulls are the last bin, always right. No cut gives 0."""
    left = [np.cumsum(x, 0)[:-1] for x in (n, s, ss)]
    right = [x.sum(0) - y for x, y in zip((n, s, ss), left, strict=True)]
    whole = [x.sum(0)[None] for x in (n, s, ss)]
    gain = _spread(*whole, classes) - _spread(*left, classes) - _spread(*right, classes)
    gain = np.where((left[0].sum(-1) > 0) & (right[0].sum(-1) > 0), gain / max(whole[0].sum(), 1), 0)
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 0 else (0.0, 0)


def settled(best: float, second: float, n: float, classes: bool, delta: float, tie: float) -> bool:
    """Whether ``n`` rows show, but for a chance of ``delta``, that the best gain beats the second: by their difference for classes, of range 1, by their ratio for values. Under a bound of ``tie`` either will do."""
    if best <= 0 or n <= 0:
        return False
    bound = math.sqrt(math.log(1 / delta) / (2 * n))
    return bound < tie or (best - second > bound if classes else second / best < 1 - bound)


def grow(df: DataFrame, features: list[str], label: str, classes: bool = True, rounds: int = 8, bins: int = 32, depth: int = 6, least: int = 200, delta: float = 1e-6, tie: float = 0.05, key: Column | None = None) -> Tree:
    """A tree for ``label``, classes or values, from numeric features.

    Rows are dealt to ``rounds`` batches by ``key``, a hash of their features and label if not given, and each is seen once: a batch is counted in equal bins of the features' ranges, by the leaves that the tree has by then; a leaf's counts grow until its best split is settled and it has ``least`` rows, and its children begin anew. Rows without a label teach nothing; features that are null or not a number go right. The table's few columns are read once a round. An empty table gives a tree of one leaf.

    Each round is one grouped sum. The driver gets the counts of open leaves: leaves x features x bins x labels, whatever the number of rows; classes should be few.
    """
    number = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f)
    y = F.col(label) if classes else number(label)
    batch = F.pmod(F.xxhash64(*features, label) if key is None else key, F.lit(rounds))
    rows = df.select(*map(number, features), y.alias("__y"), batch.alias("__batch")).where("__y is not null")
    inside = lambda f: F.when(F.abs(F.col(f)) < float("inf"), F.col(f))
    ranges = rows.agg(*(x for f in features for x in (F.min(inside(f)), F.max(inside(f))))).first()
    limits = {f: (ranges[2 * i], ranges[2 * i + 1]) for i, f in enumerate(features)}
    limits = {f: (lo, hi) if lo is not None else (0.0, 0.0) for f, (lo, hi) in limits.items()}
    tree, seen = Tree(), None
    for r in range(rounds):
        now = _counted(rows.where(F.col("__batch") == r), tree.node(), limits, classes, bins)
        if seen is not None:
            now = seen.union(now).groupBy("node", "feature", "bin", "label").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
        seen = written(now, instead_of=seen)
        by: dict[int, list] = {}
        for row in seen.collect():
            by.setdefault(row["node"], []).append(row)
        done = []
        for node, cells in by.items():
            names = {y: i for i, y in enumerate(sorted({c["label"] for c in cells}))}
            sums = np.zeros((3, len(features), bins + 1, len(names)))
            for c in cells:
                sums[:, c["feature"], c["bin"], names[c["label"]]] = c["n"], c["s"], c["ss"]
            gains = [_best(*sums[:, i], classes) for i in range(len(features))]
            order = sorted(range(len(features)), key=lambda i: (-gains[i][0], i))
            second = gains[order[1]][0] if len(order) > 1 else 0.0
            n = sums[0, 0].sum()
            gain, cut = gains[order[0]]
            if node < 1 << depth and n >= least and settled(gain, second, n, classes, delta, tie):
                lo, hi = limits[features[order[0]]]
                tree.splits[node] = (features[order[0]], lo + cut * (hi - lo) / bins if cut < bins and hi > lo else math.inf)
                done.append(node)
        if done:
            seen = written(seen.where(~F.col("node").isin(done)), instead_of=seen)
    return tree


def leaves(df: DataFrame, tree: Tree, label: str) -> DataFrame:
    """``(node, label, n)``: what classes the leaves hold."""
    return df.groupBy(tree.node().alias("node"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def means(df: DataFrame, tree: Tree, label: str) -> DataFrame:
    """``(node, n, mean)``: what a tree for values predicts."""
    return df.groupBy(tree.node().alias("node")).agg(F.count(label).alias("n"), F.avg(label).alias("mean"))


def lines(df: DataFrame, tree: Tree, x: str, label: str) -> DataFrame:
    """``(node, n, slope, intercept)``: a line in each leaf, which makes a model tree."""
    y = F.col(label)
    return df.groupBy(tree.node().alias("node")).agg(F.regr_count(y, F.col(x)).alias("n"), F.regr_slope(y, F.col(x)).alias("slope"), F.regr_intercept(y, F.col(x)).alias("intercept"))

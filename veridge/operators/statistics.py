"""Statistics of columns, prefix sums, range analysis and bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridge.runtime import ranked, written

#: Rows that one task sums in order.
BLOCK = 65_536


def describe(df: DataFrame, x: str) -> DataFrame:
    return df.agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.stddev_samp(x).alias("sd"))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-F.pow((x - mean) / sd, F.lit(2.0)) / 2) / (sd * (2 * 3.141592653589793) ** 0.5)


def relation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Covariance, squared correlation, and the line of y on x."""
    return df.agg(F.covar_samp(x, y).alias("cov"), F.pow(F.corr(x, y), F.lit(2.0)).alias("r2"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def find_min_max(df: DataFrame, x: str) -> DataFrame:
    """Least and most of values but zero, infinities and NaN."""
    c = F.col(x).cast("double")
    fine = (c != 0) & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.agg(F.min(F.when(fine, c)).alias("least"), F.max(F.when(fine, c)).alias("most"))


def analyse_range(df: DataFrame, x: str) -> DataFrame:
    c = F.col(x)
    n = lambda p: F.count(F.when(p, 1))
    return df.agg(F.min(c).alias("least"), F.min(F.when(c != 0, c)).alias("least_nonzero"), F.max(c).alias("most"), F.sum(c).alias("total"), F.sum(c * c).alias("squares"), n(c < 0).alias("n_negative"), n(c == 0).alias("n_zero"), n(c > 1).alias("n_over_one"))


def prefix_sums(df: DataFrame, order: list[str], x: str) -> DataFrame:
    """``df`` with ``prefix``, the sum of ``x`` over all rows before in the order, a total one. Rows are ranked in parallel and summed in blocks; the blocks' own sums are summed the same way, until they fit one block, so no task holds more than one."""
    if BLOCK < 2:
        raise ValueError("blocks have two rows at least")
    rows = written(ranked(df, [F.col(c) for c in order], "__rank").withColumn("__block", F.floor(F.col("__rank") / BLOCK)))
    before = _block_sums(rows.groupBy("__block").agg(F.sum(x).alias("__s")), rows.agg(F.max("__block")).first()[0] or 0)
    own = F.coalesce(F.sum(x).over(Window.partitionBy("__block").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__own", own).join(before, "__block").select(*df.columns, (F.col("__before") + F.col("__own")).alias("prefix"))


def _block_sums(sums: DataFrame, last: int) -> DataFrame:
    """``(__block, __before)``: what the blocks before each hold, of blocks 0 to ``last``."""
    over = Window.partitionBy("__up").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    inner = written(sums.withColumn("__up", F.floor(F.col("__block") / BLOCK))).withColumn("__own", F.coalesce(F.sum("__s").over(over), F.lit(0)))
    if last < BLOCK:
        return inner.select("__block", F.col("__own").alias("__before"))
    up = _block_sums(inner.groupBy(F.col("__up").alias("__block")).agg(F.sum("__s").alias("__s")), last // BLOCK).toDF("__up", "__more")
    return inner.join(up, "__up").select("__block", (F.col("__own") + F.col("__more")).alias("__before"))


def _poisson(u: Column) -> Column:
    """How often a row is drawn: a Poisson number of mean one from a number between 0 and 1."""
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    return sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))


def _resampled(df: DataFrame, x: str, key: str, samples: int, seed: int) -> DataFrame:
    """``(i, m)``: the means of Poisson resamples. A row's weights come from a hash of its key that any SQL engine can repeat; rows are weighed sample by sample within their task, and only sums leave it."""
    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(key).cast("long").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"))
    h = (F.col("k") % 1_000_003 * 7919 + (seed * 1000 + F.col("i")) * 104_729 + 12_345) % 2_147_483_647
    for _ in range(2):
        h = h * 48_271 % 2_147_483_647
    drawn = rows.select("i", "x", (h / 2_147_483_647.0).alias("u")).select("i", "x", _poisson(F.col("u")).alias("w"))
    return drawn.groupBy("i").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("m"))


def _limits(means: DataFrame) -> DataFrame:
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def bootstrap_mean(df: DataFrame, x: str, key: str, samples: int = 200, seed: int = 0) -> DataFrame:
    """``(mean, low, high)``: the mean of resampled means with their 95 % limits. Rows that share a key share their weights. No value that isn't null gives nulls."""
    return _limits(_resampled(df, x, key, samples, seed))


def bootstrap_difference(a: DataFrame, b: DataFrame, x: str, key: str, samples: int = 200, seed: int = 0) -> DataFrame:
    """``(mean, low, high)`` of the difference between the resampled means of two tables, drawn apart."""
    one, two = _resampled(a, x, key, samples, seed), _resampled(b, x, key, samples, seed + 1)
    return _limits(one.join(two.toDF("i", "other"), "i").select((F.col("m") - F.col("other")).alias("m")))


def normalised(df: DataFrame, x: str) -> DataFrame:
    """``df`` with ``z``, how many standard deviations ``x`` lies from its mean, from one row of statistics."""
    s = df.agg(F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__sd"))
    return df.crossJoin(s).select(*df.columns, F.try_divide(F.col(x) - F.col("__mean"), F.col("__sd")).alias("z"))


def split_at(df: DataFrame, x: str, at: Column) -> DataFrame:
    """Count, mean and variance of ``x`` below ``at`` and from it on."""
    side = lambda p, c: (F.count(F.when(p, F.col(x))).alias(f"n_{c}"), F.avg(F.when(p, F.col(x))).alias(f"mean_{c}"), F.var_samp(F.when(p, F.col(x))).alias(f"var_{c}"))
    return df.agg(*side(F.col(x) < at, "lt"), *side(F.col(x) >= at, "ge"))

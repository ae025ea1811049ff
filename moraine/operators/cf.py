"""Clustering features as plain aggregates.

A feature is ``(n, mean, s)``: weight, mean and sum of squared deviations, per element (diagonal), in one number
(spherical) or with cross products (full).  ``count``, ``avg`` and ``var_pop`` are mergeable and numerically stable in
Spark, so features need no aggregate of their own: partial results combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import long_form, sq_euclidean, total


def diagonal_long(df: DataFrame, keys: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """``(keys, j, n, mean, s)``; rows of weight 0 or less are left out."""
    if weight is None:
        flat = long_form(df, keys, vec)
        return flat.groupBy(*keys, "j").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("s"))
    flat = long_form(df.where(F.col(weight) > 0), [*keys, weight], vec)
    # deviations are taken from a value of the group, so that large offsets don't cancel
    anchor = flat.groupBy(*keys, "j").agg(F.min("x").alias("a"))
    flat = flat.join(anchor, [*keys, "j"]).withColumn("y", F.col("x") - F.col("a"))
    w = F.col(weight)
    sums = flat.groupBy(*keys, "j").agg(F.sum(w).alias("n"), F.sum(w * F.col("y")).alias("p"), F.sum(w * F.col("y") * F.col("y")).alias("q"), F.min("a").alias("a"))
    return sums.select(*keys, "j", "n", (F.col("a") + F.col("p") / F.col("n")).alias("mean"), F.greatest(F.col("q") - F.col("p") * F.col("p") / F.col("n"), F.lit(0.0)).alias("s"))


def diagonal(df: DataFrame, keys: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """``(keys, n, mean array, s array)``."""
    rows = diagonal_long(df, keys, vec, weight)
    sorted_rows = F.array_sort(F.collect_list(F.struct("j", "mean", "s")))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), sorted_rows.alias("r")).select(*keys, "n", F.col("r.mean").alias("mean"), F.col("r.s").alias("s"))


def spherical(df: DataFrame, keys: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """``(keys, n, mean array, s)``."""
    return diagonal(df, keys, vec, weight).withColumn("s", total(F.col("s")))


def full_long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, i, j, n, scatter)`` for i <= j over scalar columns: wide aggregates of one pass, no self join."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    aggs = [(F.covar_pop(columns[i], columns[j]) * F.count("*")).alias(f"m{i}_{j}") for i, j in pairs]
    wide = df.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"m{i}_{j}").alias("scatter")) for i, j in pairs])
    return wide.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "n", "r.i", "r.j", "r.scatter")


def merge(cfs: DataFrame, keys: list[str]) -> DataFrame:
    """Merge diagonal features ``(n, mean, s)`` of each key: S = sum S_i + sum n_i (mean_i - mean)^2."""
    flat = cfs.select(*keys, "n", F.posexplode(F.arrays_zip("mean", "s")).alias("j", "e")).select(*keys, "n", "j", "e.mean", "e.s")
    low = flat.groupBy(*keys, "j").agg(F.min("mean").alias("a"))
    flat = flat.join(low, [*keys, "j"]).withColumn("y", F.col("mean") - F.col("a"))
    n, y = F.col("n"), F.col("y")
    sums = flat.groupBy(*keys, "j").agg(F.sum(n).alias("n"), F.sum(n * y).alias("p"), F.sum(n * y * y).alias("q"), F.sum("s").alias("s"), F.min("a").alias("a"))
    mean = F.col("a") + F.col("p") / F.col("n")
    rows = sums.select(*keys, "j", "n", mean.alias("mean"), (F.col("s") + F.greatest(F.col("q") - F.col("p") * F.col("p") / F.col("n"), F.lit(0.0))).alias("s"))
    sorted_rows = F.array_sort(F.collect_list(F.struct("j", "mean", "s")))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), sorted_rows.alias("r")).select(*keys, "n", F.col("r.mean").alias("mean"), F.col("r.s").alias("s"))


def decay(cfs: DataFrame, factor: float) -> DataFrame:
    """Weight and scatter scaled alike: mean and variance stay."""
    kind = dict(cfs.dtypes)["s"]
    s = F.transform("s", lambda v: v * factor) if kind.startswith("array") else F.col("s") * factor
    return cfs.withColumn("n", F.col("n") * factor).withColumn("s", s)


def variance(n: Column, s: Column, dim: int | None = None) -> Column:
    """Per element for a diagonal feature; ``s / n / dim`` for a spherical one."""
    return F.transform(s, lambda v: F.when(n > 0, v / n).otherwise(0.0)) if dim is None else F.when(n > 0, s / n / dim).otherwise(0.0)


def from_moments(n: Column, mean: Column, s: Column) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), s.alias("s"))


# distances between features a and b (columns n, mean, s with a prefix), and between a feature and a point x


def d0(a: Column, b: Column) -> Column:
    """Squared distance of the means."""
    return sq_euclidean(a["mean"], b["mean"])


def d1(a: Column, b: Column) -> Column:
    """Manhattan distance of the means; the only one that is not squared."""
    return total(F.zip_with(a["mean"], b["mean"], lambda x, y: F.abs(x - y)))


def d2(a: Column, b: Column) -> Column:
    """Average squared distance between members; 0 if either is empty."""
    return F.when((a["n"] > 0) & (b["n"] > 0), d0(a, b) + _trace(a) / a["n"] + _trace(b) / b["n"]).otherwise(0.0)


def ward(a: Column, b: Column) -> Column:
    """Increase of scatter by the merge."""
    n = a["n"] + b["n"]
    return F.when(n > 0, a["n"] * b["n"] / n * d0(a, b)).otherwise(0.0)


def radius_sq(a: Column, b: Column) -> Column:
    """Squared radius of the merged feature."""
    n = a["n"] + b["n"]
    return F.when(n > 0, (_trace(a) + _trace(b) + ward(a, b)) / n).otherwise(0.0)


def _trace(a: Column) -> Column:
    return total(a["s"])


def point(x: Column) -> Column:
    """A point as a feature of weight 1."""
    return F.struct(F.lit(1.0).alias("n"), x.alias("mean"), F.transform(x, lambda v: F.lit(0.0)).alias("s"))


def chi2_distance(a: Column, x: Column, prior: float, dim: int) -> Column:
    """Sum (x - mean)^2 / ((s + k prior) / (n + k)) with k = dim + 2."""
    k = dim + 2
    both = F.zip_with(a["mean"], a["s"], lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    parts = F.zip_with(both, x, lambda e, v: (v - e["m"]) * (v - e["m"]) / ((e["s"] + k * prior) / (a["n"] + k)))
    return total(parts)

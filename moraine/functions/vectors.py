"""Vector expressions over ``array<double>`` columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    """Sum of the elements."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def l2_normalize(x: Column) -> Column:
    """Unit vectors; zero vectors stay as they are."""
    n = norm(x)
    return F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x)


def is_finite(x: Column) -> Column:
    """Whether a vector is there and all its elements are finite numbers."""
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def winsorize(x: Column, mean: Column, variance: Column, k: float) -> Column:
    """Clip each element to mean +- k standard deviations; elements of variance 0 pass."""
    spread = F.zip_with(mean, variance, lambda m, v: F.struct(m.alias("m"), (k * F.sqrt(v)).alias("w")))
    return F.zip_with(x, spread, lambda v, s: F.when(s["w"] > 0, F.greatest(F.least(v, s["m"] + s["w"]), s["m"] - s["w"])).otherwise(v))


def checked(df: DataFrame, vec: str, dim: int | None = None) -> DataFrame:
    """``df`` with ``vec`` as doubles; reading it fails on null, non-finite or wrongly sized vectors."""
    x = as_doubles(F.col(vec))
    ok = is_finite(x) & (F.size(x) > 0)
    if dim is not None:
        ok &= F.size(x) == dim
    return df.withColumn(vec, F.when(ok, x).otherwise(F.raise_error(F.lit(f"{vec}: expected a finite, non-empty vector" + (f" of {dim} elements" if dim else "")))))


def long_form(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """``(keys, j, x)``, a row an element."""
    return df.select(*keys, F.posexplode(as_doubles(F.col(vec))).alias("j", "x"))


def vector_of(df: DataFrame, keys: list[str], value: str, name: str, j: str = "j") -> DataFrame:
    """The inverse of ``long_form``: elements in order of ``j``."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(j, value))), lambda s: s[value]).alias(name))

"""Sparse rows ``struct<size, indices, values>``: checks, features and nearest features, without densifying on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked_sparse(df: DataFrame, col: str) -> DataFrame:
    """Fails on unequal lengths, indices outside the size or repeated, and values that aren't finite."""
    v, i, n = F.col(f"{col}.values"), F.col(f"{col}.indices"), F.col(f"{col}.size")
    ok = (F.size(v) == F.size(i)) & F.forall(i, lambda x: (x >= 0) & (x < n)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok &= F.size(F.array_distinct(i)) == F.size(i)
    return df.withColumn(col, F.when(F.coalesce(ok, F.lit(False)), F.col(col)).otherwise(F.raise_error(F.lit(f"{col}: not a valid sparse row"))))


def densify(df: DataFrame, col: str, dim: int, out: str) -> DataFrame:
    at = F.map_from_arrays(F.col(f"{col}.indices"), F.col(f"{col}.values"))
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.coalesce(F.element_at(at, j), F.lit(0.0))))


def entries(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """``(keys, j, x)`` of the stored elements."""
    z = F.arrays_zip(F.col(f"{col}.indices").alias("j"), F.col(f"{col}.values").alias("x"))
    return df.select(*keys, F.explode(z).alias("e")).select(*keys, F.col("e.j").alias("j"), F.col("e.x").alias("x"))


def sparse_cf(flat: DataFrame, key: str, row: str) -> DataFrame:
    """``(key, n, sq_sum, s)`` of rows in long form: s = sum |x|^2 - |sum x|^2 / n, at least 0 (the expanded form)."""
    n = flat.groupBy(key).agg(F.countDistinct(row).cast("double").alias("n"), F.sum(F.col("x") * F.col("x")).alias("q"))
    sums = flat.groupBy(key, "j").agg(F.sum("x").alias("x")).groupBy(key).agg(F.sum(F.col("x") * F.col("x")).alias("sq_sum"))
    return n.join(sums, key).select(key, "n", "sq_sum", F.greatest(F.col("q") - F.col("sq_sum") / F.col("n"), F.lit(0.0)).alias("s"))


def nearest_sparse(flat: DataFrame, row: str, centers: DataFrame, cid: str = "cid") -> DataFrame:
    """``(row, cid, d2)`` with centres in long form ``(cid, j, c)``: an equi-join on the element, ties to the smaller id."""
    size = centers.groupBy(cid).agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    own = flat.groupBy(row).agg(F.sum(F.col("x") * F.col("x")).alias("xx"))
    dots = flat.join(F.broadcast(centers), "j").groupBy(row, cid).agg(F.sum(F.col("x") * F.col("c")).alias("xc"))
    every = own.crossJoin(F.broadcast(size)).join(dots, [row, cid], "left")
    d = F.greatest(F.col("xx") - 2 * F.coalesce("xc", F.lit(0.0)) + F.col("cc"), F.lit(0.0))
    return every.groupBy(row).agg(F.min(F.struct(F.round(d, 9).alias("r"), F.col(cid).alias("c"), d.alias("d"))).alias("b")).select(row, F.col("b.c").alias(cid), F.col("b.d").alias("d2"))

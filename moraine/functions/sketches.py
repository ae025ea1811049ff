"""Mergeable quantile sketches: KLL (Spark's own aggregate) and DDSketch as a bucket table."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kll(df: DataFrame, value: str, k: int = 200, keys: list[str] | None = None) -> DataFrame:
    """``(keys, sketch, n, lo, hi)``; NaN and null are skipped; ends are kept exactly beside the sketch."""
    x = F.col(value).cast("double")
    src = df.where(~F.isnan(x) & x.isNotNull())
    aggs = [F.expr(f"kll_sketch_agg_double(cast(`{value}` as double), {int(k)})").alias("sketch"), F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")]
    return src.groupBy(*(keys or [])).agg(*aggs)


def kll_merge(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    aggs = [F.expr("kll_merge_agg_double(sketch)").alias("sketch"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    return sketches.groupBy(*(keys or [])).agg(*aggs)


def kll_quantile(q: float) -> Column:
    """Quantile of a ``sketch`` row; exact at 0 and 1; NaN if empty."""
    mid = F.expr(f"kll_sketch_get_quantile_double(sketch, {float(q)}D)")
    out = F.col("lo") if q <= 0 else F.col("hi") if q >= 1 else mid
    return F.when(F.col("n") > 0, out).otherwise(float("nan"))


def kll_rank(v: float) -> Column:
    """Estimated number of values <= v."""
    return F.expr(f"kll_sketch_get_rank_double(sketch, {float(v)}D)") * F.col("n")


@dataclass(frozen=True)
class DDSketch:
    """Relative-error buckets: key ceil(ln |x| / ln gamma), a store for each sign, a counter for zero."""

    alpha: float = 0.01
    max_bins: int = 2048
    gamma: float = field(init=False)

    def __post_init__(self):
        if not 0 < self.alpha < 1 or self.max_bins < 1:
            raise ValueError("alpha has to be inside (0, 1) and max_bins at least 1")
        object.__setattr__(self, "gamma", (1 + self.alpha) / (1 - self.alpha))

    def buckets(self, df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
        """``(keys, sign, bucket, cnt, lo, hi)``; NaN and null are skipped, infinities fail."""
        keys = keys or []
        x = F.col(value).cast("double")
        x = F.when(F.abs(x) == float("inf"), F.raise_error(F.lit("infinite value"))).otherwise(x)
        rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, x.alias("x"))
        bucket = F.when(F.col("x") == 0, 0).otherwise(F.ceil(F.log(F.abs("x")) / F.lit(math.log(self.gamma)))).cast("int")
        rows = rows.select(*keys, F.signum("x").cast("int").alias("sign"), bucket.alias("bucket"), "x")
        return self.collapse(rows.groupBy(*keys, "sign", "bucket").agg(F.count("*").alias("cnt"), F.min("x").alias("lo"), F.max("x").alias("hi")), keys)

    def collapse(self, buckets: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Fold the buckets of least magnitude of a store until ``max_bins`` are left."""
        keys = keys or []
        store = Window.partitionBy(*keys, "sign").orderBy(F.desc("bucket"))
        rows = buckets.withColumn("r", F.row_number().over(store))
        floor = F.min(F.when(F.col("r") <= self.max_bins, F.col("bucket"))).over(Window.partitionBy(*keys, "sign"))
        return rows.withColumn("bucket", F.greatest("bucket", floor)).groupBy(*keys, "sign", "bucket").agg(F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def merge(self, a: DataFrame, b: DataFrame, other: DDSketch | None = None, keys: list[str] | None = None) -> DataFrame:
        if other is not None and other.alpha != self.alpha:
            raise ValueError("sketches of different alpha can't be merged")
        keys = keys or []
        both = a.unionByName(b).groupBy(*keys, "sign", "bucket").agg(F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        return self.collapse(both, keys)

    def quantiles(self, buckets: DataFrame, qs: list[float]) -> DataFrame:
        """``(q, value)``: the bucket at rank floor(q (n - 1)); exact at 0 and 1.  A table of at most 2 max_bins + 1 rows."""
        g = self.gamma
        middle = F.col("sign") * 2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1)
        order = Window.partitionBy().orderBy(F.col("sign"), F.col("sign") * F.col("bucket"))
        rows = buckets.withColumn("value", middle).withColumn("cum", F.sum("cnt").over(order))
        ends = buckets.agg(F.sum("cnt").alias("n"), F.min("lo").alias("least"), F.max("hi").alias("most"))
        asked = buckets.sparkSession.createDataFrame([(float(q),) for q in qs], "q double")
        met = asked.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(rows.select("value", "cum")))
        rank = F.floor(F.col("q") * (F.col("n") - 1))
        hit = F.min(F.when(F.col("cum") > rank, F.struct("cum", "value")))
        got = met.groupBy("q", "n", "least", "most").agg(hit.alias("h"))
        return got.select("q", F.when(F.col("q") <= 0, F.col("least")).when(F.col("q") >= 1, F.col("most")).otherwise(F.col("h.value")).alias("value"))


def exact_rank(df: DataFrame, value: str, v: float) -> DataFrame:
    return df.agg(F.sum((F.col(value) <= v).cast("long")).alias("rank"))

"""Ingest checks and row transforms shared by every path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def prepare(df: DataFrame, vec: str, dim: int | None = None, normalize: bool = False) -> DataFrame:
    """Checked vectors as doubles, scaled to unit length if asked; used by fit, predict and inspection alike."""
    if not dict(df.dtypes)[vec].startswith(("array<double", "array<float")):
        raise TypeError(f"{vec}: expected an array of float or double, not {dict(df.dtypes)[vec]}")
    out = V.checked(df, vec, dim)
    return out.withColumn(vec, V.l2_normalize(F.col(vec))) if normalize else out


def split_mixed(df: DataFrame, vec: str, categorical: list[int], dim: int) -> DataFrame:
    """``num`` and ``cat`` arrays; codes have to be whole numbers >= 0, and both kinds have to exist."""
    cats = sorted(set(categorical))
    nums = [j for j in range(dim) if j not in cats]
    if not cats or not nums or cats[-1] >= dim or cats[0] < 0:
        raise ValueError("mixed data need at least one numeric and one categorical column, inside the vector")
    x = V.as_doubles(F.col(vec))
    code = lambda j: F.when((x[j] >= 0) & (x[j] == F.floor(x[j])), x[j].cast("int")).otherwise(F.raise_error(F.lit(f"column {j}: codes have to be whole numbers >= 0")))
    return df.withColumn("num", F.array(*[x[j] for j in nums])).withColumn("cat", F.array(*[code(j) for j in cats]))


def cardinalities(df: DataFrame, cat: str = "cat") -> list[int]:
    """``max code + 1`` of every attribute."""
    rows = df.select(F.posexplode(cat).alias("j", "c")).groupBy("j").agg((F.max("c") + 1).alias("m")).orderBy("j").collect()
    return [r["m"] for r in rows]


def huang_gamma(df: DataFrame, num: list[str]) -> float:
    """Half the mean standard deviation of the numeric columns; 1 if that is 0 or undefined."""
    row = df.agg(*[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(num)]).first()
    g = 0.5 * sum(x or 0.0 for x in row) / max(1, len(num))
    return g if g > 0 else 1.0


def budget_max_leaves(memory_mb: float, dim: int, feature: str = "diagonal", branching: int = 32) -> int:
    """Number of features that a memory budget holds."""
    extra = {"spherical": 8 * dim + 16, "diagonal": 16 * dim + 16, "full": 8 * dim + 4 * dim * (dim + 1), "fd": 16 * dim + 16}[feature]
    return max(branching + 1, min(int(memory_mb * (1 << 20) / (96 + extra)), 10_000_000))


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """Constraint pairs as (id_a, id_b); fails at planning if the columns are missing."""
    missing = {"id_a", "id_b"} - set(pairs.columns)
    if missing:
        raise ValueError(f"constraint pairs need columns id_a and id_b; missing {sorted(missing)}")
    return pairs.select(F.col("id_a").cast("long"), F.col("id_b").cast("long"))

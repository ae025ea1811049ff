"""Delimited text in, labels out, and the command line that joins them."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False) -> DataFrame:
    """``(id, features)`` of a text file: a fixed number of finite numbers a line, blank lines skipped.

    Ids follow the order of lines inside a file; ``-`` reads the driver's standard input; every line that breaks the form fails the query that reads it.
    """
    if len(delimiter.encode()) != 1:
        raise ValueError("the delimiter has to be one byte")
    if path == "-":  # what the driver's standard input holds
        text = spark.createDataFrame(list(enumerate(sys.stdin.read().splitlines())), "id long, value string")
    else:
        text = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"))
    lines = text.where(F.trim("value") != "")
    first = lines.orderBy("id").first()
    if first is None:
        raise ValueError(f"{path} holds no rows")
    if header:
        lines = lines.where(F.col("id") != first["id"])
        first = lines.orderBy("id").first()
        if first is None:
            raise ValueError(f"{path} holds no rows below its header")
    width = first["value"].count(delimiter) + 1
    numbers = F.transform(F.split("value", f"\\Q{delimiter}\\E", -1), lambda c: F.trim(c).try_cast("double"))
    good = (F.size(numbers) == width) & F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return lines.select("id", F.when(good, numbers).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} finite numbers: "), "value"))).alias("features"))


def write_labels(labelled: DataFrame, path: str, key: str = "id", label: str = "label") -> None:
    """One label a line, in order of ``key``."""
    labelled.orderBy(key).select(F.col(label).cast("string")).write.text(path)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Cluster the rows of a delimited file.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("-k", "--clusters", type=int, default=8)
    p.add_argument("--method", default="kmeans", choices=["kmeans", "gmm", "gmm-full", "ward", "hdbscan"])
    p.add_argument("--delimiter", default=",")
    p.add_argument("--header", action="store_true")
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--max-leaves", type=int, default=2000)
    p.add_argument("--seed", type=int, default=0)
    a = p.parse_args(argv)
    from ..estimator import Clustering

    spark = SparkSession.builder.getOrCreate()
    rows = read_points(spark, a.input, a.delimiter, a.header)
    model = Clustering(n_clusters=a.clusters, method=a.method, threshold=a.threshold, max_leaves=a.max_leaves, seed=a.seed).fit(rows, "features")
    write_labels(model.predict(rows), a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

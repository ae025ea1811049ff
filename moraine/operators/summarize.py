"""Summaries: points to at most ``max_leaves`` clustering features, in partitions and then together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .kernels import Features, compress, nearest

SCHEMA = "n double, mean array<double>, s array<double>, threshold double, rebuilds int"


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _rows(f: Features, threshold: float, rebuilds: int) -> pa.RecordBatch:
    m = len(f)
    lists = lambda x: pa.array(list(x.reshape(m, -1)), pa.list_(pa.float64()))
    return pa.record_batch([pa.array(f.n), lists(f.mean), lists(f.s), pa.array([threshold] * m), pa.array([rebuilds] * m, pa.int32())], ["n", "mean", "s", "threshold", "rebuilds"])


def _features(b: pa.RecordBatch) -> Features:
    mean, s = matrix(b.column("mean")), matrix(b.column("s"))
    d = mean.shape[1]
    return Features(b.column("n").to_numpy(zero_copy_only=False), mean, s.reshape(-1, d, d) if s.shape[1] == d * d and d > 1 else s)


def winsorized(x: np.ndarray, f: Features, k: float, least: float = 5.0) -> np.ndarray:
    """Points clipped to mean +- k sigma of their nearest feature, where that has weight ``least`` at least."""
    near, _ = nearest(x, f.mean)
    s = np.einsum("nii->ni", f.s) if f.s.ndim == 3 else f.s
    sigma = np.sqrt(s[near] / np.maximum(f.n[near], 1e-300)[:, None])
    lo, hi = f.mean[near] - k * sigma, f.mean[near] + k * sigma
    clip = (f.n[near] >= least)[:, None] & (sigma > 0)
    return np.where(clip, np.clip(x, lo, hi), x)


def _partial(vec: str, cap: int, full: bool, threshold: float, route: str, gate, huber: float | None):
    def run(batches: Iterator[pa.RecordBatch]):
        held, t, rebuilds = None, threshold, 0
        for b in batches:
            x = matrix(b.column(vec))
            step = max(cap, 512) if huber else len(x) or 1
            for a in range(0, len(x), step):
                y = x[a : a + step]
                if huber and held is not None:
                    y = winsorized(y, held, huber)
                f = Features.points(y, full)
                held = f if held is None else held.join(f)
                if len(held) > 4 * cap or huber:
                    held, t, r = compress(held, cap, t, route, gate)
                    rebuilds += r
        if held is not None and len(held):
            held, t, r = compress(held, cap, t, route, gate)
            yield _rows(held, t, rebuilds + r)

    return run


def _join(cap: int, route: str, gate):
    """Features of partitions together, streaming: what is held is compressed whenever it is four times the cap."""

    def run(batches):
        held, t, rebuilds = None, 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            f = _features(b)
            t = max(t, float(np.max(b.column("threshold").to_numpy(zero_copy_only=False))))
            rebuilds = max(rebuilds, int(np.max(b.column("rebuilds").to_numpy(zero_copy_only=False))))
            held = f if held is None else held.join(f)
            if len(held) > 4 * cap:
                held, t, r = compress(held, cap, t, route, gate)
                rebuilds += r
        if held is not None:
            held, t, r = compress(held, cap, t, route, gate)
            yield _rows(held, t, rebuilds + r)

    return run


def summarize(
    points: DataFrame, vec: str, max_leaves: int = 2000, feature: str = "diagonal", threshold: float = 0.0, route: str = "euclidean",
    gate: tuple[float, float] | None = None, huber: float | None = None, fan_in: int = 64,
) -> DataFrame:
    """A feature table of at most ``max_leaves`` rows.

    Each partition keeps at most ``max_leaves`` features while it streams over its rows; partitions' tables then meet
    in rounds of ``fan_in``, so no task reads more than ``fan_in * max_leaves`` rows however many partitions there are.
    """
    ship()
    full = feature == "full"
    parts = points.select(vec).mapInArrow(_partial(vec, max_leaves, full, threshold, route, gate, huber), SCHEMA)
    n = max(1, points.rdd.getNumPartitions()) if not points.isStreaming else 1
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.repartition(n, F.spark_partition_id()).mapInArrow(_join(max_leaves, route, gate), SCHEMA)
    return parts.repartition(1).mapInArrow(_join(max_leaves, route, gate), SCHEMA)


def collect(table: DataFrame) -> tuple[Features, float, int]:
    """The summary on the driver: at most ``max_leaves`` rows, a bound of the operator."""
    rows = table.toArrow().combine_chunks()
    if not rows.num_rows:
        raise ValueError("there are no rows to summarise")
    f = _features(rows.to_batches()[0])
    order = np.lexsort(f.mean.T[::-1])
    return f.take(order), float(rows.column("threshold")[0].as_py()), int(rows.column("rebuilds")[0].as_py())


def assign(points: DataFrame, vec: str, centers: np.ndarray, labels: np.ndarray | None = None, leaf: str = "leaf", distance: str = "d2", label: str = "label", chunk: int = 1 << 22) -> DataFrame:
    """Add the nearest centre's index, its squared distance and, if given, its label; no shuffle."""
    ship()
    if centers.size > chunk:
        raise ValueError("too many centres to broadcast")
    shared = points.sparkSession.sparkContext.broadcast((centers, labels))

    def run(batches):
        c, marks = shared.value
        for b in batches:
            i, d = nearest(matrix(b.column(vec)), c) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0))
            cols, names = [*b.columns, pa.array(i.astype(np.int32)), pa.array(d)], [*b.schema.names, leaf, distance]
            if marks is not None:
                cols.append(pa.array(marks[i].astype(np.int64)))
                names.append(label)
            yield pa.record_batch(cols, names)

    from pyspark.sql import types as T

    extra = [T.StructField(leaf, T.IntegerType()), T.StructField(distance, T.DoubleType())]
    extra += [T.StructField(label, T.LongType())] if labels is not None else []
    return points.mapInArrow(run, T.StructType([*points.schema.fields, *extra]))

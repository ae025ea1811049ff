"""Compressed sparse row matrices in: anything with ``indptr``, ``indices``, ``data`` and ``shape``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "id long, features struct<size:int,indices:array<int>,values:array<double>>"


def check_csr(indptr, indices, data, shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three arrays, after checks of lengths, order, index range and finite values."""
    indptr, indices, data = np.asarray(indptr, np.int64), np.asarray(indices, np.int64), np.asarray(data, float)
    if len(indptr) != shape[0] + 1 or indptr[0] != 0 or indptr[-1] != len(data) or len(indices) != len(data):
        raise ValueError("indptr, indices and data don't fit together")
    if (np.diff(indptr) < 0).any():
        raise ValueError("indptr has to be non-decreasing")
    if len(indices) and (indices.min() < 0 or indices.max() >= shape[1]):
        raise ValueError("an index is outside the columns")
    if not np.isfinite(data).all():
        raise ValueError("values have to be finite")
    return indptr, indices, data


def sparse_rows(spark: SparkSession, matrix) -> DataFrame:
    """``(id, features)`` of a matrix on the driver; other formats are converted by their own ``tocsr``."""
    m = matrix if hasattr(matrix, "indptr") else matrix.tocsr()
    indptr, indices, data = check_csr(m.indptr, m.indices, m.data, m.shape)
    rows = [(i, (int(m.shape[1]), indices[a:b].tolist(), data[a:b].tolist())) for i, (a, b) in enumerate(zip(indptr[:-1], indptr[1:], strict=True))]
    return spark.createDataFrame(rows, SCHEMA)

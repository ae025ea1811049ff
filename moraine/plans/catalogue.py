"""The registered queries of the core library and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from .kernel_queries import KERNELS, KERNELS_SQL
from .mixed_queries import MIXED, MIXED_SQL
from .model_queries import MODELS, flagship
from .vector_queries import VECTORS, VECTORS_SQL

QUERIES = {**VECTORS, **MIXED, **MODELS, **KERNELS}
ORACLES = {**VECTORS_SQL, **MIXED_SQL, **KERNELS_SQL}

__all__ = ["ORACLES", "QUERIES", "flagship"]

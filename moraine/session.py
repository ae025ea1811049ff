"""Session helpers: the shared scratch folder, lineage cuts and shipping code to executors."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch for columns of whole texts; a batch is held on both sides of the Python boundary.
TEXT_ROWS = 256


def ship(texts: bool = False) -> None:
    """Pickle this package's functions by value, so executors need no installed copy.

    With ``texts``, batches are kept small enough for columns of whole documents.
    """
    spark = SparkSession.getActiveSession()
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if texts and spark is not None and not 0 < int(spark.conf.get(rows)) <= TEXT_ROWS:
        spark.conf.set(rows, str(TEXT_ROWS))
    for name, module in list(sys.modules.items()):
        if name == "moraine" or name.startswith("moraine."):
            cloudpickle.register_pickle_by_value(module)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset (tests, local mode) one is made."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="moraine-checkpoint-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/moraine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or it with underscores before it, so that it clashes with no column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def hash_sample(df: DataFrame, key: str, limit: int, rows: int | None = None, seed: int = 0, where=None) -> DataFrame:
    """At most ``limit`` rows, the same on every run: rows are thinned by a hash of ``key`` before they are ordered
    by it, so what meets in the last task stays near ``limit`` at every size.  ``rows`` is the row count, if known;
    ``where`` is a further condition, read for the thinned rows only."""
    rows = df.count() if rows is None else rows
    h = F.xxhash64(key, F.lit(seed))
    if rows > 4 * limit:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * limit / rows))
    return (df if where is None else df.where(where)).orderBy(h, key).limit(limit)


def clean_scratch(spark: SparkSession) -> None:
    """Remove the tables that operators wrote to the shared folder, once their results have been read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/moraine")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids up to which a table of ids is broadcast (8 MB); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``ids`` (one column, stored or cheap to count); null keys stay."""
    gone = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    return df.join(gone, key, "left_anti")

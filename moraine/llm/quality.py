"""Operator 7: quality classifier by supervised subword embeddings.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1.  Defined results: documents
with null or empty text get the prior score; a null doc_id counts as not held out; repeated rows each get
their row; documents with clashing labels are left out of training; with no usable label every score is 0.5.
Extra columns are ignored; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh, hash_sample
from .subword import SubwordModel, fit, score_documents

#: Defaults of ``per_class`` and ``fit_bytes``.
FIT_PER_CLASS, FIT_BYTES = 1000, 1 << 16


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = FIT_PER_CLASS, classes: int = 2, fit_bytes: int = FIT_BYTES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts and labels of a sample bounded per class, chosen by a hash of the id, and the class shares of all rows."""
    spark = docs.sparkSession
    one = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 1))
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where(f"y = z and y between 0 and {classes - 1}")
        .select("doc_id", F.col("y").cast("int").alias("y"))
    )
    shares = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = [hash_sample(one.where(F.col("y") == c), "doc_id", per_class, shares.get(c, 0)) for c in range(classes)]
    rows = [(r["doc_id"], r["y"]) for part in ids for r in part.collect()]  # at most classes x per_class ids
    prior = np.array([shares.get(c, 0) for c in range(classes)], float)
    if not rows:
        return [], np.zeros(0, int), prior
    chosen = F.broadcast(spark.createDataFrame(rows, one.schema))  # the same bound
    found = docs.select("doc_id", "text").where(F.octet_length("text") <= fit_bytes).join(chosen, "doc_id")
    got = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(1))).collect()
    return [r["text"] for r in got], np.array([r["y"] for r in got], int), prior


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = FIT_PER_CLASS, fit_bytes: int = FIT_BYTES) -> SubwordModel:
    texts, y, prior = labelled_sample(docs, labels, "quality", per_class, fit_bytes=fit_bytes)
    if not texts:
        return SubwordModel(np.zeros((4, 2), np.float32), np.zeros(2))
    return fit(texts, y, 2, prior / prior.sum())


def score_quality(docs: DataFrame, model: SubwordModel, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every document, then the probability of label 1 and the prediction (the last two columns)."""
    keep = keep or ["doc_id"]
    probs, score, predicted = (fresh(x, keep) for x in ("probs", "score", "predicted"))
    out = score_documents(docs, model, keep, out=probs)
    return out.select(*keep, F.col(probs)[1].alias(score), (F.col(probs)[1] >= 0.5).cast("int").alias(predicted))


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")

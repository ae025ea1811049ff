"""A training-corpus pipeline: each stage applies one operator of ``moraine.llm`` to all its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.llm.decontaminate import decontaminate
from moraine.llm.jaccard import jaccard_join
from moraine.llm.mixing import TARGETS, mix
from moraine.llm.packing import pack_documents
from moraine.llm.quality import fit_quality, score_quality
from moraine.session import fresh, shared_dir, stored, without

#: Words of a shingle and least similarity (hundredths) of near duplicates.
SHINGLE, SIMILAR = 5, 80


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column that names each row by a long: its id where that is an integer that occurs once, else
    64 bits of id and text, so that different texts under one id, or without any, are told apart; and its name."""
    key = fresh("key", docs.columns)
    named = F.xxhash64(F.col("doc_id"), F.col("text"))
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.withColumn(key, named), key
    lone = F.col("doc_id").cast("long")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = stored(repeated, "repeated")
    if not repeated.limit(1).count():
        return docs.withColumn(key, F.when(F.col("doc_id").isNull(), named).otherwise(lone)), key
    mark = fresh("again", docs.columns)
    marked = docs.join(repeated.withColumn(mark, F.lit(True)), "doc_id", "left").select(*docs.columns, mark)
    once = F.col("doc_id").isNotNull() & F.col(mark).isNull()
    return marked.withColumn(key, F.when(once, lone).otherwise(named)).drop(mark), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on the labelled documents among those given.

    Each row is judged by its own text: repeated rows alike, null and empty texts by the prior; an empty table stays empty.
    """
    scored = score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=docs.columns)
    return scored.where(F.col(scored.columns[-1]) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that with the smallest id, where ids are integers that occur once.

    Rows with the same id and text are one document, of which one row stays; different texts under one id or under null
    are different documents.  Null and empty texts are near duplicates of nothing.
    """
    rows, key = keyed(docs)
    classes = stored(jaccard_join(rows, id_col=key, n=SHINGLE, threshold=SIMILAR), "classes")
    out = without(rows, classes.where("component_id <> id").select(F.col("id").alias(key)).distinct(), key)
    if classes.groupBy("id").count().where("count > 1").limit(1).count():
        out = out.where("text is null").unionByName(out.where("text is not null").dropDuplicates([key]))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with a null or repeated id too; null and empty texts stay."""
    rows, key = keyed(docs)
    hits = decontaminate(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(rows, stored(hits.select(F.col("doc_id").alias(key)).distinct(), "hits"), key).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by their rate, so that languages meet their weights; none is dropped.

    Null and empty texts weigh nothing and stay; ids of any type; repeated rows are rows each.
    """
    mixed = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS, floor=1.0, keep=docs.columns)
    copy = fresh("copy", mixed.columns)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(mixed.columns[-1])))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as packed token ids; one row per row of ``docs`` read back from the matrices, null texts included."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("packing", packing),
]

#: No stage before the last can be stated in SQL (a trained model decides); tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/moraine/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs

"""The pipeline: every stage on its own input, and the whole of it."""

import corpus_pipeline as C
from pyspark.sql import functions as F

from tests.llm.test_pairs import brute_jaccard

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit(1)).withColumn("copies", F.lit("x"))
    more = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(2)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**6).cast("long")))
    docs = docs.union(more).union(docs.limit(1).withColumn("doc_id", F.lit(3).cast("long")).withColumn("text", F.lit("another text under an id that is there")))
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(C.STAGES) - 1:
            assert docs.columns == before.columns
        if name == "near_duplicates":
            rows = sorted({(r["doc_id"], r["text"]) for r in before.collect()}, key=str)
            classes = brute_jaccard([(k, t) for k, (_, t) in enumerate(rows)], C.SHINGLE, C.SIMILAR)
            of = {r: classes[k][1] for k, r in enumerate(rows)}
            kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert sorted(of[r] for r in kept) == sorted({c for _, c in classes.values()})
            lone = {c: min(i for (i, _), x in of.items() if x == c) for c in of.values() if all(i not in (None, 3) for (i, _), x in of.items() if x == c)}
            ids = {i for i, _ in kept}
            assert sum(i in ids for i in lone.values()) >= 0.9 * len(lone)
        elif name == "mixture":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} and docs.count() >= before.count()
        elif name == "packing":
            assert docs.count() == before.count()
        else:
            assert docs.count() <= before.count()


def test_rows_of_one_id_or_none_are_told_apart(spark):
    """Different texts under one id or under null are judged apart; of equal rows one stays; null texts stay."""
    words = " ".join("w%d" % k for k in range(60))
    other = " ".join("v%d" % k for k in range(60))
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    rows = [(1, words), (1, other), (2, words + " x"), (None, other + " y"), (None, item), (3, "z " + item), (3, words + " q r s t"), (4, None), (4, None), (None, None), (5, "five"), (5, "five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k"))
    kept = C.near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert len(texts) == 7 and texts.count(None) == 3 and texts.count("five") == 1
    clean = C.decontamination(spark, docs, DATA)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 2 and clean.where("text like '%" + item[:20] + "%'").count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for _, stage in C.STAGES[1:3]:
        assert stage(spark, named, DATA).where("doc_id = 'd4'").count() >= 1


def test_run(spark):
    out = C.run(spark, DATA)
    assert out.count() > 100 and "doc_id" in out.columns and 4 <= len(C.STAGES) <= 5
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, DATA).count() == 0

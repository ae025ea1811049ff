"""Queries that fit models; iterative or order-dependent, so without an SQL twin."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..estimator import Clustering, KPrototypes, fit_predict_sparse
from ..operators.kernels import FrequentDirections
from ..operators.summarize import matrix
from ..functions.sketches import kll, kll_merge, kll_rank
from ..session import shared_dir, ship
from ..streaming.evolving import run_stream
from .mixed_queries import _terms, mixed
from .vector_queries import emb, label_cf, table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summarise the embeddings, cluster the summary by k-means, label every row."""
    rows = emb(spark, sf_dir)
    model = Clustering(n_clusters=8, method="kmeans").fit(rows.drop("label"), "x")
    return model.predict(rows.drop("label")).select("vec_id", "label")


def _items(s, d) -> DataFrame:
    """Line items in four standardised measures."""
    x = table(s, d, "lineitem").select(F.monotonically_increasing_id().alias("id"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("p"), (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"))
    return x.select("id", F.array(*[F.col(c).cast("double") for c in ("l_quantity", "p", "d", "t")]).alias("x"))


def _fit(method: str, k: int = 8, **params):
    def run(s, d):
        rows = _items(s, d)
        model = Clustering(n_clusters=k, method=method, **params).fit(rows, "x")
        return model.predict(rows).groupBy("label").agg(F.count("*").alias("n"))

    return run


def fit_hdbscan(s, d):
    """Density clusters of customers by nation and balance: nations lie apart, so each of them is dense."""
    rows = table(s, d, "customer").select("c_custkey", F.array(F.col("c_nationkey") * 100.0, (F.col("c_acctbal") / 1000).cast("double")).alias("x"))
    model = Clustering(method="hdbscan", max_leaves=500, min_samples=2, min_cluster_size=3).fit(rows, "x")
    return model.predict(rows).groupBy("label").agg(F.count("*").alias("n"))


def fit_kprototypes(s, d):
    rows = mixed(s, d).select("c_custkey", F.array("b", F.col("code").cast("double")).alias("x"))
    return KPrototypes(n_clusters=4, categorical=(1,), max_leaves=256).fit(rows, "x").predict(rows).select("c_custkey", "label")


def fit_sparse(s, d):
    rows = _terms(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("e"))
    rows = rows.select("doc_id", F.struct(F.lit(14).alias("size"), F.col("e.j").alias("indices"), F.col("e.x").alias("values")).alias("v"))
    return fit_predict_sparse(rows, "v", 14, 4).select("doc_id", "label")


def fd_cf(s, d):
    """Frequent-directions features of each partition, merged; the captured share of the total scatter."""
    ship()

    def run(batches):
        import pyarrow as pa

        f = None
        for b in batches:
            x = matrix(b.column("x"))
            if len(x):
                f = f or FrequentDirections(x.shape[1])
                f.add(x)
        if f is not None:
            yield pa.record_batch([pa.array([f.n]), pa.array([f.mean.tolist()]), pa.array([f.rows.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "rows"])

    parts = emb(s, d).select("x").mapInArrow(run, "n double, mean array<double>, rows array<double>").collect()  # a row a partition
    whole = FrequentDirections(len(parts[0]["mean"]))
    for p in parts:
        other = FrequentDirections(len(p["mean"]))
        other.n, other.mean, other.rows = p["n"], np.array(p["mean"]), np.array(p["rows"]).reshape(-1, len(p["mean"]))
        whole.merge(other)
    total = label_cf(s, d)
    return s.createDataFrame([(whole.n, len(whole.rows), float((whole.rows**2).sum()))], "n double, sketch_rows int, captured double").crossJoin(total.agg(F.count("*").alias("labels")))


def mapper_bridges(s, d):
    g = Clustering(n_clusters=4, method="kmeans", max_leaves=200).fit(_items(s, d), "x").mapper(s, lens="coordinate", resolution=6, gain=0.4, link_scale=3.0)
    return s.createDataFrame([(g.nodes.count(), g.edges.count(), len(g.bridges), *g.betti())], "nodes long, edges long, bridges int, components int, loops int")


def robust_fit(s, d):
    rows = _items(s, d)
    model = Clustering(n_clusters=4, method="kmeans", max_leaves=200, huber_k=3.0).fit(rows, "x")
    return model.clusters(s).select("label", "size", F.round("radius", 6).alias("radius"))


def fit_constrained(s, d):
    """k-means that keeps a must-link and a cannot-link between rows."""
    rows = emb(s, d).select(F.col("vec_id").alias("id"), "x")
    pair = lambda a, b: s.createDataFrame([(a, b)], "id_a long, id_b long")
    model = Clustering(n_clusters=6, method="kmeans").fit(rows, "x", must_link=pair(0, 1), cannot_link=pair(0, 2))
    return model.predict(rows).select("id", "label")


def soft_labels(s, d):
    rows = _items(s, d)
    model = Clustering(n_clusters=4, method="gmm", max_leaves=500).fit(rows, "x")
    return model.predict_proba(rows).groupBy("label").agg(F.round(F.sum("probability"), 3).alias("mass"))


def mapper_sweep(s, d):
    model = Clustering(n_clusters=4, method="kmeans", max_leaves=100).fit(_items(s, d), "x")
    got = model.mapper_stability(s, [4, 8], lens="coordinate", link_scale=2.0)
    return s.createDataFrame([(g["resolution"], g["components"], g["loops"]) for g in got], "resolution int, components int, loops int")


def _stream(kind: str, **params):
    def run(s, d):
        rows = table(s, d, "events").select("event_id", "event_type", F.array((F.col("value") / 50).cast("double")).alias("x"))
        return run_stream(rows, "x", ["event_id"], kind, "event_type", **params).select("stream", "tick", F.round("weight", 6).alias("weight"), F.round(F.col("center")[0], 6).alias("center"))

    return run


def kll_ranks(s, d):
    got = kll(table(s, d, "events").select("event_type", "value"), "value", 400, ["event_type"])
    return kll_merge(got).select("n", F.round(kll_rank(50.0), 0).alias("rank"))


def saved_model(s, d):
    """Labels of a model that was written and read again."""
    rows = emb(s, d).drop("label")
    path = f"{shared_dir(s)}/moraine/model-{uuid.uuid4().hex}"
    Clustering(n_clusters=5, method="gmm").fit(rows, "x").save(s, path)
    return Clustering.load(s, path).predict(rows).select("vec_id", "label")


MODELS = {
    "fit_constrained": fit_constrained, "soft_labels": soft_labels, "mapper_sweep": mapper_sweep, "saved_model": saved_model, "kll_ranks": kll_ranks,
    "run_denstream": _stream("denstream", eps=0.3, decay=0.001, beta=0.5, mu=4.0), "run_dbstream": _stream("dbstream", r=0.3, decay=0.001),
    "fit_kmeans": _fit("kmeans"), "fit_xmeans": _fit("kmeans", 0, max_leaves=500), "fit_gmm": _fit("gmm", feature="diagonal"), "fit_gmm_full": _fit("gmm-full", feature="full", max_leaves=500),
    "fit_ward": _fit("ward", max_leaves=1000), "fit_hdbscan": fit_hdbscan, "fit_normalized": _fit("kmeans", normalize=True),
    "fit_chi2": _fit("kmeans", absorb="chi2", chi2_scale=0.5, max_leaves=500), "fit_kprototypes": fit_kprototypes, "fit_sparse": fit_sparse,
    "fd_cf": fd_cf, "mapper_bridges": mapper_bridges, "robust_fit": robust_fit, "embedding_labels": flagship,
}

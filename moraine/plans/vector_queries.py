"""Queries over the embeddings: features, distances, assignment, inspection, graph steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cf as C
from ..operators import inspection as I
from ..operators import topology as T
from ..operators.graph import connected_components
from ..operators.kernels import core_distances

CHI2_PRIOR = 0.01


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def emb(s, d) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"))


def label_cf(s, d) -> DataFrame:
    return C.diagonal(emb(s, d), ["label"], "x")


def centers(s, d) -> DataFrame:
    return label_cf(s, d).select(F.col("label").alias("cid"), "mean")


def as_leaves(s, d) -> DataFrame:
    """Label features as a leaf table."""
    return label_cf(s, d).withColumnRenamed("label", "leaf")


def cf_diagonal(s, d):
    return C.diagonal_long(emb(s, d), ["label"], "x").select("label", "j", F.col("n").cast("long").alias("n"), F.round("mean", 9).alias("mean"), F.round("s", 9).alias("s"))


def cf_spherical(s, d):
    f = C.spherical(emb(s, d), ["label"], "x")
    return f.select("label", F.col("n").cast("long").alias("n"), F.round("s", 8).alias("s"), F.round(C.variance(F.col("n"), F.col("s"), 64), 9).alias("variance"))


def cf_decay(s, d):
    f = C.decay(label_cf(s, d), 0.5)
    return f.select("label", "n", F.round(V.total(F.col("s")), 8).alias("s"), F.round(V.total(C.variance(F.col("n"), F.col("s"))), 8).alias("variance"))


def cf_merge_equals_global(s, d):
    parts = C.merge(label_cf(s, d).withColumn("g", F.lit(0)), ["g"])
    return parts.select(F.col("n").cast("long").alias("n"), F.posexplode("s").alias("j", "v")).select("n", "j", F.round("v", 7).alias("s"))


def l2_normalize(s, d):
    scaled = emb(s, d).select("vec_id", F.transform("x", lambda v: v * 3 + 0.1).alias("x"))
    return V.long_form(scaled.select("vec_id", V.l2_normalize(F.col("x")).alias("x")), ["vec_id"], "x").groupBy("vec_id").agg(F.round(F.sum(F.col("x") * (F.col("j") + 1)), 8).alias("moment"))


def winsorize(s, d):
    stats = F.broadcast(C.diagonal(emb(s, d), [], "x").select("mean", C.variance(F.col("n"), F.col("s")).alias("var")))
    out = emb(s, d).crossJoin(stats).select("vec_id", V.winsorize(F.col("x"), F.col("mean"), F.col("var"), 1.0).alias("x"))
    return out.select("vec_id", F.round(V.total(F.col("x")), 8).alias("total"))


def ingest_checks(s, d):
    ok = V.checked(emb(s, d), "x", 64)
    whole = ok.agg(F.count("*").alias("n"))  # one row
    return ok.select(F.size("x").alias("dim"), F.round(V.norm(F.col("x")), 6).alias("norm")).distinct().crossJoin(F.broadcast(whole)).select("n", "dim", "norm")


def kernels(s, d):
    x = emb(s, d).select("vec_id", "x")
    first = F.broadcast(x.where("vec_id < 3").select(F.col("vec_id").alias("other"), F.col("x").alias("y")))
    a, b = F.col("x"), F.col("y")
    return x.crossJoin(first).select("vec_id", "other", F.round(V.sq_euclidean(a, b), 8).alias("sq"), F.round(V.dot(a, b), 8).alias("dot"), F.round(V.manhattan(a, b), 8).alias("l1"))


def _pairs(s, d, measure):
    f = label_cf(s, d)
    a = f.select(F.col("label").alias("a"), F.struct("n", "mean", "s").alias("fa"))
    b = F.broadcast(f.select(F.col("label").alias("b"), F.struct("n", "mean", "s").alias("fb")))
    return a.crossJoin(b).where("a < b").select("a", "b", F.round(measure(F.col("fa"), F.col("fb")), 7).alias("d"))


def dist_chi2(s, d):
    f = F.broadcast(label_cf(s, d).select("label", F.struct("n", "mean", "s").alias("f")))
    return emb(s, d).drop("label").crossJoin(f).groupBy("label").agg(F.round(F.sum(C.chi2_distance(F.col("f"), F.col("x"), CHI2_PRIOR, 64)), 4).alias("total"))


def assign_nearest(s, d):
    got = I.nearest_center(emb(s, d), centers(s, d), ["vec_id"], "x")
    return got.select("vec_id", "cid", F.round("d2", 7).alias("d2"))


def assigned(s, d) -> DataFrame:
    got = I.nearest_center(emb(s, d), centers(s, d), ["vec_id"], "x")
    return emb(s, d).drop("label").join(got.withColumnRenamed("cid", "label"), "vec_id")


def stats(s, d) -> DataFrame:
    f = label_cf(s, d)
    return f.select("label", F.col("n").alias("size"), F.col("mean").alias("center"), F.sqrt(V.total(F.col("s")) / F.col("n")).alias("radius"))


def cluster_stats(s, d):
    halves = C.diagonal(emb(s, d).withColumn("half", F.col("vec_id") % 2), ["label", "half"], "x")
    return I.cluster_stats(halves).select("label", F.col("size").cast("long").alias("size"), F.round("radius", 8).alias("radius"), F.round(V.total(F.col("center")), 8).alias("center"))


def leaf_stats(s, d):
    return I.leaf_stats(as_leaves(s, d)).select("leaf", F.col("n").cast("long").alias("n"), F.round("radius", 8).alias("radius"))


def outlier_scores(s, d):
    return I.outlier_scores(assigned(s, d), stats(s, d), "x").select("vec_id", "label", F.round("score", 7).alias("score"))


def top_outliers(s, d):
    return I.top_outliers(outlier_scores(s, d), "vec_id", 25).select("vec_id", "score")


def representatives(s, d):
    rows = assigned(s, d).withColumn("d2", F.round("d2", 7))
    return I.representatives(rows, "vec_id", 3).select("label", "vec_id", "rank")


def boundary_points(s, d):
    rows = assigned(s, d).withColumn("d2", F.round("d2", 7))
    return I.representatives(rows, "vec_id", 3, farthest=True).select("label", "vec_id", "rank")


def near_dup_groups(s, d):
    tight = assigned(s, d).withColumnRenamed("label", "leaf")
    got = I.near_duplicate_groups(tight, as_leaves(s, d), "vec_id", 0.995)
    return got.select("leaf", "size", F.element_at("members", 1).alias("first"), F.element_at("members", -1).alias("last"))


def near_dup_pairs(s, d):
    got = I.near_duplicate_pairs(assigned(s, d).withColumnRenamed("label", "leaf"), "vec_id", "x", 0.35)
    return got.select("leaf", "a", "b", F.round("cosine", 7).alias("cosine"))


def soft_assign(s, d):
    return I.soft_assignment(emb(s, d).drop("label"), stats(s, d), "vec_id", "x").select("vec_id", "label", F.round("probability", 7).alias("probability"))


def confidence(s, d):
    return I.confidence(I.soft_assignment(emb(s, d).drop("label"), stats(s, d), "vec_id", "x"), "vec_id").select("vec_id", F.round("confidence", 7).alias("confidence"))


def active_batch(s, d):
    return I.active_batch(confidence(s, d), "vec_id", 20)


def coreset(s, d):
    f = I.leaf_stats(as_leaves(s, d))
    return f.select("leaf", F.col("n").cast("long").alias("weight"), F.round("radius", 8).alias("radius"), F.round(V.norm(F.col("mean")), 8).alias("norm"))


def cluster_neighbours(s, d):
    return I.neighbours(stats(s, d)).select("label", "other", F.round("distance", 7).alias("distance"), "rank")


def drift_compare(s, d):
    rows = emb(s, d)
    half = lambda k: I.cluster_stats(C.diagonal(rows.where(F.col("vec_id") % 2 == k), ["label"], "x"))
    got = I.compare_snapshots(half(0), half(1))
    return got.select("label", "was", *[F.round(c, 6).alias(c) for c in ("shift", "relative_shift", "mass_ratio")])


def radius_percentiles(s, d):
    f = I.leaf_stats(as_leaves(s, d))
    p = lambda q, name: F.round(F.percentile("radius", F.lit(q)), 8).alias(name)
    return f.agg(F.count("*").alias("n"), p(0.5, "p50"), p(0.9, "p90"), p(0.99, "p99"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"))


def summary(s, d):
    f = as_leaves(s, d)
    return f.agg(F.sum("n").cast("long").alias("n_samples"), F.count("*").alias("n_leaves"), F.countDistinct("leaf").alias("n_clusters"))


def lloyd_step(s, d):
    """One step from fixed seeds (the vectors 0..7): new centres and inertia, long form."""
    seeds = emb(s, d).where("vec_id < 8").select(F.col("vec_id").alias("cid"), F.col("x").alias("mean"))
    got = I.nearest_center(emb(s, d), seeds, ["vec_id"], "x")
    f = C.diagonal_long(emb(s, d).drop("label").join(got, "vec_id"), ["cid"], "x")
    return f.groupBy("cid").agg(F.max("n").cast("long").alias("n"), F.round(F.sum(F.col("mean") * (F.col("j") + 1)), 7).alias("moment"), F.round(F.sum("s"), 7).alias("s"))


def xmeans_bic(s, d):
    """The X-means score of the clustering by label."""
    rows = C.spherical(emb(s, d), ["label"], "x")
    dim = 64
    tot = rows.agg(F.sum("n").alias("n"), F.sum("s").alias("sse"), F.count("*").alias("k"))
    var = F.greatest(F.col("sse") / F.greatest(F.col("n") - F.col("k"), F.lit(1.0)) / dim, F.lit(1e-12))
    part = F.col("nk") * F.log("nk") - F.col("nk") * F.log("n") - F.col("nk") * dim / 2 * F.log(2 * F.pi() * var) - (F.col("nk") - 1) * dim / 2
    ll = rows.select(F.col("n").alias("nk")).crossJoin(F.broadcast(tot)).groupBy("n", "k").agg(F.sum(part).alias("ll"))
    return ll.select("k", F.round(F.col("ll") - F.col("k") * (dim + 1) / 2 * F.log("n"), 3).alias("score"))


def _resp(s, d) -> DataFrame:
    """E-step of a diagonal mixture whose components are the first four labels' features; points are (x0, x1)."""
    two = emb(s, d).select("vec_id", "label", F.slice("x", 1, 2).alias("x"))
    comp = C.diagonal(two.where("label < 4"), ["label"], "x")
    comp = comp.select(F.col("label").alias("c"), F.col("mean"), C.variance(F.col("n"), F.col("s")).alias("v"))
    met = two.crossJoin(F.broadcast(comp))
    dens = lambda j: F.log(F.col("v")[j]) + (F.col("x")[j] - F.col("mean")[j]) * (F.col("x")[j] - F.col("mean")[j]) / F.col("v")[j]
    met = met.withColumn("lp", F.log(F.lit(0.25)) - 0.5 * (2 * F.log(2 * F.pi()) + dens(0) + dens(1)))
    own = Window.partitionBy("vec_id")
    e = F.exp(F.col("lp") - F.max("lp").over(own))
    return met.withColumn("e", e).withColumn("r", F.col("e") / F.sum("e").over(own)).select("vec_id", "c", "x", "r")


def gmm_e_step(s, d):
    return _resp(s, d).select("vec_id", "c", F.round("r", 8).alias("r"))


def gmm_m_step(s, d):
    r = F.col("r")
    rows = _resp(s, d).select("c", "r", F.posexplode("x").alias("j", "v"))
    m = rows.groupBy("c", "j").agg(F.sum("r").alias("nk"), (F.sum(r * F.col("v")) / F.sum("r")).alias("mean"))
    met = rows.join(F.broadcast(m), ["c", "j"])
    return met.groupBy("c", "j", "nk", "mean").agg(F.sum(r * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("s")).select(
        "c", "j", F.round("nk", 6).alias("nk"), F.round("mean", 7).alias("mean"), F.round("s", 6).alias("s")
    )


def core_distance(s, d):
    rows = sorted(as_leaves(s, d).select("leaf", "mean").collect())  # label features
    core = core_distances(np.array([r["mean"] for r in rows]), 3)
    return s.createDataFrame([(r["leaf"], round(float(x), 8)) for r, x in zip(rows, core, strict=True)], "leaf long, core double")


def _mutual(s, d):
    core = core_distance(s, d)
    near = T.pairs(as_leaves(s, d)).where("a < b")
    met = near.join(F.broadcast(core.select(F.col("leaf").alias("a"), F.col("core").alias("ca"))), "a").join(F.broadcast(core.select(F.col("leaf").alias("b"), F.col("core").alias("cb"))), "b")
    return met.select("a", "b", F.round(F.greatest("d", "ca", "cb"), 8).alias("m"))


def mutual_reachability(s, d):
    return _mutual(s, d)


def mapper_lens(s, d, lens):
    got = T.lens_values(as_leaves(s, d), lens, density_k=3)
    return got.select("leaf", F.round("lens", 7).alias("lens"))


def _covered(s, d):
    return T.cover(T.lens_values(as_leaves(s, d), "coordinate"), 4, 0.5)


def mapper_cover(s, d):
    return _covered(s, d).select("leaf", "bin")


def _linked(s, d):
    return T.link(_covered(s, d), 1.5)


def mapper_nodes(s, d):
    return T.nodes(_linked(s, d)).select("node", "bin", F.col("comp").cast("long").alias("comp"), F.col("mass").cast("long").alias("mass"), F.round("lens", 8).alias("lens"))


def mapper_edges(s, d):
    linked = _linked(s, d)
    return T.nerve(linked, T.nodes(linked)).select("a", "b", "shared")


def must_link_components(s, d):
    """Must-links between a customer and the next one of its nation with the same segment, closed transitively."""
    c = table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    ties = c.withColumn("b", F.lead("c_custkey").over(w)).where("b is not null").select(F.col("c_custkey").alias("a"), "b")
    return connected_components(ties)


def constraint_translate(s, d):
    """Row constraints to leaf constraints: (0, 1), (2, 3), ... between neighbours of the vector table."""
    rows = I.nearest_center(emb(s, d), centers(s, d), ["vec_id"], "x").select("vec_id", "cid")
    ask = rows.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id_a"), (F.col("vec_id") + 1).alias("id_b"))
    met = ask.join(rows.select(F.col("vec_id").alias("id_a"), F.col("cid").alias("leaf_a")), "id_a").join(rows.select(F.col("vec_id").alias("id_b"), F.col("cid").alias("leaf_b")), "id_b")
    return met.groupBy("leaf_a", "leaf_b").agg(F.count("*").alias("pairs"))


def ari(s, d):
    rows = assigned(s, d).select("vec_id", F.col("label").alias("found")).join(emb(s, d).select("vec_id", "label"), "vec_id")
    return I.adjusted_rand(rows, "found", "label").select(F.round("ari", 9).alias("ari"))


def label_distinct(s, d):
    return assigned(s, d).agg(F.countDistinct("label").alias("n_clusters"))


VECTORS = {
    "cf_diagonal": cf_diagonal, "cf_spherical": cf_spherical, "cf_decay": cf_decay, "cf_merge_equals_global": cf_merge_equals_global,
    "l2_normalize": l2_normalize, "winsorize": winsorize, "ingest_checks": ingest_checks, "vector_kernels": kernels,
    "dist_d0": lambda s, d: _pairs(s, d, C.d0), "dist_d1": lambda s, d: _pairs(s, d, C.d1), "dist_d2": lambda s, d: _pairs(s, d, C.d2),
    "dist_ward": lambda s, d: _pairs(s, d, C.ward), "dist_radius": lambda s, d: _pairs(s, d, C.radius_sq), "dist_chi2": dist_chi2,
    "assign_nearest": assign_nearest, "cluster_stats": cluster_stats, "leaf_stats": leaf_stats, "outlier_scores": outlier_scores,
    "top_outliers": top_outliers, "representatives": representatives, "boundary_points": boundary_points, "near_dup_groups": near_dup_groups,
    "near_dup_pairs": near_dup_pairs, "soft_assign": soft_assign, "confidence": confidence, "active_batch": active_batch, "coreset": coreset,
    "cluster_neighbours": cluster_neighbours, "drift_compare": drift_compare, "radius_percentiles": radius_percentiles, "summary": summary,
    "lloyd_step": lloyd_step, "xmeans_bic": xmeans_bic, "gmm_e_step": gmm_e_step, "gmm_m_step": gmm_m_step, "core_distance": core_distance,
    "mutual_reachability": mutual_reachability, "mapper_lens_density": lambda s, d: mapper_lens(s, d, "density"),
    "mapper_lens_radius": lambda s, d: mapper_lens(s, d, "radius"), "mapper_lens_norm": lambda s, d: mapper_lens(s, d, "norm"),
    "mapper_lens_coordinate": lambda s, d: mapper_lens(s, d, "coordinate"), "mapper_lens_eccentricity": lambda s, d: mapper_lens(s, d, "eccentricity"),
    "mapper_cover": mapper_cover, "mapper_nodes": mapper_nodes, "mapper_edges": mapper_edges, "must_link_components": must_link_components,
    "constraint_translate": constraint_translate, "ari": ari, "label_distinct": label_distinct,
}

_E = "e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_CF = _E + ", cf AS (SELECT label, j, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS s FROM e GROUP BY label, j)"
_R = _CF + ", st AS (SELECT label, max(n) AS n, sum(s) AS s, sqrt(sum(s) / max(n)) AS radius FROM cf GROUP BY label)"
_D = _R + ", dd AS (SELECT e.vec_id, cf.label AS cid, sum((e.x - cf.m) * (e.x - cf.m)) AS d2 FROM e JOIN cf USING (j) GROUP BY e.vec_id, cf.label)"
_A = _D + ", a AS (SELECT vec_id, arg_min(cid, (round(d2, 9), cid)) AS cid, arg_min(d2, (round(d2, 9), cid)) AS d2 FROM dd GROUP BY vec_id)"
_P = _R + (
    ", p AS (SELECT x.label AS a, y.label AS b, sum((x.m - y.m) * (x.m - y.m)) AS sq, sum(abs(x.m - y.m)) AS l1 FROM cf x JOIN cf y USING (j) WHERE x.label <> y.label GROUP BY 1, 2)"
    ", q AS (SELECT p.*, s.n AS na, s.s AS sa, t.n AS nb, t.s AS sb FROM p JOIN st s ON s.label = a JOIN st t ON t.label = b)"
)
_CORE = _P + ", c AS (SELECT a AS leaf, round(sqrt(sq), 8) AS core FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sqrt(sq), 8), b) = 3)"
_SOFT = _D + (
    ", t AS (SELECT greatest(avg(radius), 1e-12) AS tau FROM st), z AS (SELECT vec_id, cid AS label, -d2 / (2 * tau * tau) AS z FROM dd, t)"
    ", w AS (SELECT vec_id, label, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z), so AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS probability FROM w)"
)
_GMM = _E + (
    ", g AS (SELECT label AS c, j, avg(x) AS m, var_pop(x) AS v FROM e WHERE j < 2 AND label < 4 GROUP BY 1, 2)"
    ", l AS (SELECT vec_id, c, ln(0.25) - 0.5 * (2 * ln(2 * pi()) + sum(ln(v) + (x - m) * (x - m) / v)) AS lp FROM e JOIN g USING (j) GROUP BY 1, 2)"
    ", w AS (SELECT vec_id, c, exp(lp - max(lp) OVER (PARTITION BY vec_id)) AS e FROM l), r AS (SELECT vec_id, c, e / sum(e) OVER (PARTITION BY vec_id) AS r FROM w)"
)
_COVER = _CF + (
    ", lens AS (SELECT label AS leaf, m AS v FROM cf WHERE j = 0), k AS (SELECT min(v) AS lo, CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) / 4 ELSE 1.0 END AS step FROM lens)"
    ", cov AS (SELECT leaf, v, CAST(bin AS INTEGER) AS bin FROM lens, k, range(4) b(bin) WHERE v >= lo + bin * step - 0.25 * step AND v <= lo + (bin + 1) * step + 0.25 * step)"
)
_LINK = _COVER.replace("WITH ", "") + (
    ", pd AS (SELECT x.label AS a, y.label AS b, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS d FROM cf x JOIN cf y USING (j) WHERE x.label <> y.label GROUP BY 1, 2)"
    ", bd AS (SELECT u.bin, a, b, d FROM pd JOIN cov u ON u.leaf = a JOIN cov w ON w.leaf = b AND w.bin = u.bin)"
    ", ga AS (SELECT bin, a, min(d) AS g FROM bd GROUP BY 1, 2), li AS (SELECT bin, list_sort(list(g))[CAST(floor(count(*) / 2) AS INTEGER) + 1] * 1.5 AS lim FROM ga GROUP BY bin)"
    ", ed AS (SELECT bd.bin, a, b FROM bd JOIN li USING (bin) WHERE d <= lim)"
    ", reach AS (SELECT bin, leaf AS x, leaf AS y FROM cov UNION SELECT r.bin, r.x, ed.b FROM reach r JOIN ed ON ed.bin = r.bin AND ed.a = r.y)"
    ", comp AS (SELECT bin, x AS leaf, min(y) AS comp FROM reach GROUP BY 1, 2)"
    ", nod AS (SELECT bin, comp, sum(n) AS mass, avg(v) AS lens, row_number() OVER (ORDER BY bin, comp) - 1 AS node FROM comp JOIN cov USING (bin, leaf) JOIN (SELECT label AS leaf, max(n) AS n FROM cf GROUP BY 1) USING (leaf) GROUP BY bin, comp)"
)


def _dist(expr: str) -> str:
    return f"WITH {_P} SELECT a, b, round({expr}, 7) AS d FROM q WHERE a < b"


VECTORS_SQL = {
    "cf_diagonal": f"WITH {_CF} SELECT label, j, n, round(m, 9) AS mean, round(s, 9) AS s FROM cf",
    "cf_spherical": f"WITH {_R} SELECT label, n, round(s, 8) AS s, round(s / n / 64, 9) AS variance FROM st",
    "cf_decay": f"WITH {_R} SELECT label, CAST(n AS DOUBLE) * 0.5 AS n, round(s * 0.5, 8) AS s, round(s / n, 8) AS variance FROM st",
    "cf_merge_equals_global": f"WITH {_E} SELECT count(*) AS n, j, round(var_pop(x) * count(*), 7) AS s FROM e GROUP BY j",
    "l2_normalize": f"WITH {_E}, y AS (SELECT vec_id, j, x * 3 + 0.1 AS x FROM e) SELECT vec_id, round(sum(x * (j + 1)) / sqrt(sum(x * x)), 8) AS moment FROM y GROUP BY vec_id",
    "winsorize": f"WITH {_E}, g AS (SELECT j, avg(x) AS m, sqrt(var_pop(x)) AS sd FROM e GROUP BY j) SELECT vec_id, round(sum(CASE WHEN sd > 0 THEN greatest(least(x, m + sd), m - sd) ELSE x END), 8) AS total FROM e JOIN g USING (j) GROUP BY vec_id",
    "ingest_checks": f"WITH {_E}, v AS (SELECT vec_id, CAST(count(*) AS INTEGER) AS dim, round(sqrt(sum(x * x)), 6) AS norm FROM e GROUP BY vec_id) SELECT DISTINCT count(*) OVER () AS n, dim, norm FROM v",
    "vector_kernels": f"WITH {_E} SELECT a.vec_id, b.vec_id AS other, round(sum((a.x - b.x) * (a.x - b.x)), 8) AS sq, round(sum(a.x * b.x), 8) AS dot, round(sum(abs(a.x - b.x)), 8) AS l1 FROM e a JOIN e b USING (j) WHERE b.vec_id < 3 GROUP BY 1, 2",
    "dist_d0": _dist("sq"), "dist_d1": _dist("l1"), "dist_d2": _dist("sq + sa / na + sb / nb"), "dist_ward": _dist("na * nb / (na + nb) * sq"),
    "dist_radius": _dist("(sa + sb + na * nb / (na + nb) * sq) / (na + nb)"),
    "dist_chi2": f"WITH {_CF} SELECT cf.label, round(sum((x - m) * (x - m) / ((s + 66 * {CHI2_PRIOR}) / (n + 66))), 4) AS total FROM e JOIN cf USING (j) GROUP BY cf.label",
    "assign_nearest": f"WITH {_A} SELECT vec_id, cid, round(d2, 7) AS d2 FROM a",
    "cluster_stats": f"WITH {_R}, ct AS (SELECT label, sum(m) AS center FROM cf GROUP BY label) SELECT label, n AS size, round(radius, 8) AS radius, round(center, 8) AS center FROM st JOIN ct USING (label)",
    "leaf_stats": f"WITH {_R} SELECT label AS leaf, n, round(radius, 8) AS radius FROM st",
    "outlier_scores": f"WITH {_A} SELECT vec_id, cid AS label, round(sqrt(d2) / radius, 7) AS score FROM a JOIN st ON st.label = cid",
    "top_outliers": f"WITH {_A} SELECT vec_id, round(sqrt(d2) / radius, 7) AS score FROM a JOIN st ON st.label = cid ORDER BY score DESC, vec_id LIMIT 25",
    "representatives": f"WITH {_A} SELECT cid AS label, vec_id, CAST(row_number() OVER (PARTITION BY cid ORDER BY round(d2, 7), vec_id) AS INTEGER) AS rank FROM a QUALIFY rank <= 3",
    "boundary_points": f"WITH {_A} SELECT cid AS label, vec_id, CAST(row_number() OVER (PARTITION BY cid ORDER BY round(d2, 7) DESC, vec_id) AS INTEGER) AS rank FROM a QUALIFY rank <= 3",
    "near_dup_groups": f"WITH {_A} SELECT cid AS leaf, count(*) AS size, min(vec_id) AS first, max(vec_id) AS last FROM a JOIN st ON st.label = cid WHERE radius < 0.995 GROUP BY cid HAVING count(*) >= 2",
    "near_dup_pairs": f"WITH {_A}, u AS (SELECT vec_id, j, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM e), p AS (SELECT a.cid AS leaf, a.vec_id AS a, b.vec_id AS b FROM a JOIN a b ON a.cid = b.cid AND a.vec_id < b.vec_id), c AS (SELECT leaf, a, b, sum(u.x * w.x) AS cosine FROM p JOIN u ON u.vec_id = a JOIN u w ON w.vec_id = b AND w.j = u.j GROUP BY 1, 2, 3) SELECT leaf, a, b, round(cosine, 7) AS cosine FROM c WHERE cosine >= 0.35",
    "soft_assign": f"WITH {_SOFT} SELECT vec_id, label, round(probability, 7) AS probability FROM so",
    "confidence": f"WITH {_SOFT} SELECT vec_id, round(max(probability), 7) AS confidence FROM so GROUP BY vec_id",
    "active_batch": f"WITH {_SOFT}, c AS (SELECT vec_id, round(max(probability), 7) AS confidence FROM so GROUP BY vec_id) SELECT * FROM c ORDER BY confidence, vec_id LIMIT 20",
    "coreset": f"WITH {_R}, nm AS (SELECT label, sqrt(sum(m * m)) AS norm FROM cf GROUP BY label) SELECT label AS leaf, n AS weight, round(radius, 8) AS radius, round(norm, 8) AS norm FROM st JOIN nm USING (label)",
    "cluster_neighbours": f"WITH {_P} SELECT a AS label, b AS other, round(sqrt(sq), 7) AS distance, CAST(row_number() OVER (PARTITION BY a ORDER BY round(sqrt(sq), 9), b) AS INTEGER) AS rank FROM p QUALIFY rank <= 3",
    "drift_compare": f"WITH {_E}, h AS (SELECT label, vec_id % 2 AS k, j, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS s FROM e GROUP BY 1, 2, 3), z AS (SELECT label, k, max(n) AS n, sqrt(sum(s) / max(n)) AS radius FROM h GROUP BY 1, 2), p AS (SELECT y.label, x.label AS was, sqrt(sum((x.m - y.m) * (x.m - y.m))) AS shift FROM h x JOIN h y ON x.j = y.j AND x.k = 0 AND y.k = 1 GROUP BY 1, 2), b AS (SELECT label, arg_min(was, (round(shift, 9), was)) AS was, min(shift) AS shift FROM p GROUP BY label) SELECT b.label, was, round(shift, 6) AS shift, round(shift / CASE WHEN z1.radius > 0 THEN z1.radius ELSE 1 END, 6) AS relative_shift, round(z1.n / z0.n, 6) AS mass_ratio FROM b JOIN z z1 ON z1.label = b.label AND z1.k = 1 JOIN z z0 ON z0.label = was AND z0.k = 0",
    "radius_percentiles": f"WITH {_R} SELECT count(*) AS n, round(quantile_cont(radius, 0.5), 8) AS p50, round(quantile_cont(radius, 0.9), 8) AS p90, round(quantile_cont(radius, 0.99), 8) AS p99, min(n) AS least, max(n) AS most FROM st",
    "summary": f"WITH {_R} SELECT CAST(sum(n) AS BIGINT) AS n_samples, count(*) AS n_leaves, count(DISTINCT label) AS n_clusters FROM st",
    "lloyd_step": f"WITH {_E}, dd AS (SELECT a.vec_id, b.vec_id AS cid, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM e a JOIN e b USING (j) WHERE b.vec_id < 8 GROUP BY 1, 2), a AS (SELECT vec_id, arg_min(cid, (round(d2, 9), cid)) AS cid FROM dd GROUP BY vec_id), g AS (SELECT cid, j, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS s FROM e JOIN a USING (vec_id) GROUP BY 1, 2) SELECT cid, max(n) AS n, round(sum(m * (j + 1)), 7) AS moment, round(sum(s), 7) AS s FROM g GROUP BY cid",
    "xmeans_bic": f"WITH {_R}, t AS (SELECT sum(n) AS n, sum(s) AS sse, count(*) AS k FROM st), v AS (SELECT t.*, greatest(sse / greatest(n - k, 1.0) / 64, 1e-12) AS var FROM t), l AS (SELECT sum(st.n * ln(st.n) - st.n * ln(v.n) - st.n * 64 / 2 * ln(2 * pi() * var) - (st.n - 1) * 64 / 2) AS ll FROM st, v) SELECT k, round(ll - k * 65 / 2 * ln(n), 3) AS score FROM l, v",
    "gmm_e_step": f"WITH {_GMM} SELECT vec_id, c, round(r, 8) AS r FROM r",
    "gmm_m_step": f"WITH {_GMM}, k AS (SELECT c, j, r, x FROM r JOIN e USING (vec_id) WHERE j < 2), m AS (SELECT c, j, sum(r) AS nk, sum(r * x) / sum(r) AS mean FROM k GROUP BY 1, 2) SELECT c, j, round(nk, 6) AS nk, round(mean, 7) AS mean, round(sum(r * (x - mean) * (x - mean)), 6) AS s FROM k JOIN m USING (c, j) GROUP BY c, j, nk, mean",
    "core_distance": f"WITH {_CORE} SELECT leaf, core FROM c",
    "mutual_reachability": f"WITH {_CORE} SELECT a, b, round(greatest(sqrt(sq), x.core, y.core), 8) AS m FROM p JOIN c x ON x.leaf = a JOIN c y ON y.leaf = b WHERE a < b",
    "mapper_lens_density": f"WITH {_P}, k AS (SELECT a, sqrt(sq) AS d FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY sq, b) <= 3) SELECT a AS leaf, round(1 / avg(d), 7) AS lens FROM k GROUP BY a",
    "mapper_lens_radius": f"WITH {_R} SELECT label AS leaf, round(radius, 7) AS lens FROM st",
    "mapper_lens_norm": f"WITH {_CF} SELECT label AS leaf, round(sqrt(sum(m * m)), 7) AS lens FROM cf GROUP BY label",
    "mapper_lens_coordinate": f"WITH {_CF} SELECT label AS leaf, round(m, 7) AS lens FROM cf WHERE j = 0",
    "mapper_lens_eccentricity": f"WITH {_P} SELECT a AS leaf, round(avg(sqrt(sq)), 7) AS lens FROM p GROUP BY a",
    "mapper_cover": f"WITH {_COVER} SELECT leaf, bin FROM cov",
    "mapper_nodes": f"WITH RECURSIVE {_LINK} SELECT CAST(node AS INTEGER) AS node, bin, comp, CAST(mass AS BIGINT) AS mass, round(lens, 8) AS lens FROM nod",
    "mapper_edges": f"WITH RECURSIVE {_LINK}, mem AS (SELECT leaf, CAST(node AS INTEGER) AS node FROM comp JOIN nod USING (bin, comp)) SELECT x.node AS a, y.node AS b, count(*) AS shared FROM mem x JOIN mem y ON x.leaf = y.leaf AND x.node < y.node GROUP BY 1, 2",
    "must_link_components": "SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) > 1",
    "constraint_translate": f"WITH {_A} SELECT x.cid AS leaf_a, y.cid AS leaf_b, count(*) AS pairs FROM a x JOIN a y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0 GROUP BY 1, 2",
    "ari": f"WITH {_A}, l AS (SELECT DISTINCT vec_id, label FROM e), t AS (SELECT cid, label, CAST(count(*) AS DOUBLE) AS n FROM a JOIN l USING (vec_id) GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY cid)), y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) AS tot FROM t), q AS (SELECT x.v * y.v / (tot * (tot - 1) / 2) AS ex, (x.v + y.v) / 2 AS mo, b.v AS bo FROM x, y, b) SELECT round(CASE WHEN mo = ex THEN 1.0 ELSE (bo - ex) / (mo - ex) END, 9) AS ari FROM q",
    "label_distinct": f"WITH {_A} SELECT count(DISTINCT cid) AS n_clusters FROM a",
}

"""Queries that run the shipped kernels on small summaries, each with an SQL twin."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions.sketches import kll, kll_quantile
from ..operators import cf as C
from ..operators import inspection as I
from ..operators import prepare as P
from ..operators.kernels import core_distances, spanning_tree
from ..operators.summarize import matrix
from ..session import ship
from ..streaming.evolving import DenStream
from .vector_queries import _A, _CORE, _E, _R, as_leaves, emb, table

BUDGETS = [(feature, mb, dim) for feature in ("spherical", "diagonal", "full") for mb in (0.01, 1.0, 64.0) for dim in (2, 64)]
STREAMS = [(decay, beta, mu) for decay in (0.001, 0.05, 0.25) for beta in (0.2, 0.5) for mu in (6.0, 10.0)]
DIVERSE = 4


def mst_weight(s, d):
    """Total weight of the spanning tree of mutual reachability over label features."""
    mean = np.array([r["mean"] for r in as_leaves(s, d).orderBy("leaf").collect()])
    edges = spanning_tree(mean, core_distances(mean, 3))
    return s.createDataFrame([(len(edges), round(sum(e[0] for e in edges), 6))], "edges int, weight double")


def kll_ends(s, d):
    """Counts and exact ends of sketches by event type."""
    got = kll(table(s, d, "events"), "value", 64, ["event_type"])
    return got.select("event_type", "n", "lo", "hi", kll_quantile(0.0).alias("first"), kll_quantile(1.0).alias("last"))


def _split(s, d):
    x = F.array((F.col("c_acctbal") / 10).cast("double"), F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 7).cast("double"))
    return P.split_mixed(table(s, d, "customer").select("c_custkey", x.alias("x")), "x", [1, 2], 3)


def mixed_split(s, d):
    return _split(s, d).select("c_custkey", F.round(F.col("num")[0], 6).alias("num"), F.col("cat")[0].alias("nation"), F.col("cat")[1].alias("code"))


def mixed_cardinalities(s, d):
    return s.createDataFrame([(j, int(m)) for j, m in enumerate(P.cardinalities(_split(s, d)))], "j int, m int")


def budget_leaves(s, d):
    rows = [(f, mb, dim, P.budget_max_leaves(mb, dim, f, 32)) for f, mb, dim in BUDGETS]
    return s.createDataFrame(rows, "feature string, mb double, dim int, leaves long")


def stream_periods(s, d):
    rows = [(a, b, m, DenStream(1.0, a, b, m).period) for a, b, m in STREAMS]
    return s.createDataFrame(rows, "decay double, beta double, mu double, period int")


def covariance_logdet(s, d):
    """Log-determinant of each return flag's covariance, by its Cholesky factor."""
    cells = C.full_long(table(s, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"]).select("l_returnflag", "i", "j", (F.col("scatter") / F.col("n")).alias("v")).collect()
    out = []
    for flag in sorted({r["l_returnflag"] for r in cells}):
        cov = np.zeros((3, 3))
        for r in cells:
            if r["l_returnflag"] == flag:
                cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["v"]
        out.append((flag, round(linalg.logdet(linalg.cholesky_lower(cov)), 6)))
    return s.createDataFrame(out, "l_returnflag string, logdet double")


def moments_cf(s, d):
    """Features built from moments that are at hand."""
    rows = table(s, d, "events").where("value is not null and not isnan(value)").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    f = rows.select("event_type", C.from_moments(F.col("n"), F.array("m"), F.array(F.col("v") * F.col("n"))).alias("f"))
    return f.select("event_type", F.col("f.n").alias("n"), F.round(F.col("f.mean")[0], 8).alias("mean"), F.round(C.variance(F.col("f.n"), F.col("f.s"))[0], 6).alias("variance"))


def diverse(s, d):
    """Vectors taken farthest first."""
    got = I.farthest_first(emb(s, d), "vec_id", "x", DIVERSE)
    return s.createDataFrame([(k, int(v)) for k, v in enumerate(got)], "rank int, vec_id long")


def _label_stream(s, d) -> DenStream:
    """An evolving stream whose potential micro-clusters are the label features, a hundred ticks after their last point."""
    rows = as_leaves(s, d).orderBy("leaf").collect()
    micros = [[float(r["n"]), list(r["mean"]), float(sum(r["s"])), 0.0, 0.0, k] for k, r in enumerate(rows)]
    return DenStream(0.99, 0.01, 0.5, 10.0).load(json.dumps([100.0, micros, []]))


def denstream_predict(s, d):
    stream = _label_stream(s, d)
    rows = emb(s, d).select("vec_id", "x")
    ship()

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column("vec_id"), pa.array(stream.predict(matrix(b.column("x"))).astype(np.int64))], ["vec_id", "cluster"])

    return rows.mapInArrow(run, "vec_id long, cluster long")


def denstream_stats(s, d):
    got = _label_stream(s, d).stats()
    return s.createDataFrame([(k, round(g["weight"], 6), round(g["radius"], 8)) for k, g in enumerate(got)], "leaf long, weight double, radius double")


def _diverse_sql() -> str:
    out = f"WITH {_E}, t0 AS (SELECT min(vec_id) AS vec_id FROM e), g0 AS (SELECT e.vec_id, sum((e.x - y.x) * (e.x - y.x)) AS gap FROM e JOIN e y USING (j) JOIN t0 ON y.vec_id = t0.vec_id GROUP BY 1)"
    for k in range(1, DIVERSE):
        taken = " UNION ALL ".join(f"SELECT vec_id FROM t{i}" for i in range(k))
        out += f", t{k} AS (SELECT vec_id FROM g{k - 1} WHERE vec_id NOT IN ({taken}) ORDER BY round(gap, 9) DESC, vec_id LIMIT 1)"
        out += f", n{k} AS (SELECT e.vec_id, sum((e.x - y.x) * (e.x - y.x)) AS gap FROM e JOIN e y USING (j) JOIN t{k} ON y.vec_id = t{k}.vec_id GROUP BY 1)"
        out += f", g{k} AS (SELECT vec_id, least(g{k - 1}.gap, n{k}.gap) AS gap FROM g{k - 1} JOIN n{k} USING (vec_id))"
    return out + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS rank, vec_id FROM t{k}" for k in range(DIVERSE))


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + f") AS t({names})"


KERNELS = {
    "mst_weight": mst_weight, "kll_ends": kll_ends, "mixed_split": mixed_split, "mixed_cardinalities": mixed_cardinalities, "budget_leaves": budget_leaves,
    "stream_periods": stream_periods, "covariance_logdet": covariance_logdet, "moments_cf": moments_cf, "diverse_vectors": diverse,
    "denstream_predict": denstream_predict, "denstream_stats": denstream_stats,
}

KERNELS_SQL = {
    # an edge belongs to the tree if the lighter edges don't join its ends
    "mst_weight": f"WITH RECURSIVE {_CORE}, w AS (SELECT a, b, greatest(sqrt(sq), x.core, y.core) AS m FROM p JOIN c x ON x.leaf = a JOIN c y ON y.leaf = b WHERE a < b), r AS (SELECT *, row_number() OVER (ORDER BY m, a, b) AS r FROM w), k AS (SELECT r, a AS x, b AS y FROM r UNION ALL SELECT r, b, a FROM r), reach AS (SELECT r, a AS node FROM r UNION SELECT reach.r, k.y FROM reach JOIN k ON k.x = reach.node AND k.r < reach.r) SELECT CAST(count(*) AS INTEGER) AS edges, round(sum(m), 6) AS weight FROM r WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.r = r.r AND reach.node = r.b)",
    "kll_ends": "SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, min(value) AS first, max(value) AS last FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type",
    "mixed_split": "SELECT c_custkey, round(c_acctbal / 10, 6) AS num, CAST(c_nationkey AS INTEGER) AS nation, CAST(c_custkey % 7 AS INTEGER) AS code FROM customer",
    "mixed_cardinalities": "SELECT CAST(0 AS INTEGER) AS j, CAST(max(c_nationkey) + 1 AS INTEGER) AS m FROM customer UNION ALL SELECT 1, CAST(max(c_custkey % 7) + 1 AS INTEGER) FROM customer",
    "budget_leaves": f"SELECT feature, mb, CAST(dim AS INTEGER) AS dim, greatest(33, least(CAST(floor(mb * 1048576 / (96 + CASE feature WHEN 'spherical' THEN 8 * dim + 16 WHEN 'diagonal' THEN 16 * dim + 16 ELSE 8 * dim + 4 * dim * (dim + 1) END)) AS BIGINT), 10000000)) AS leaves FROM {_values(BUDGETS, 'feature, mb, dim')}",
    "stream_periods": f"SELECT decay, beta, mu, CAST(greatest(1, ceil(log2(beta * mu / (beta * mu - 1)) / decay)) AS INTEGER) AS period FROM {_values(STREAMS, 'decay, beta, mu')}",
    "covariance_logdet": "WITH v AS (SELECT l_returnflag, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_quantity, l_tax) AS c, var_pop(l_discount) AS d, covar_pop(l_discount, l_tax) AS e, var_pop(l_tax) AS f FROM lineitem GROUP BY 1) SELECT l_returnflag, round(ln(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)), 6) AS logdet FROM v",
    "moments_cf": "SELECT event_type, count(*) AS n, round(avg(value), 8) AS mean, round(var_pop(value), 6) AS variance FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type",
    "diverse_vectors": _diverse_sql(),
    # the features lie within 2 eps of each other and weigh enough together, so they are one cluster
    "denstream_predict": f"WITH {_A} SELECT vec_id, CAST(CASE WHEN d2 <= 0.99 * 0.99 THEN 0 ELSE -1 END AS BIGINT) AS cluster FROM a",
    "denstream_stats": f"WITH {_R} SELECT label AS leaf, round(n * 0.5, 6) AS weight, round(radius, 8) AS radius FROM st",
}

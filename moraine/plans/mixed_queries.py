"""Queries over the scalar tables: full and weighted features, sketches, mixed and sparse rows, streams."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.sketches import DDSketch, exact_rank, kll, kll_quantile
from ..operators import cf as C
from ..operators import prepare as P
from ..operators import sparse as S
from ..streaming.evolving import dbstream_offline, denstream_offline, faded_weight
from .vector_queries import table

DD = DDSketch(0.01)
LN = repr(math.log(DD.gamma))
QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def cf_full(s, d):
    f = C.full_long(table(s, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])
    return f.select("l_returnflag", "i", "j", F.col("n").cast("long").alias("n"), F.round(F.col("scatter") / F.col("n"), 8).alias("cov"))


def cf_weighted(s, d):
    rows = table(s, d, "orders").select("o_orderpriority", F.array((F.col("o_totalprice") / 1000).cast("double")).alias("x"), (F.col("o_orderkey") % 3).cast("double").alias("w"))
    f = C.diagonal_long(rows, ["o_orderpriority"], "x", "w")
    return f.select("o_orderpriority", "n", F.round("mean", 6).alias("mean"), F.round(F.col("s") / F.col("n"), 4).alias("variance"))


def grid_micros(s, d):
    """Grid features: rows rounded to cells of 1000 in balance, with the nation as second axis."""
    rows = table(s, d, "customer").select(F.floor(F.col("c_acctbal") / 1000 + 0.5).cast("long").alias("cell"), F.floor(F.col("c_nationkey") / 5 + 0.5).cast("long").alias("band"), F.array((F.col("c_acctbal") / 1000).cast("double")).alias("x"))
    f = C.diagonal_long(rows, ["cell", "band"], "x")
    return f.select("cell", "band", F.col("n").cast("long").alias("n"), F.round("mean", 8).alias("mean"), F.round("s", 7).alias("s"))


def events(s, d):
    return table(s, d, "events").select("event_id", "event_type", "value", "ts")


def dds_buckets(s, d):
    rows = events(s, d).withColumn("value", F.col("value") - 50)
    return DD.buckets(rows, "value").select("sign", "bucket", "cnt")


def dds_quantiles(s, d):
    return DD.quantiles(DD.buckets(events(s, d), "value"), QS).select("q", F.round("value", 6).alias("value"))


def dds_merge(s, d):
    rows = events(s, d)
    half = lambda k: DD.buckets(rows.where(F.col("event_id") % 2 == k), "value")
    return DD.merge(half(0), half(1), DD).select("sign", "bucket", "cnt")


def rank_exact(s, d):
    return exact_rank(events(s, d), "value", 50.0)


def kll_quantiles(s, d):
    got = kll(events(s, d), "value", 400)
    return got.select("n", *[kll_quantile(q).alias(f"q{int(q * 100)}") for q in (0.0, 0.5, 0.9, 1.0)])


def mixed(s, d):
    """Customers: balance in thousands as the numeric part, segment as the categorical one."""
    rows = table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).cast("double").alias("b"), "c_mktsegment", "c_nationkey")
    seg = rows.select("c_mktsegment").distinct().withColumn("code", F.row_number().over(Window.partitionBy().orderBy("c_mktsegment")) - 1)
    return rows.join(F.broadcast(seg), "c_mktsegment").select("c_custkey", F.col("c_nationkey").cast("long").alias("g"), "b", "code")


def mixed_cf(s, d):
    rows = mixed(s, d)
    hist = rows.groupBy("g", "code").agg(F.count("*").alias("cnt"))
    mode = hist.groupBy("g").agg(F.max_by("code", F.struct("cnt", -F.col("code"))).alias("mode"))
    f = rows.groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("b"), 8).alias("mean"), F.round(F.var_pop("b") * F.count("*"), 6).alias("s"))
    return f.join(mode, "g").select("g", "n", "mean", "s", "mode")


def huang_gamma(s, d):
    rows = table(s, d, "customer").select((F.col("c_acctbal") / 1000).cast("double").alias("b"), F.col("c_nationkey").cast("double").alias("k"))
    return s.createDataFrame([(round(P.huang_gamma(rows, ["b", "k"]), 8),)], "gamma double")


def kproto_assign(s, d):
    """Nearest of the nations' prototypes: squared difference + gamma for another mode."""
    rows, proto = mixed(s, d), mixed_cf(s, d)
    table = proto.agg(F.collect_list(F.struct("g", "mean", "mode")).alias("protos")).where(F.size("protos") > 0)  # a row
    dist = lambda p: (F.col("b") - p["mean"]) * (F.col("b") - p["mean"]) + F.when(F.col("code") != p["mode"], 1.5).otherwise(0.0)
    near = F.array_min(F.transform("protos", lambda p: F.struct(F.round(dist(p), 7).alias("d"), p["g"].alias("g"))))
    met = rows.crossJoin(F.broadcast(table)).select("c_custkey", near.alias("m")).repartition("c_custkey")
    return met.groupBy("c_custkey").agg(F.min("m").alias("m")).select("c_custkey", F.col("m.g").alias("g"), F.col("m.d").alias("d"))


def _terms(s, d):
    """Documents as sparse rows: counts of words by their length (1..12 and over)."""
    word = F.explode(F.split(F.trim(F.regexp_replace("text", "[ \t\n\r]+", " ")), " ")).alias("w")
    rows = table(s, d, "documents").select("doc_id", "lang", word).where("w <> ''")
    return rows.groupBy("doc_id", "lang", F.least(F.length("w"), F.lit(13)).alias("j")).agg(F.count("*").cast("double").alias("x"))


def sparse_cf(s, d):
    return S.sparse_cf(_terms(s, d).withColumn("x", F.log1p("x")), "lang", "doc_id").select("lang", F.col("n").cast("long").alias("n"), F.round("s", 5).alias("s"))


def sparse_assign(s, d):
    rows = _terms(s, d).withColumn("x", F.log1p("x"))
    n = rows.groupBy("lang").agg(F.countDistinct("doc_id").alias("n"))
    centers = rows.groupBy("lang", "j").agg(F.sum("x").alias("x")).join(n, "lang").select(F.col("lang").alias("cid"), "j", (F.col("x") / F.col("n")).alias("c"))
    return S.nearest_sparse(rows, "doc_id", centers).select("doc_id", "cid", F.round("d2", 6).alias("d2"))


def faded(s, d):
    return faded_weight(events(s, d), ["event_type"], "event_id", 10_000, 0.001).select("event_type", F.round("weight", 6).alias("weight"))


def _micro(s, d, few: bool = True):
    """Customers as micro-clusters: all, or the first 300, which the recursive twins can do."""
    rows = table(s, d, "customer").where("c_custkey <= 300" if few else "true").select(F.col("c_custkey").alias("id"), F.array((F.col("c_acctbal") / 1000).cast("double"), F.col("c_nationkey").cast("double")).alias("mean"))
    return rows.withColumn("n", (F.col("id") % 4 + 1).cast("double"))


def denstream(s, d):
    return denstream_offline(_micro(s, d), 0.6, 10.0).select("id", F.col("component").cast("long").alias("component"), "weight")


def dbstream(s, d):
    m = _micro(s, d).select("id", "n")
    shared = m.select(F.col("id").alias("a"), (F.col("id") * 7 % 300 + 1).alias("b"), (F.col("id") % 5 * 0.1).alias("v")).where("a <> b")
    return dbstream_offline(m, shared, 0.1, 2.0)


def denstream_all(s, d):
    return denstream_offline(_micro(s, d, few=False), 0.6, 10.0).select("id", F.col("component").cast("long").alias("component"), "weight")


def dbstream_all(s, d):
    m = _micro(s, d, few=False).select("id", "n")
    last = F.broadcast(m.agg(F.max("id").alias("last")))
    shared = m.crossJoin(last).select(F.col("id").alias("a"), (F.col("id") * 7 % F.col("last") + 1).alias("b"), (F.col("id") % 5 * 0.1).alias("v")).where("a <> b")
    return dbstream_offline(m, shared, 0.1, 2.0)


MIXED = {
    "cf_full": cf_full, "cf_weighted": cf_weighted, "grid_micros": grid_micros, "dds_buckets": dds_buckets, "dds_quantiles": dds_quantiles,
    "dds_merge": dds_merge, "exact_rank": rank_exact, "kll_quantiles": kll_quantiles, "mixed_cf": mixed_cf, "huang_gamma": huang_gamma,
    "kproto_assign": kproto_assign, "sparse_cf": sparse_cf, "sparse_assign": sparse_assign, "faded_weight": faded,
    "denstream_offline": denstream, "dbstream_offline": dbstream, "denstream_offline_all": denstream_all, "dbstream_offline_all": dbstream_all,
}

_SEG = "seg AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)), mx AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS g, CAST(c_acctbal / 1000 AS DOUBLE) AS b, code FROM customer JOIN seg USING (c_mktsegment))"
_MCF = _SEG + ", h AS (SELECT g, code, count(*) AS cnt FROM mx GROUP BY 1, 2), mo AS (SELECT g, arg_max(code, (cnt, -code)) AS mode FROM h GROUP BY g), mf AS (SELECT g, count(*) AS n, round(avg(b), 8) AS mean, round(var_pop(b) * count(*), 6) AS s FROM mx GROUP BY g)"
_DDS = "CASE WHEN {x} = 0 THEN 0 ELSE CAST(ceil(ln(abs({x})) / " + LN + ") AS INTEGER) END"
_T = "t0 AS (SELECT doc_id, lang, unnest(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')) AS w FROM documents), t AS (SELECT doc_id, lang, CAST(least(length(w), 13) AS INTEGER) AS j, ln(1 + CAST(count(*) AS DOUBLE)) AS x FROM t0 WHERE w <> '' GROUP BY 1, 2, 3), nn AS (SELECT lang, count(DISTINCT doc_id) AS n FROM t GROUP BY 1), sm AS (SELECT lang, j, sum(x) AS x FROM t GROUP BY 1, 2)"
_MI = "mi AS (SELECT c_custkey AS id, CAST(c_acctbal / 1000 AS DOUBLE) AS u, CAST(c_nationkey AS DOUBLE) AS v, CAST(c_custkey % 4 + 1 AS DOUBLE) AS n FROM customer WHERE c_custkey <= 300)"

MIXED_SQL = {
    "cf_full": "WITH c AS (SELECT l_returnflag, count(*) AS n, covar_pop(l_quantity, l_quantity) AS c00, covar_pop(l_quantity, l_discount) AS c01, covar_pop(l_quantity, l_tax) AS c02, covar_pop(l_discount, l_discount) AS c11, covar_pop(l_discount, l_tax) AS c12, covar_pop(l_tax, l_tax) AS c22 FROM lineitem GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT l_returnflag, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, n, round(c{i}{j}, 8) AS cov FROM c" for i in range(3) for j in range(i, 3)),
    "cf_weighted": "WITH o AS (SELECT o_orderpriority, CAST(o_totalprice / 1000 AS DOUBLE) AS x, CAST(o_orderkey % 3 AS DOUBLE) AS w FROM orders WHERE o_orderkey % 3 > 0), m AS (SELECT o_orderpriority, sum(w) AS n, sum(w * x) / sum(w) AS mean FROM o GROUP BY 1) SELECT o_orderpriority, n, round(mean, 6) AS mean, round(sum(w * (x - mean) * (x - mean)) / n, 4) AS variance FROM o JOIN m USING (o_orderpriority) GROUP BY o_orderpriority, n, mean",
    "grid_micros": "WITH r AS (SELECT CAST(floor(c_acctbal / 1000 + 0.5) AS BIGINT) AS cell, CAST(floor(c_nationkey / 5 + 0.5) AS BIGINT) AS band, CAST(c_acctbal / 1000 AS DOUBLE) AS x FROM customer) SELECT cell, band, count(*) AS n, round(avg(x), 8) AS mean, round(var_pop(x) * count(*), 7) AS s FROM r GROUP BY 1, 2",
    "dds_buckets": f"WITH r AS (SELECT value - 50 AS x FROM events WHERE value IS NOT NULL) SELECT CAST(sign(x) AS INTEGER) AS sign, {_DDS.format(x='x')} AS bucket, count(*) AS cnt FROM r GROUP BY 1, 2",
    "dds_quantiles": f"WITH r AS (SELECT value AS x FROM events WHERE value IS NOT NULL), b AS (SELECT CAST(sign(x) AS INTEGER) AS sg, {_DDS.format(x='x')} AS bu, count(*) AS cnt FROM r GROUP BY 1, 2), c AS (SELECT sg * 2 * pow({DD.gamma!r}, bu) / ({DD.gamma!r} + 1) AS v, sum(cnt) OVER (ORDER BY sg, sg * bu) AS cum FROM b), e AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi FROM r), q AS (SELECT unnest({QS}) AS q) SELECT CAST(q AS DOUBLE) AS q, round(CASE WHEN q <= 0 THEN any_value(lo) WHEN q >= 1 THEN any_value(hi) ELSE arg_min(v, cum) FILTER (WHERE cum > floor(q * (n - 1))) END, 6) AS value FROM q, e, c GROUP BY q",
    "dds_merge": f"SELECT CAST(sign(value) AS INTEGER) AS sign, {_DDS.format(x='value')} AS bucket, count(*) AS cnt FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
    "exact_rank": "SELECT CAST(sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS rank FROM events",
    "mixed_cf": f"WITH {_MCF} SELECT g, n, mean, s, mode FROM mf JOIN mo USING (g)",
    "huang_gamma": "SELECT round(0.5 * (stddev_pop(CAST(c_acctbal / 1000 AS DOUBLE)) + stddev_pop(CAST(c_nationkey AS DOUBLE))) / 2, 8) AS gamma FROM customer",
    "kproto_assign": f"WITH {_MCF}, dd AS (SELECT c_custkey, mf.g, round((b - mean) * (b - mean) + CASE WHEN code <> mode THEN 1.5 ELSE 0 END, 7) AS d FROM mx, mf JOIN mo USING (g)) SELECT c_custkey, arg_min(g, (d, g)) AS g, min(d) AS d FROM dd GROUP BY 1",
    "sparse_cf": f"WITH {_T}, q AS (SELECT lang, sum(x * x) AS q FROM t GROUP BY 1), ss AS (SELECT lang, sum(x * x) AS z FROM sm GROUP BY 1) SELECT lang, n, round(greatest(q - z / n, 0), 5) AS s FROM q JOIN ss USING (lang) JOIN nn USING (lang)",
    "sparse_assign": f"WITH {_T}, c AS (SELECT lang AS cid, j, x / n AS c FROM sm JOIN nn USING (lang)), cc AS (SELECT cid, sum(c * c) AS cc FROM c GROUP BY 1), xx AS (SELECT doc_id, sum(x * x) AS xx FROM t GROUP BY 1), xc AS (SELECT doc_id, cid, sum(x * c) AS xc FROM t JOIN c USING (j) GROUP BY 1, 2), dd AS (SELECT xx.doc_id, cc.cid, greatest(xx - 2 * coalesce(xc, 0) + cc, 0) AS d FROM xx CROSS JOIN cc LEFT JOIN xc ON xc.doc_id = xx.doc_id AND xc.cid = cc.cid) SELECT doc_id, arg_min(cid, (round(d, 9), cid)) AS cid, round(min(d), 6) AS d2 FROM dd GROUP BY 1",
    "faded_weight": "SELECT event_type, round(sum(pow(2.0, -0.001 * (10000 - event_id))), 6) AS weight FROM events GROUP BY 1",
    "denstream_offline": f"WITH RECURSIVE {_MI}, ed AS (SELECT a.id AS a, b.id AS b FROM mi a, mi b WHERE (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v) <= 4 * 0.6 * 0.6), re AS (SELECT id AS x, id AS y FROM mi UNION SELECT x, b FROM re JOIN ed ON a = y), co AS (SELECT x AS id, min(y) AS c FROM re GROUP BY 1), w AS (SELECT c, sum(n) AS weight FROM mi JOIN co USING (id) GROUP BY 1) SELECT id, CAST(CASE WHEN weight >= 10 THEN c ELSE -1 END AS BIGINT) AS component, weight FROM co JOIN w USING (c)",
    "dbstream_offline": f"WITH RECURSIVE {_MI}, st AS (SELECT id FROM mi WHERE n >= 2), sh AS (SELECT id AS a, id * 7 % 300 + 1 AS b, id % 5 * 0.1 AS v FROM mi), e1 AS (SELECT a, b FROM sh WHERE v >= 0.1 * 2.0 AND a <> b AND a IN (SELECT id FROM st) AND b IN (SELECT id FROM st)), ed AS (SELECT a, b FROM e1 UNION SELECT b, a FROM e1), re AS (SELECT id AS x, id AS y FROM st UNION SELECT x, b FROM re JOIN ed ON a = y) SELECT x AS id, min(y) AS component FROM re GROUP BY 1",
}

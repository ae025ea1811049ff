"""Every query with an SQL twin against DuckDB on the smallest tables; the others run and give rows."""

import os
import sys

import duckdb
import numpy as np
import pytest

from moraine.operators.kernels import union_groups
from moraine.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def as_rows(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert as_rows(tuple(r[c] for c in cols) for r in got.collect()) == as_rows(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_every_query_is_known():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert sys.version_info >= (3, 10)


def test_offline_steps_on_all_customers(spark):
    """Every customer takes part, at a size where the first 300 don't hold all; against brute force."""
    data = "/root/testdata/sf0.01"
    c = spark.read.parquet(f"{data}/customer.parquet").orderBy("c_custkey").toPandas()
    ids, n = c.c_custkey.to_numpy(), c.c_custkey.to_numpy() % 4 + 1
    at = {int(x): k for k, x in enumerate(ids)}
    run = lambda name: {tuple(r)[0]: tuple(r)[1:] for r in catalogue.QUERIES[name](spark, data).collect()}
    assert len(ids) > 400
    x = np.c_[c.c_acctbal.astype(float) / 1000, c.c_nationkey.astype(float)]
    root = union_groups(len(ids), np.argwhere(((x[:, None] - x[None]) ** 2).sum(2) <= 4 * 0.6 * 0.6))
    weight = np.bincount(root, n, len(ids))[root]
    assert run("denstream_offline_all") == {int(i): (int(ids[r]) if w >= 10 else -1, w) for i, r, w in zip(ids, root, weight, strict=True)}
    ties = [(at[int(i)], at[int(b)]) for i, b in zip(ids, ids * 7 % ids.max() + 1, strict=True) if i != b and i % 5 * 0.1 >= 0.1 * 2.0 and int(b) in at and n[at[int(i)]] >= 2 and n[at[int(b)]] >= 2]
    root = union_groups(len(ids), ties)
    assert run("dbstream_offline_all") == {int(i): (int(ids[r]),) for i, r, k in zip(ids, root, n, strict=True) if k >= 2}
    first, many = (c.groupby(["c_nationkey", "c_mktsegment"]).c_custkey.transform(f) for f in ("min", "count"))
    assert run("must_link_components") == {int(i): (int(f),) for i, f, k in zip(ids, first, many, strict=True) if k > 1}


def test_offline_denstream_in_any_dimensions(spark):
    """Random, repeated, boundary and broken means in 1, 2 and 5 dimensions, and eps 0; against brute force."""
    from moraine.streaming.evolving import denstream_offline

    rng = np.random.default_rng(3)
    for dim, spread, eps in ((1, 300.0, 0.3), (2, 6.0, 0.5), (5, 2.0, 0.4), (2, 2.0, 0.0)):
        x = rng.random((250, dim)) * spread - spread / 2
        x[:60] = np.round(x[:60] / (2 * eps or 1)) * (2 * eps or 1)  # pairs at 2 eps exactly
        x[60:80] = x[80:100]
        x[100:110] += 1e9
        ids, n = rng.permutation(1000)[: len(x)], rng.integers(1, 4, len(x))
        d = np.zeros((len(x), len(x)))
        for j in range(dim):  # summed in the order that Spark sums in
            d += (x[:, None, j] - x[None, :, j]) ** 2
        root = union_groups(len(x), np.argwhere(d <= 4 * eps * eps))
        low = {r: int(ids[root == r].min()) for r in set(root.tolist())}
        weight = {r: float(n[root == r].sum()) for r in low}
        rows = [(int(i), float(k), v.tolist()) for i, k, v in zip(ids, n, x, strict=True)]
        rows += [(2000, 1.0, [float("nan")] * dim), (2001, 1.0, None)]
        got = denstream_offline(spark.createDataFrame(rows, "id long, n double, mean array<double>"), eps, 5.0).collect()
        assert {r[0]: (r[1], r[2]) for r in got} == {int(i): (low[r] if weight[r] >= 5 else -1, weight[r]) for i, r in zip(ids, root.tolist(), strict=True)}


def test_offline_denstream_of_dense_rows(spark, monkeypatch):
    """20,000 rows in one dense region, of which a pairwise join would make tens of millions of pairs."""
    from moraine.streaming import evolving

    pairs, stored = [], evolving.stored

    def kept(df, name):
        out = stored(df, name)
        pairs.extend([out] if name == "cellpairs" else [])
        return out

    monkeypatch.setattr(evolving, "stored", kept)
    rows = spark.range(20_000).selectExpr("id", "1D as n", "array(rand(1), rand(2)) as mean")
    assert evolving.denstream_offline(rows, 0.2, 10.0).groupBy("component", "weight").count().collect() == [(0, 20_000.0, 20_000)]
    assert pairs and sum(p.count() for p in pairs) < 1_000_000


def test_streams_and_prototypes_are_not_held_whole(spark):
    """Streams pass in Arrow batches, prototypes meet a row in one array; streams equal their models row by row."""
    from moraine.streaming.evolving import DBStream, DenStream, run_stream

    rows = spark.range(3000).selectExpr("id", "concat('k', id % 3) as k", "array(rand(4), rand(5)) as x").repartition(5)
    held = rows.orderBy("id").toPandas()
    for kind, model, params in (("dbstream", DBStream, {"r": 0.2, "decay": 0.01}), ("denstream", DenStream, {"eps": 0.2, "decay": 0.01, "beta": 0.5, "mu": 4.0})):
        run = run_stream(rows, "x", ["id"], kind, "k", **params)
        assert "MapInArrow" in run._jdf.queryExecution().toString() and "InPandas" not in run._jdf.queryExecution().toString()
        want = {(k, 1000, s["weight"], tuple(s["center"])) for k, g in held.groupby("k") for s in model(**params).partial_fit(np.stack(g["x"])).stats()}
        assert {(r["stream"], r["tick"], r["weight"], tuple(r["center"])) for r in run.collect()} == want
    met = catalogue.QUERIES["kproto_assign"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(protos" in met

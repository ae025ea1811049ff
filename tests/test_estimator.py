"""Estimators end to end, persistence, errors, streams and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.estimator import Clustering, KPrototypes, fit_predict_sparse
from moraine.functions.sketches import DDSketch, kll, kll_merge, kll_quantile
from moraine.operators import inspection as I
from moraine.operators.kernels import ContradictionError, adjusted_rand
from moraine.sources.csr import check_csr, sparse_rows
from moraine.sources.delimited import read_points, write_labels
from moraine.streaming.evolving import DBStream, DenStream, run_stream
from tests.test_kernels import blobs


@pytest.fixture(scope="module")
def frame(spark):
    x, y = blobs()
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, y int").repartition(4, "id").cache()


def score(df):
    rows = df.select("label", "y").toPandas()
    return adjusted_rand(rows.label, rows.y)


@pytest.mark.parametrize("method", ["kmeans", "gmm", "ward"])
def test_fit_predict(frame, method):
    assert score(Clustering(n_clusters=4, method=method, max_leaves=300).fit_predict(frame)) > 0.95


def test_inspection(spark, frame):
    far = spark.createDataFrame([(9999, [100.0, 100.0], 9)], frame.schema)
    m = Clustering(n_clusters=4, method="kmeans").fit(frame)
    assert m.summary()["n_samples"] == 2400 and m.n_clusters_ == 4
    assert m.find_outliers(frame.union(far), top_k=1).first()["id"] == 9999
    assert m.sample_representatives(frame, k=2).count() == 8
    assert m.predict_proba(frame).groupBy("id").agg(F.sum("probability").alias("p")).where("abs(p - 1) > 1e-9").count() == 0
    assert I.compare_snapshots(m.snapshot(spark), m.snapshot(spark)).agg(F.max("shift")).first()[0] < 1e-9
    assert m.active_learning_batch(frame, 5).count() == 5 and m.export_coreset(spark).agg(F.sum("weight")).first()[0] == 2400
    assert len(m.cluster_profile(spark, 0)["nearest"]) == 3


def test_constraints_inside_one_leaf(spark, frame):
    """Rows that share a leaf can be parted, as long as their vectors differ."""
    pairs = lambda *p: spark.createDataFrame(list(p), "id_a long, id_b long")
    first = [r["id"] for r in frame.where("y = 0").orderBy("id").select("id").limit(6).collect()]
    a, b, c, d, e, f = first
    for feature in ("diagonal", "full"):
        m = Clustering(n_clusters=4, method="kmeans", max_leaves=12, feature=feature).fit(frame, must_link=pairs((a, b), (c, d)), cannot_link=pairs((a, c), (e, f)))
        got = {r["id"]: r["label"] for r in m.predict(frame).where(F.col("id").isin(first)).collect()}
        assert got[a] == got[b] != got[c] == got[d] and got[e] != got[f]
        assert m.n_leaves_ <= 12 and m.summary()["n_samples"] == 2400
    for max_leaves, tie in ((12, (a, c)), (3, (a, b))):  # a true contradiction; more vectors than leaves
        with pytest.raises(ContradictionError):
            Clustering(n_clusters=4, method="kmeans", max_leaves=max_leaves).fit(frame, must_link=pairs(tie), cannot_link=pairs((a, c), (e, f)))


def test_near_duplicates(spark, frame):
    copies = spark.createDataFrame([(5000 + i, [50.0, 50.0], 9) for i in range(6)], frame.schema)
    both = frame.union(copies)
    m = Clustering(n_clusters=5, method="kmeans", max_leaves=3000).fit(both)
    groups = m.find_near_duplicates(both, 1e-6).collect()
    assert any(set(r["members"]) >= set(range(5000, 5006)) for r in groups)
    assert m.near_duplicate_pairs(both, 0.999).where("a >= 5000 and b >= 5000").count() == 15
    assert m.near_duplicate_pairs(both, 1.01).count() == 0


def test_near_duplicate_pairs_in_blocks(spark, monkeypatch):
    """Leaves of several blocks, of one and of a row, copies and string keys; against brute force."""
    monkeypatch.setattr(I, "PAIR_ROWS", 32)
    monkeypatch.setattr(I, "PAIR_STRIPE", 7)
    monkeypatch.setattr(I, "PAIR_WIDTH", 11)
    monkeypatch.setattr(I, "PAIR_OUT", 5)
    rng = np.random.default_rng(1)
    x, leaf = rng.standard_normal((231, 6)), np.repeat([0, 1, 2], [200, 30, 1])
    x[50:60], x[7] = x[40], 0
    key = [f"k{i:03d}" for i in rng.permutation(231)]
    rows = spark.createDataFrame([(int(c), k, v.tolist()) for c, k, v in zip(leaf, key, x, strict=True)] + [(0, "null", None)], "leaf int, id string, x array<double>").repartition(5)
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    a, b = np.nonzero(((u @ u.T) >= 0.5) & (leaf[:, None] == leaf[None]) & (np.array(key)[:, None] < np.array(key)[None]))
    got = I.near_duplicate_pairs(rows, "id", "x", 0.5).collect()
    assert sorted((r["leaf"], r["a"], r["b"], round(r["cosine"], 9)) for r in got) == sorted((int(leaf[i]), key[i], key[j], round(float(u[i] @ u[j]), 9)) for i, j in zip(a, b, strict=True))


def test_constraints_and_errors(spark, frame):
    pairs = lambda *p: spark.createDataFrame(list(p), "id_a long, id_b long")
    m = Clustering(n_clusters=4, method="kmeans").fit(frame, must_link=pairs((0, 600)), cannot_link=pairs((0, 1)))
    got = {r["id"]: r["label"] for r in m.predict(frame).where("id in (0, 1, 600)").collect()}
    assert got[0] == got[600] and got[0] != got[1]
    with pytest.raises(ValueError):
        Clustering().fit(frame, must_link=pairs((0, 10**6)))
    for bad in ({"method": "x"}, {"chi2_p": 2.0}, {"absorb": "chi2"}, {"huber_k": -1.0}, {"decay": 0.0}, {"feature": "x"}):
        with pytest.raises(ValueError):
            Clustering(**bad)
    with pytest.raises(Exception, match="finite"):
        Clustering().fit(spark.createDataFrame([(0, [float("nan"), 1.0])], "id long, features array<double>"))
    with pytest.raises(TypeError):
        Clustering().fit(spark.createDataFrame([(0, [1, 2])], "id long, features array<int>"))
    with pytest.raises(ValueError):
        Clustering().fit(frame.limit(0))


def test_partial_fit_and_persistence(spark, frame, tmp_path):
    m = Clustering(n_clusters=4, method="gmm", max_leaves=200)
    for k in range(3):
        m.partial_fit(frame.where(F.col("id") % 3 == k))
    m.partial_fit()
    assert score(m.predict(frame)) > 0.95 and m.summary()["n_samples"] == 2400 and m.n_leaves_ <= 200
    m.save(spark, str(tmp_path / "m"))
    again = Clustering.load(spark, str(tmp_path / "m"))
    assert (again.labels_ == m.labels_).all() and again.get_params() == m.get_params()
    with pytest.raises(ValueError):
        m.partial_fit(spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "id long, features array<double>"))


def test_normalize_huber_and_budget(spark, frame):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.3, (200, 2)), [[20.0, 0.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").coalesce(1)
    plain = Clustering(n_clusters=1, method="kmeans", max_leaves=20).fit(df).clusters(spark).first()["center"][0]
    assert abs(plain) > 0.05
    assert Clustering(n_clusters=4, method="kmeans", normalize=True).fit(frame).summary()["n_samples"] == 2400
    assert Clustering(memory_budget_mb=1e-6).effective_max_leaves_ == 33


def test_mapper(spark):
    rng = np.random.default_rng(3)
    neck = np.c_[np.linspace(0, 10, 40), rng.normal(0, 0.05, 40)]
    x = np.concatenate([rng.normal((0, 0), 0.3, (300, 2)), rng.normal((10, 0), 0.3, (300, 2)), neck])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    g = Clustering(n_clusters=2, method="kmeans", max_leaves=150).fit(df).mapper(spark, lens="coordinate", resolution=8, gain=0.4, link_scale=3.0)
    assert g.nodes.count() >= 3 and g.edges.count() >= 2 and len(g.bridges) >= 1


def test_kprototypes_and_sparse(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([np.c_[rng.normal(0, 0.4, (150, 2)), np.zeros(150)], np.c_[rng.normal(8, 0.4, (150, 2)), np.ones(150)]])
    df = spark.createDataFrame([(i, v.tolist(), int(i >= 150)) for i, v in enumerate(x)], "id long, features array<double>, y int")
    assert score(KPrototypes(n_clusters=2, categorical=(2,)).fit(df).predict(df)) > 0.95
    rows = [(i, (80, [0, 1, 2] if i < 150 else [60, 61, 62], rng.uniform(0.5, 1.5, 3).tolist()), int(i >= 150)) for i in range(300)]
    sparse = spark.createDataFrame(rows, "id long, v struct<size:int,indices:array<int>,values:array<double>>, y int")
    assert score(fit_predict_sparse(sparse, "v", 80, 2)) > 0.95


def test_evolving_streams(spark):
    x, y = blobs()
    order = np.random.default_rng(1).permutation(len(x))
    den = DenStream(1.5, 0.001, 0.5, 4).partial_fit(x[order])
    assert adjusted_rand(den.predict(x), y) > 0.9
    db = DBStream(1.5, 5e-4).partial_fit(x[order])
    assert adjusted_rand(db.predict(x), y) > 0.9
    assert (DBStream(1.5, 5e-4).load(db.state()).predict(x) == db.predict(x)).all()
    df = spark.createDataFrame([(i, x[j].tolist()) for i, j in enumerate(order)], "id long, features array<double>")
    assert np.isclose(run_stream(df, "features", ["id"], r=1.5, decay=5e-4).agg(F.sum("weight")).first()[0], sum(s["weight"] for s in db.stats()))
    with pytest.raises(ValueError):
        DenStream(eps=-1.0)


def test_structured_streaming(spark, tmp_path):
    x, _ = blobs(per=50)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run_stream(stream, "features", ["id"], r=1.5, decay=5e-4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.max("tick")).first()[0] == 200


def test_sketches(spark):
    rng = np.random.default_rng(5)
    v = rng.lognormal(size=8000)
    df = spark.createDataFrame([(float(a), i % 2) for i, a in enumerate(v)], "value double, g int")
    dd = DDSketch(0.01)
    whole = {r["q"]: r["value"] for r in dd.quantiles(dd.buckets(df, "value"), [0.0, 0.5, 0.9, 1.0]).collect()}
    assert whole[0.0] == v.min() and whole[1.0] == v.max()
    for q in (0.5, 0.9):
        assert abs(whole[q] / np.sort(v)[int(q * 7999)] - 1) <= 0.02
    small = DDSketch(0.01, 50)
    assert small.buckets(df, "value").count() <= 50 and small.buckets(df, "value").agg(F.sum("cnt")).first()[0] == 8000
    with pytest.raises(ValueError):
        dd.merge(dd.buckets(df, "value"), dd.buckets(df, "value"), DDSketch(0.02))
    parts = kll(df, "value", 400, ["g"])
    got = kll_merge(parts).select(kll_quantile(0.5).alias("m"), "n").first()
    assert abs((v <= got["m"]).mean() - 0.5) < 0.03 and got["n"] == 8000


def test_delimited(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text("a;b\n1;2\n\n3;4\n")
    rows = read_points(spark, str(p), ";", header=True)
    assert [r["features"] for r in rows.orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    write_labels(rows.withColumn("label", F.lit(1)), str(tmp_path / "out"))
    p.write_text("1,2\n3,x\n")
    with pytest.raises(Exception, match="expected 2"):
        read_points(spark, str(p)).collect()
    with pytest.raises(ValueError):
        read_points(spark, str(p), "ab")


def test_csr_and_stream_fit(spark, frame, tmp_path):
    class Matrix:
        indptr, indices, data, shape = [0, 2, 2, 3], [0, 2, 1], [1.0, 2.0, 3.0], (3, 3)

    assert [tuple(r["features"]) for r in sparse_rows(spark, Matrix).orderBy("id").collect()] == [(3, [0, 2], [1.0, 2.0]), (3, [], []), (3, [1], [3.0])]
    for bad in (([0, 2, 1, 3], [0, 2, 1], [1.0, 2.0, 3.0]), ([0, 2, 2, 3], [0, 3, 1], [1.0, 2.0, 3.0]), ([0, 2, 2, 3], [0, 2, 1], [1.0, float("inf"), 3.0])):
        with pytest.raises(ValueError):
            check_csr(*bad, (3, 3))
    frame.select("id", "features").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, features array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    m = Clustering(n_clusters=4, method="kmeans", max_leaves=200)
    m.fit_stream(stream, "features", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert score(m.partial_fit().predict(frame)) > 0.95 and m.summary()["n_samples"] == 2400


def test_mixed_leaders_are_those_of_a_loop_over_rows():
    from moraine.estimator import mixed_leaders

    rng = np.random.default_rng(3)
    x, c = np.round(rng.normal(size=(1500, 2)), 1), rng.integers(0, 3, (1500, 2))
    for threshold, cap in ((0.0, 4000), (0.4, 4000), (0.4, 20), (0.0, 1)):
        lead = []
        for k in range(len(x)):
            if len(lead) < cap and all(((x[k] - x[j]) ** 2).sum() + 0.7 * (c[k] != c[j]).sum() > threshold for j in lead):
                lead.append(k)
        num, cat = mixed_leaders(None, None, x[:700], c[:700], 0.7, threshold, cap)
        num, cat = mixed_leaders(num, cat, x[700:], c[700:], 0.7, threshold, cap)
        assert (num == x[lead]).all() and (cat == c[lead]).all()


def test_models_can_be_pickled(spark):
    import pickle

    rows = spark.createDataFrame([(i, [float(i % 2) * 9 + (i % 7) * 0.01, 0.0]) for i in range(60)], "id long, features array<double>")
    model = Clustering(n_clusters=2, method="kmeans").fit(rows)
    again = pickle.loads(pickle.dumps(model))
    assert again.get_params() == model.get_params() and again.predict(rows).collect() == model.predict(rows).collect()


def test_kprototypes_parameters(spark):
    from moraine.estimator import KPrototypes

    model = KPrototypes(n_clusters=2, categorical=(1,))
    assert model.set_params(n_clusters=3).get_params()["n_clusters"] == 3 and "n_clusters=3" in repr(model)
    with pytest.raises(ValueError, match="unknown"):
        model.set_params(clusters=1)
    with pytest.raises(ValueError, match="fitted"):
        model.predict(spark.createDataFrame([([1.0, 0.0],)], "features array<double>"))


def test_points_from_standard_input(spark, monkeypatch):
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO("a,b\n1,2\n\n3,4.5\n"))
    assert [r["features"] for r in read_points(spark, "-", header=True).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.5]]

"""Estimators: summarise a table, cluster the summary, ask questions.

Deliberate choices: the nearest feature is exact; rows are normalised on every path when ``normalize`` is set;
``max_leaves`` is a hard bound; parameters are checked when an estimator is built; label numbers follow the order of
the features, so runs agree.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.stats import chi2_quantile
from .operators import inspection as I
from .operators import kernels as K
from .operators import topology
from .operators.prepare import budget_max_leaves, cardinalities, huang_gamma, prepare, split_mixed, valid_pairs
from .operators.sparse import checked_sparse, densify
from .operators.summarize import assign, collect, matrix, summarize
from .session import ship, stored

VERSION = 2
METHODS = ("kmeans", "gmm", "gmm-full", "ward", "hdbscan")


def heads(f: K.Features, method: str, k: int, max_iter: int, seed: int, min_samples: int = 5, min_cluster_size: int = 5, spherical: bool = False):
    """(labels, responsibilities or None) of the features."""
    if method == "kmeans":
        labels = (K.kmeans(f, k, max_iter, 4, seed) if k > 0 else K.xmeans(f, max_iter, seed))[0]
    elif method in ("gmm", "gmm-full"):
        labels, resp, _, _ = K.gmm_best(f, k, max_iter, seed, method == "gmm-full", spherical)
        order = K.by_first_member(labels)
        rank = np.full(resp.shape[1], -1)
        rank[labels] = order
        rest = np.flatnonzero(rank < 0)
        rank[rest] = np.arange(order.max() + 1, order.max() + 1 + len(rest))
        out = np.zeros_like(resp)
        out[:, rank] = resp
        return order, out
    elif method == "ward":
        labels = K.ward(f, k)
    elif method == "hdbscan":
        labels = K.hdbscan(f, min_samples, min_cluster_size)
    else:
        raise ValueError(f"method has to be one of {METHODS}")
    return K.by_first_member(labels), None


@dataclass
class Clustering:
    n_clusters: int = 8
    feature: str = "diagonal"
    method: str = "gmm"
    threshold: float = 0.0
    branching: int = 32
    leaf_cap: int = 32
    max_leaves: int = 2000
    max_iter: int = 100
    min_samples: int = 5
    min_cluster_size: int = 5
    seed: int = 0
    distance: str = "euclidean"
    absorb: str = "euclidean"
    chi2_p: float = 0.95
    chi2_scale: float = 0.0
    decay: float = 1.0
    normalize: bool = False
    huber_k: float | None = None
    memory_budget_mb: float | None = None
    _state: dict = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self):
        if self.feature not in ("spherical", "diagonal", "full"):
            raise ValueError("feature has to be spherical, diagonal or full")
        if self.method not in METHODS:
            raise ValueError(f"method has to be one of {METHODS}")
        if self.distance not in ("euclidean", "manhattan", "ward", "average"):
            raise ValueError("distance has to be euclidean, manhattan, ward or average")
        if self.absorb not in ("euclidean", "chi2") or (self.absorb == "chi2" and self.chi2_scale <= 0):
            raise ValueError("absorb has to be euclidean, or chi2 with a positive chi2_scale")
        if not 0 < self.chi2_p < 1:
            raise ValueError("chi2_p has to be inside (0, 1)")
        if self.huber_k is not None and not self.huber_k > 0:
            raise ValueError("huber_k has to be positive")
        if self.n_clusters < 0 or self.threshold < 0 or not 0 < self.decay <= 1:
            raise ValueError("n_clusters and threshold have to be at least 0 and decay inside (0, 1]")

    # parameters

    def get_params(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "_state"}

    def set_params(self, **params) -> Clustering:
        known = {f.name for f in fields(self)} - {"_state"}
        if unknown := set(params) - known:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        fresh = replace(self, _state=self._state, **params)
        self.__dict__.update(fresh.__dict__)
        return self

    @property
    def effective_max_leaves_(self) -> int:
        dim = self._state.get("dim", 1)
        return self.max_leaves if self.memory_budget_mb is None else budget_max_leaves(self.memory_budget_mb, dim, self.feature, self.branching)

    # fitting

    def _summarise(self, df: DataFrame, vec: str, cap: int | None = None):
        row = df.select(F.size(vec)).first()
        if row is None:
            raise ValueError("there are no rows")
        dim = row[0]
        if self._state.get("dim", dim) != dim:
            raise ValueError(f"expected vectors of {self._state['dim']} elements, not {dim}")
        self._state |= {"dim": dim, "vec": vec}
        points = prepare(df, vec, dim, self.normalize)
        gate = (chi2_quantile(dim, self.chi2_p), self.chi2_scale) if self.absorb == "chi2" else None
        table = summarize(points, vec, cap or self.effective_max_leaves_, self.feature, self.threshold, self.distance, gate, self.huber_k)
        return collect(table)

    def fit(self, df: DataFrame, vec: str = "features", must_link: DataFrame | None = None, cannot_link: DataFrame | None = None, id_col: str = "id") -> Clustering:
        """Summarise ``df`` and cluster; constraint tables hold (id_a, id_b) of ``id_col`` and imply k-means."""
        self._state = {}
        self._state["f"], self._state["threshold"], self._state["rebuilds"] = self._summarise(df, vec)
        if must_link is None and cannot_link is None:
            return self._label()
        try:
            labels = self._constrained(df, must_link, cannot_link, id_col)
        except K.ContradictionError:  # the rows may be free to part while their leaves aren't
            self._part_constrained(df, vec, [t for t in (must_link, cannot_link) if t is not None], id_col)
            labels = self._constrained(df, must_link, cannot_link, id_col)
        self._state |= {"labels": K.by_first_member(labels), "resp": None}
        return self

    def _constrained(self, df: DataFrame, must_link: DataFrame | None, cannot_link: DataFrame | None, id_col: str) -> np.ndarray:
        """Labels of the leaves under constraints of rows, as constraints of their leaves."""
        leaf = self._assign(df).select(F.col(id_col).cast("long").alias("id"), "leaf")
        pairs = {}
        for name, table in (("must", must_link), ("cannot", cannot_link)):
            if table is None:
                pairs[name] = []
                continue
            met = valid_pairs(table).join(leaf.select(F.col("id").alias("id_a"), F.col("leaf").alias("a")), "id_a", "left").join(leaf.select(F.col("id").alias("id_b"), F.col("leaf").alias("b")), "id_b", "left")
            got = met.select("a", "b").distinct().collect()  # pairs of leaves: at most max_leaves squared
            if any(r["a"] is None or r["b"] is None for r in got):
                raise ValueError("a constraint names an id that isn't in the table")
            pairs[name] = [(r["a"], r["b"]) for r in got if r["a"] != r["b"] or name == "cannot"]
        if any(a == b for a, b in pairs["cannot"]):
            raise K.ContradictionError("a cannot-link joins rows of one leaf")
        return K.cop_kmeans(self._state["f"], max(1, self.n_clusters), pairs["must"], pairs["cannot"], self.max_iter, 4, self.seed)

    def _part_constrained(self, df: DataFrame, vec: str, links: list[DataFrame], id_col: str) -> None:
        """Summarise anew with a leaf of its own for every vector that a constraint names, inside ``max_leaves``."""
        ends = [valid_pairs(t).select(F.col(c).alias("named")) for t in links for c in ("id_a", "id_b")]
        named = ends[0]
        for e in ends[1:]:
            named = named.union(e)
        named, cap = stored(named.distinct(), "named"), self.effective_max_leaves_
        held = df[id_col].cast("long") == named["named"]
        own = prepare(df.join(named, held, "left_semi"), vec, self._state["dim"], self.normalize)
        own = own.groupBy(F.col(vec).alias("x")).agg(F.count("*").cast("double").alias("n")).limit(cap + 1).toArrow()
        if own.num_rows > cap:
            raise K.ContradictionError(f"constraints that leaves can't keep name more than {cap} vectors: raise max_leaves")
        own = K.Features.points(matrix(own.column("x").combine_chunks()), self.feature == "full", own.column("n").to_numpy())
        rest = df.join(named, held, "left_anti")
        if not rest.isEmpty():
            if len(own) == cap:
                raise K.ContradictionError(f"constraints that leaves can't keep name all of {cap} leaves: raise max_leaves")
            f, self._state["threshold"], self._state["rebuilds"] = self._summarise(rest, vec, cap - len(own))
            own = own.join(f)
        mean, group = np.unique(own.mean, axis=0, return_inverse=True)
        self._state["f"] = own.merge(group.ravel(), len(mean))

    def partial_fit(self, df: DataFrame | None = None, vec: str = "features") -> Clustering:
        """Add rows (earlier ones fade by ``decay``); without rows, cluster what is there."""
        if df is None:
            if "f" not in self._state:
                raise ValueError("there is nothing to cluster yet")
            return self._label()
        f, t, r = self._summarise(df, vec)
        if "f" in self._state:
            old = self._state["f"].decay(self.decay)
            f, t, more = K.compress(old.join(f), self.effective_max_leaves_, max(t, self._state["threshold"]) if len(old) + len(f) > self.effective_max_leaves_ else 0.0, self.distance)
            r += more + self._state["rebuilds"]
        self._state |= {"f": f, "threshold": t, "rebuilds": r, "labels": None, "resp": None}
        return self

    def fit_stream(self, stream: DataFrame, vec: str, checkpoint: str):
        """A stream writer that adds each micro-batch (earlier rows fade by ``decay``); start it, then ``partial_fit()``."""

        def add(batch: DataFrame, _: int) -> None:
            if batch.limit(1).count():
                self.partial_fit(batch, vec)

        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)

    def _label(self) -> Clustering:
        f = self._state["f"]
        labels, resp = heads(f, self.method, self.n_clusters, self.max_iter, self.seed, self.min_samples, self.min_cluster_size, self.feature == "spherical")
        self._state |= {"labels": labels, "resp": resp}
        return self

    def _fitted(self) -> dict:
        if self._state.get("labels") is None:
            if "f" not in self._state:
                raise ValueError("fit the estimator first")
            self._label()
        return self._state

    # rows

    def _assign(self, df: DataFrame, labels=None) -> DataFrame:
        s = self._state
        return assign(prepare(df, s["vec"], s["dim"], self.normalize), s["vec"], s["f"].mean, labels)

    def assign_microclusters(self, df: DataFrame) -> DataFrame:
        return self._assign(df).drop("d2")

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``label`` (-1 is noise); no shuffle."""
        return self._assign(df, self._fitted()["labels"]).drop("leaf", "d2")

    def fit_predict(self, df: DataFrame, vec: str = "features") -> DataFrame:
        return self.fit(df, vec).predict(df)

    def predict_proba(self, df: DataFrame, key: str = "id") -> DataFrame:
        """``(key, label, probability)``: the leaf's posterior for mixtures, else a softmax over cluster centres."""
        s = self._fitted()
        if s["resp"] is None:
            return I.soft_assignment(prepare(df, s["vec"], s["dim"], self.normalize), self.clusters(df.sparkSession), key, s["vec"])
        spark = df.sparkSession
        rows = [(i, c, float(p)) for i, r in enumerate(s["resp"]) for c, p in enumerate(r)]
        return self._assign(df).select(key, "leaf").join(F.broadcast(spark.createDataFrame(rows, "leaf int, label long, probability double")), "leaf").select(key, "label", "probability")

    def assignment_confidence(self, df: DataFrame, key: str = "id") -> DataFrame:
        return I.confidence(self.predict_proba(df, key), key)

    def outlier_scores(self, df: DataFrame) -> DataFrame:
        s = self._fitted()
        return I.outlier_scores(self._assign(df, s["labels"]).drop("leaf", "d2"), self.clusters(df.sparkSession), s["vec"])

    def find_outliers(self, df: DataFrame, key: str = "id", top_k: int = 100) -> DataFrame:
        return I.top_outliers(self.outlier_scores(df), key, top_k)

    def _centred(self, df: DataFrame) -> DataFrame:
        s = self._fitted()
        rows = self._assign(df, s["labels"]).drop("leaf", "d2").where("label >= 0").join(F.broadcast(self.clusters(df.sparkSession).select("label", "center")), "label")
        return rows.withColumn("d2", F.aggregate(F.zip_with(s["vec"], "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)).drop("center")

    def representatives(self, df: DataFrame, key: str = "id", method: str = "medoid", k: int = 5, cluster: int | None = None) -> DataFrame:
        rows = self._centred(df)
        rows = rows if cluster is None else rows.where(F.col("label") == cluster)
        if method in ("medoid", "boundary", "outlier"):
            return I.representatives(rows, key, k, method != "medoid")
        if method != "diverse" or cluster is None:
            raise ValueError("method has to be medoid, boundary, outlier, or diverse with a cluster")
        return rows.where(F.col(key).isin(I.farthest_first(rows, key, self._state["vec"], k)))

    def sample_representatives(self, df: DataFrame, key: str = "id", k: int = 5) -> DataFrame:
        return self.representatives(df, key, "medoid", k)

    def find_near_duplicates(self, df: DataFrame, radius: float, key: str = "id") -> DataFrame:
        return I.near_duplicate_groups(self._assign(df), self.leaves(df.sparkSession), key, radius)

    def near_duplicate_pairs(self, df: DataFrame, threshold: float = 0.9, key: str = "id") -> DataFrame:
        return I.near_duplicate_pairs(self._assign(df), key, self._state["vec"], threshold)

    def active_learning_batch(self, df: DataFrame, n: int, strategy: str = "confidence", key: str = "id") -> DataFrame:
        if strategy == "confidence":
            return I.active_batch(self.assignment_confidence(df, key), key, n)
        return I.active_batch(self.outlier_scores(df).select(key, "score"), key, n, "score", lowest=False)

    # the summary

    def leaves(self, spark: SparkSession) -> DataFrame:
        """``(leaf, n, mean, s, label)``."""
        s = self._fitted()
        f = s["f"]
        diag = np.einsum("nii->ni", f.s) if f.s.ndim == 3 else f.s
        rows = [(i, float(n), m.tolist(), v.tolist(), int(c)) for i, (n, m, v, c) in enumerate(zip(f.n, f.mean, diag, s["labels"], strict=True))]
        return spark.createDataFrame(rows, "leaf int, n double, mean array<double>, s array<double>, label long")

    def clusters(self, spark: SparkSession) -> DataFrame:
        return I.cluster_stats(self.leaves(spark))

    def export_coreset(self, spark: SparkSession) -> DataFrame:
        return I.leaf_stats(self.leaves(spark)).select(F.col("mean").alias("center"), F.col("n").alias("weight"), "radius")

    def summary(self) -> dict:
        s = self._fitted()
        f = s["f"]
        return {"n_samples": round(float(f.n.sum())), "n_leaves": len(f), "n_clusters": self.n_clusters_, "dim": s["dim"], "threshold": s["threshold"], "rebuilds": s["rebuilds"]}

    def diagnostics(self) -> dict:
        f = self._fitted()["f"]
        radius = np.sqrt(f.trace() / f.n)
        p = np.percentile(radius, [50, 90, 99])
        return {"compression_ratio": float(f.n.sum()) / len(f), "radius_p50": p[0], "radius_p90": p[1], "radius_p99": p[2], "mass_min": f.n.min(), "mass_median": float(np.median(f.n)), "mass_max": f.n.max()}

    def cluster_profile(self, spark: SparkSession, cluster: int) -> dict:
        own = self.clusters(spark).where(F.col("label") == cluster).first()
        if own is None:
            raise ValueError(f"there is no cluster {cluster}")
        near = I.neighbours(self.clusters(spark)).where(F.col("label") == cluster).orderBy("rank").collect()
        return own.asDict() | {"nearest": [(r["other"], r["distance"]) for r in near]}

    def snapshot(self, spark: SparkSession) -> DataFrame:
        return stored(self.clusters(spark), "snapshot")

    compare_snapshots = staticmethod(I.compare_snapshots)

    def mapper(self, spark: SparkSession, **options) -> topology.MapperGraph:
        return topology.mapper(self.leaves(spark), **options)

    def mapper_stability(self, spark: SparkSession, resolutions=None, **options) -> list[dict]:
        return topology.mapper_stability(self.leaves(spark), resolutions, **options)

    @property
    def labels_(self) -> np.ndarray:
        return self._fitted()["labels"]

    @property
    def n_clusters_(self) -> int:
        return len({int(x) for x in self._fitted()["labels"] if x >= 0})

    @property
    def n_leaves_(self) -> int:
        return len(self._state["f"]) if "f" in self._state else 0

    @property
    def n_rebuilds_(self) -> int:
        return self._state.get("rebuilds", 0)

    @property
    def threshold_(self) -> float:
        return self._state.get("threshold", self.threshold)

    # persistence

    def save(self, spark: SparkSession, path: str) -> None:
        """Leaves as Parquet and parameters as one JSON row."""
        s = self._fitted()
        f = s["f"]
        resp = s["resp"] if s["resp"] is not None else [None] * len(f)
        rows = [(i, float(n), m.tolist(), v.ravel().tolist(), int(c), None if r is None else r.tolist()) for i, (n, m, v, c, r) in enumerate(zip(f.n, f.mean, f.s, s["labels"], resp, strict=True))]
        spark.createDataFrame(rows, "leaf int, n double, mean array<double>, s array<double>, label long, resp array<double>").write.mode("overwrite").parquet(f"{path}/leaves")
        meta = {"version": VERSION, "params": self.get_params(), "dim": s["dim"], "vec": s["vec"], "threshold": s["threshold"], "rebuilds": s["rebuilds"]}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Clustering:
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        if meta["version"] != VERSION:
            raise ValueError(f"saved by version {meta['version']}, this is {VERSION}")
        out = cls(**meta["params"])
        rows = spark.read.parquet(f"{path}/leaves").orderBy("leaf").collect()
        d = meta["dim"]
        s = np.array([r["s"] for r in rows])
        f = K.Features(np.array([r["n"] for r in rows]), np.array([r["mean"] for r in rows]), s.reshape(-1, d, d) if out.feature == "full" else s)
        resp = None if rows[0]["resp"] is None else np.array([r["resp"] for r in rows])
        out._state = {"f": f, "labels": np.array([r["label"] for r in rows]), "resp": resp, "dim": d, "vec": meta["vec"], "threshold": meta["threshold"], "rebuilds": meta["rebuilds"]}
        return out


def fit_predict(df: DataFrame, vec: str = "features", **params) -> DataFrame:
    """``df`` with ``label``, in one call."""
    params.pop("n_jobs", None)  # partitions are the parallelism
    return Clustering(**params).fit_predict(df, vec)


def fit_predict_sparse(df: DataFrame, col: str, dim: int, n_clusters: int = 8, method: str = "kmeans", threshold: float = 0.0, max_leaves: int = 2048, seed: int = 0) -> DataFrame:
    """Labels for sparse rows; rows are densified batch by batch on their way into the summary."""
    if method == "hdbscan":
        raise ValueError("hdbscan isn't offered for sparse rows")
    dense = densify(checked_sparse(df, col), col, dim, "_dense")
    model = Clustering(n_clusters=n_clusters, method=method, threshold=threshold, max_leaves=max_leaves, seed=seed, feature="spherical")
    return model.fit(dense, "_dense").predict(dense).drop("_dense")


FAN_IN = 64


def mixed_leaders(num, cat, x, c, gamma: float, threshold: float, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaders ``num``, ``cat`` (None: none yet) and those of the rows ``x``, ``c`` that are farther than
    ``threshold`` from every leader before them, ``cap`` in all; blocks of rows are compared at once."""
    num, cat = (x[:0], c[:0]) if num is None else (num, cat)
    for a in range(0, len(x), 512):
        y, d = x[a : a + 512], c[a : a + 512]
        if len(num):
            gap = gamma * (d[:, None, :] != cat[None]).sum(2)
            for j in range(y.shape[1]):  # differences, as equal rows have to be at distance 0
                gap = gap + (y[:, j, None] - num[:, j]) ** 2
            y, d = y[gap.min(1) > threshold], d[gap.min(1) > threshold]
        while len(y) and len(num) < cap:
            num, cat = np.concatenate([num, y[:1]]), np.concatenate([cat, d[:1]])
            far = ((y - y[0]) ** 2).sum(1) + gamma * (d != d[0]).sum(1) > threshold
            y, d = y[far], d[far]
        if len(num) >= cap:
            break
    return num, cat


@dataclass
class KPrototypes:
    """Mixed numeric and categorical rows: k-prototypes on leader features."""

    n_clusters: int = 8
    categorical: tuple[int, ...] = ()
    gamma: float | None = None
    threshold: float = 0.0
    max_leaves: int = 2048
    max_iter: int = 100
    n_init: int = 4
    seed: int = 0
    _state: dict = field(default_factory=dict, repr=False, compare=False)

    def fit(self, df: DataFrame, vec: str = "features") -> KPrototypes:
        if self.n_clusters < 1:
            raise ValueError("n_clusters has to be at least 1")
        ship()
        dim = df.select(F.size(vec)).first()[0]
        split = split_mixed(prepare(df, vec, dim), vec, list(self.categorical), dim)
        cards = cardinalities(split)
        nums = dim - len(set(self.categorical))
        wide = split.select(*[F.col("num")[j].alias(f"c{j}") for j in range(nums)])
        gamma = huang_gamma(wide, wide.columns) if self.gamma is None else self.gamma
        cap, threshold = self.max_leaves, self.threshold

        def leaders(batches, cap=cap):
            num, cat = None, None
            for b in batches:
                if b.num_rows:
                    more = matrix(b.column("num")), matrix(b.column("cat")).astype(int)
                    num, cat = mixed_leaders(num, cat, *more, gamma, threshold, cap)
            if num is not None:
                yield pa.record_batch([pa.array(num.tolist()), pa.array(cat.tolist(), pa.list_(pa.int32()))], ["num", "cat"])

        kind = "num array<double>, cat array<int>"
        part = F.spark_partition_id().alias("part")
        seeds = stored(split.select("num", "cat").mapInArrow(leaders, kind).select(part, "num", "cat"), "leaders")
        parts = seeds.agg(F.max("part")).first()[0] or 0
        while parts:  # rounds, so that no task reads more than about FAN_IN * max_leaves rows
            parts //= FAN_IN
            seeds = seeds.select((F.col("part") / FAN_IN).cast("int").alias("part"), "num", "cat").repartition(parts + 1, "part").sortWithinPartitions("part", "num", "cat")
            seeds = stored(seeds.select("num", "cat").mapInArrow(leaders, kind).select(part, "num", "cat"), "leaders")
        seeds = seeds.select("num", "cat").collect()  # max_leaves rows
        num, cat = np.array([r["num"] for r in seeds]), np.array([r["cat"] for r in seeds])

        def tally(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x, c = matrix(b.column("num")), matrix(b.column("cat")).astype(int)
                d = K.pairwise_sq(x, num) + gamma * (c[:, None, :] != cat[None]).sum(2)
                yield pa.record_batch([pa.array(d.argmin(1).astype(np.int32)), b.column("num"), b.column("cat")], ["leaf", "num", "cat"])

        placed = stored(split.select("num", "cat").mapInArrow(tally, "leaf int, num array<double>, cat array<int>"), "mixed")
        from .operators.cf import diagonal

        cf = {r["leaf"]: r for r in diagonal(placed, ["leaf"], "num").collect()}
        used = sorted(cf)
        hist = [np.zeros((len(used), m)) for m in cards]
        place = {leaf: i for i, leaf in enumerate(used)}
        for r in placed.select("leaf", F.posexplode("cat").alias("j", "c")).groupBy("leaf", "j", "c").count().collect():
            hist[r["j"]][place[r["leaf"]], r["c"]] = r["count"]
        f = K.Features(np.array([cf[i]["n"] for i in used]), np.array([cf[i]["mean"] for i in used]), np.array([cf[i]["s"] for i in used]))
        x = K.Mixed(f, hist)
        labels, mean, mode, cost = K.kprototypes(x, self.n_clusters, gamma, self.max_iter, self.n_init, self.seed)
        self._state = {"x": x, "labels": labels, "centroids": mean, "modes": mode, "cost": cost, "gamma": gamma, "vec": vec, "dim": dim}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        ship()
        s = self._state
        if not s:
            raise ValueError("the model isn't fitted")
        split = split_mixed(prepare(df, s["vec"], s["dim"]), s["vec"], list(self.categorical), s["dim"])
        shared = df.sparkSession.sparkContext.broadcast((s["x"].num.mean, s["x"].modes(), s["labels"], s["gamma"]))

        def run(batches):
            mean, mode, labels, gamma = shared.value
            for b in batches:
                x, c = matrix(b.column("num")), matrix(b.column("cat")).astype(int)
                d = K.pairwise_sq(x, mean) + gamma * (c[:, None, :] != mode[None]).sum(2) if b.num_rows else np.zeros((0, 1))
                yield pa.record_batch([*b.columns, pa.array(labels[d.argmin(1)].astype(np.int64))], [*b.schema.names, "label"])

        from pyspark.sql import types as T

        return split.mapInArrow(run, T.StructType([*split.schema.fields, T.StructField("label", T.LongType())])).drop("num", "cat")

    def get_params(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "_state"}

    def set_params(self, **params) -> KPrototypes:
        if unknown := set(params) - set(self.get_params()):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        self.__dict__.update(params)
        return self

    @property
    def cluster_centroids_(self):
        return self._state["centroids"], self._state["modes"]


__all__ = ["Clustering", "KPrototypes", "fit_predict", "fit_predict_sparse", "heads"]

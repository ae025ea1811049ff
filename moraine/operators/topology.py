"""Mapper graphs over feature rows: lens, overlapping cover, single linkage in bins, nerve.

The input is a leaf table ``(leaf, n, mean, s)`` of at most a few thousand rows, so pair joins are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sq_euclidean
from .graph import connected_components
from .inspection import leaf_stats
from .kernels import bridges

LENSES = ("density", "radius", "norm", "coordinate", "eccentricity")


def pairs(leaves: DataFrame) -> DataFrame:
    """``(a, b, d)`` for a <> b: distances of means."""
    a, b = leaves.select(F.col("leaf").alias("a"), F.col("mean").alias("ma")), leaves.select(F.col("leaf").alias("b"), F.col("mean").alias("mb"))
    return a.crossJoin(F.broadcast(b)).where("a <> b").select("a", "b", F.sqrt(sq_euclidean(F.col("ma"), F.col("mb"))).alias("d"))


def lens_values(leaves: DataFrame, lens: str = "density", density_k: int = 5, coordinate: int = 0) -> DataFrame:
    """``leaves`` with a column ``lens``."""
    if lens == "radius":
        return leaf_stats(leaves).withColumnRenamed("radius", "lens")
    if lens == "norm":
        return leaves.withColumn("lens", F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, v: a + v * v)))
    if lens == "coordinate":
        return leaves.withColumn("lens", F.col("mean")[coordinate])
    near = pairs(leaves)
    if lens == "eccentricity":
        got = near.groupBy("a").agg(F.avg("d").alias("lens"))
    elif lens == "density":
        r = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
        mean = near.withColumn("r", r).where(F.col("r") <= density_k).groupBy("a").agg(F.avg("d").alias("m"))
        got = mean.select("a", F.when(F.col("m") > 0, 1 / F.col("m")).otherwise(float("inf")).alias("lens"))
    else:
        raise ValueError(f"lens has to be one of {LENSES}")
    return leaves.join(got.withColumnRenamed("a", "leaf"), "leaf", "left").fillna(0.0, ["lens"])


def cover(lensed: DataFrame, resolution: int = 10, gain: float = 0.3) -> DataFrame:
    """A row for each bin that holds a leaf; bins overlap by ``gain`` and both ends count."""
    if resolution < 1:
        raise ValueError("resolution has to be at least 1")
    good = F.col("lens").isNotNull() & ~F.isnan("lens") & (F.abs("lens") < float("inf"))
    ends = lensed.where(good).agg(F.min("lens").alias("lo"), F.max("lens").alias("hi"))
    step = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / resolution).otherwise(1.0)
    pad = min(max(gain, 0.0), 0.999) / 2
    held = lensed.crossJoin(F.broadcast(ends.select(F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce(step, F.lit(1.0)).alias("step"))))
    held = held.withColumn("value", F.when(good, F.col("lens")).otherwise(F.col("lo"))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))))
    low, high = F.col("lo") + F.col("bin") * F.col("step") - pad * F.col("step"), F.col("lo") + (F.col("bin") + 1) * F.col("step") + pad * F.col("step")
    return held.where((F.col("value") >= low) & (F.col("value") <= high)).drop("lo", "step")


def link(covered: DataFrame, link_scale: float = 1.0) -> DataFrame:
    """Single linkage in each bin at upper-median nearest gap times ``link_scale``: ``covered`` with ``comp``."""
    a = covered.select("bin", F.col("leaf").alias("a"), F.col("mean").alias("ma"))
    b = covered.select("bin", F.col("leaf").alias("b"), F.col("mean").alias("mb"))
    d = a.join(b, "bin").where("a <> b").select("bin", "a", "b", F.sqrt(sq_euclidean(F.col("ma"), F.col("mb"))).alias("d"))
    gaps = d.groupBy("bin", "a").agg(F.min("d").alias("g")).groupBy("bin").agg(F.sort_array(F.collect_list("g")).alias("gs"))
    scale = gaps.select("bin", (F.get("gs", F.floor(F.size("gs") / 2).cast("int")) * link_scale).alias("limit"))
    edges = d.join(F.broadcast(scale), "bin").where("d <= limit and a < b")
    key = lambda c: F.col("bin").cast("long") * (1 << 40) + F.col(c)
    comp = connected_components(edges.select(key("a").alias("a"), key("b").alias("b")))
    out = covered.withColumn("node", key("leaf")).join(comp, "node", "left")
    return out.withColumn("comp", F.coalesce("component", "node") % (1 << 40)).drop("node", "component")


def nodes(linked: DataFrame, min_node_mass: float = 0.0) -> DataFrame:
    """``(node, bin, comp, mass, centroid, lens)`` in order of (bin, least leaf); light nodes are dropped."""
    flat = linked.select("bin", "comp", "n", "value", F.posexplode("mean").alias("j", "x"))
    parts = flat.groupBy("bin", "comp", "j").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
    center = parts.groupBy("bin", "comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("centroid"))
    mass = linked.groupBy("bin", "comp").agg(F.sum("n").alias("mass"), F.avg("value").alias("lens"))
    kept = mass.join(center, ["bin", "comp"]).where(F.col("mass") >= min_node_mass)
    return kept.withColumn("node", F.row_number().over(Window.partitionBy().orderBy("bin", "comp")) - 1)


def nerve(linked: DataFrame, node_table: DataFrame) -> DataFrame:
    """``(a, b, shared)``: nodes that share leaves."""
    member = linked.join(F.broadcast(node_table.select("bin", "comp", "node")), ["bin", "comp"]).select("leaf", "node")
    b = member.withColumnRenamed("node", "b")
    return member.withColumnRenamed("node", "a").join(b, "leaf").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def branch_points(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    return both.groupBy("node").agg(F.count("*").alias("degree")).where("degree >= 3")


class MapperGraph:
    """Nodes and edges as DataFrames, with branch points and bridges."""

    def __init__(self, node_table: DataFrame, edge_table: DataFrame):
        self.nodes, self.edges = node_table, edge_table

    @property
    def branch_points(self) -> list[int]:
        return sorted(r["node"] for r in branch_points(self.edges).collect())

    @property
    def bridges(self) -> list[tuple[int, int]]:
        n, pairs_ = self.nodes.count(), sorted((r["a"], r["b"]) for r in self.edges.collect())
        return [pairs_[i] for i in bridges(n, pairs_)]

    def betti(self) -> tuple[int, int]:
        """Components (isolated nodes count) and independent loops."""
        from .kernels import union_groups

        n, pairs_ = self.nodes.count(), [(r["a"], r["b"]) for r in self.edges.collect()]
        b0 = len(set(union_groups(n, pairs_).tolist()))
        return b0, max(0, len(pairs_) - n + b0)

    def to_networkx(self):
        import networkx

        g = networkx.Graph()
        g.add_nodes_from((r["node"], r.asDict()) for r in self.nodes.collect())
        g.add_weighted_edges_from(((r["a"], r["b"], r["shared"]) for r in self.edges.collect()), weight="shared")
        return g


def mapper(leaves: DataFrame, lens: str = "density", resolution: int = 10, gain: float = 0.3, link_scale: float = 1.0, min_node_mass: float = 0.0, density_k: int = 5, coordinate: int = 0) -> MapperGraph:
    from ..session import stored

    linked = stored(link(cover(lens_values(leaves, lens, density_k, coordinate), resolution, gain), link_scale), "mapper")
    table = stored(nodes(linked, min_node_mass), "nodes")
    return MapperGraph(table, stored(nerve(linked, table), "edges"))


def mapper_stability(leaves: DataFrame, resolutions=None, **options) -> list[dict]:
    """Components and loops over a sweep of resolutions."""
    if "resolution" in options:
        raise TypeError("pass resolutions, not resolution")
    out = []
    for r in resolutions or range(4, 30, 2):
        b0, b1 = mapper(leaves, resolution=r, **options).betti()
        out.append({"resolution": r, "components": b0, "loops": b1})
    return out

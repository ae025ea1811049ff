"""Questions to a clustered table; plain joins, windows and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_doubles, l2_normalize, sq_euclidean, total
from ..session import ship, stored
from .summarize import assign, matrix

#: Rows of a block of near_duplicate_pairs, of a product's two sides, and pairs of a batch that it gives.
PAIR_ROWS, PAIR_STRIPE, PAIR_WIDTH, PAIR_OUT = 1 << 13, 512, 2048, 1 << 16


def nearest_center(points: DataFrame, centers: DataFrame, key: list[str], vec: str, center: str = "mean", cid: str = "cid") -> DataFrame:
    """``(key, cid, d2)``: the nearest centre, ties to the smaller id.  ``centers`` is a bounded table (``assign`` checks
    its size); rows are matched in one narrow pass."""
    table = sorted(centers.select(cid, center).collect(), key=lambda r: r[0])
    ids, means = np.array([r[0] for r in table], np.int64), np.array([r[1] for r in table], float)
    rows = points.select(*key, as_doubles(F.col(vec)).alias("_vec"))
    return assign(rows, "_vec", means, ids, "_leaf", "d2", "_cid").select(*key, F.col("_cid").alias(cid), "d2")


def cluster_stats(leaves: DataFrame, label: str = "label") -> DataFrame:
    """Pooled ``(label, size, center, radius)`` of feature rows (n, mean, s array); noise (-1) is skipped."""
    from .cf import merge

    pooled = merge(leaves.where(F.col(label) >= 0), [label])
    return pooled.select(label, F.col("n").alias("size"), F.col("mean").alias("center"), F.sqrt(total(F.col("s")) / F.col("n")).alias("radius"))


def leaf_stats(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("radius", F.sqrt(F.when(F.col("n") > 0, total(F.col("s")) / F.col("n")).otherwise(0.0)))


def outlier_scores(points: DataFrame, stats: DataFrame, vec: str, label: str = "label") -> DataFrame:
    """Add ``score``: distance to the centre of the row's cluster over its radius (1 if 0); infinite for noise."""
    met = points.join(F.broadcast(stats.select(label, "center", "radius")), label, "left")
    d = F.sqrt(sq_euclidean(as_doubles(F.col(vec)), F.col("center")))
    score = F.when(F.col("radius") > 0, d / F.col("radius")).otherwise(d)
    return met.withColumn("score", F.when(F.col("center").isNull(), F.lit(float("inf"))).otherwise(score)).drop("center", "radius")


def top_outliers(scored: DataFrame, key: str, k: int = 100) -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(k)


def representatives(scored: DataFrame, key: str, k: int = 5, farthest: bool = False, label: str = "label", by: str = "d2") -> DataFrame:
    """The ``k`` rows of each cluster nearest its centre, or farthest from it, with their rank."""
    order = F.desc(by) if farthest else F.asc(by)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order, key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def farthest_first(points: DataFrame, key: str, vec: str, k: int, start: Column | None = None) -> list:
    """Keys of ``k`` diverse rows: the first (smallest key), then each time the row farthest from those taken."""
    x = as_doubles(F.col(vec))
    first = points.orderBy(key).select(key, x.alias("x")).first()
    taken, centers = [first[0]], [first[1]]
    while len(taken) < k:
        lits = [F.array(*[F.lit(v) for v in c]) for c in centers]
        gap = F.least(*[sq_euclidean(x, c) for c in lits]) if len(lits) > 1 else sq_euclidean(x, lits[0])
        nxt = points.where(~F.col(key).isin(taken)).orderBy(F.desc(F.round(gap, 9)), key).select(key, x.alias("x")).first()
        if nxt is None:
            break
        taken.append(nxt[0])
        centers.append(nxt[1])
    return taken


def near_duplicate_groups(assigned: DataFrame, leaves: DataFrame, key: str, radius: float, leaf: str = "leaf") -> DataFrame:
    """``(leaf, size, members)`` of tight leaves with two members at least."""
    tight = leaf_stats(leaves).where(F.col("radius") < radius).select(leaf)
    met = assigned.join(F.broadcast(tight), leaf)
    return met.groupBy(leaf).agg(F.count("*").alias("size"), F.sort_array(F.collect_list(key)).alias("members")).where("size >= 2")


def near_duplicate_pairs(assigned: DataFrame, key: str, vec: str, threshold: float = 0.9, leaf: str = "leaf") -> DataFrame:
    """Pairs ``(a, b, cosine)`` inside a leaf at ``threshold`` or more.

    All pairs of a leaf are compared, in blocks of about ``PAIR_ROWS`` rows: every two blocks are a job of their own
    that holds one block and streams the other, so memory is bounded whatever a leaf's size.
    """
    ship()
    rows = assigned.select(F.col(leaf).alias("leaf"), F.col(key).alias("key"), l2_normalize(as_doubles(F.col(vec))).alias("u"))
    rows = stored(rows.where("leaf is not null and key is not null and forall(u, v -> v is not null)"), "units")
    size = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("blocks"))
    read = size.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0  # rows of all jobs
    met = rows.join(F.broadcast(size.drop("n")), "leaf").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("held"), "key", "u")
    parts = max(min(2 * read // PAIR_ROWS, 1 << 13), int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = met.repartition(parts, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", F.desc("held"))
    types = {f.name: f.dataType for f in met.schema.fields}
    schema = T.StructType([T.StructField(n, t) for n, t in (("leaf", types["leaf"]), ("x", types["key"]), ("y", types["key"]), ("cosine", T.DoubleType()))])
    found = met.mapInArrow(_paired(threshold), schema).where("x <> y")
    return found.select(F.col("leaf").alias(leaf), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def _paired(threshold: float):
    """Pairs of rows sorted by job (leaf, i, j): the held block first, which is all there is where i = j."""

    def pairs(held, first, batch, u, inside):
        """Pairs of held rows and those of a batch; inside a block each row only meets those before it."""
        x = held[1]
        for p in range(0, len(u), PAIR_STRIPE):
            y = u[p : p + PAIR_STRIPE]
            upto = first + p + len(y) if inside else len(x)
            for q in range(0, upto, PAIR_WIDTH):
                near = ~(y @ x[q : min(upto, q + PAIR_WIDTH)].T < threshold - 1e-9)  # NaN is above all, as in Spark
                if inside:
                    near &= np.arange(q, q + near.shape[1])[None] < np.arange(first + p, first + p + len(y))[:, None]
                at, to = np.nonzero(near)
                for k in range(0, len(at), PAIR_OUT):
                    r, c = at[k : k + PAIR_OUT], to[k : k + PAIR_OUT] + q
                    cosine = np.zeros(len(r))
                    for j in range(u.shape[1]):  # in the order of ``dot``
                        cosine += y[r, j] * x[c, j]
                    ok = ~(cosine < threshold)
                    if ok.any():
                        a, b = held[0].take(pa.array(c[ok])), batch.column("key").take(pa.array(r[ok] + p))
                        yield pa.record_batch([batch.column("leaf").take(pa.array(r[ok] + p)), a, b, pa.array(cosine[ok])], ["leaf", "x", "y", "cosine"])

    def run(batches):
        at, keys, block, filled = None, [], np.zeros((0, 0)), 0
        for whole in batches:
            if not whole.num_rows:
                continue
            lead = [whole.column(c) for c in ("leaf", "i", "j", "held")]
            starts = [0]
            for c in lead:  # where any of them differs from the row before
                starts += (np.flatnonzero(pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()
            starts = sorted(set(starts)) + [whole.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                b = whole.slice(s, e - s)
                leaf, i, j, held = (c[s].as_py() for c in lead)
                if at != (leaf, i, j):
                    at, keys, filled = (leaf, i, j), [], 0
                u = matrix(b.column("u"))
                if held:
                    if filled + len(u) > len(block) or block.shape[1] != u.shape[1]:
                        wider = np.empty((max(2 * len(block), filled + len(u)), u.shape[1]))
                        if filled:
                            wider[:filled] = block[:filled]
                        block = wider
                    block[filled : filled + len(u)] = u
                    keys.append(b.column("key"))
                    filled += len(u)
                if keys and (not held or i == j):
                    keys = [pa.concat_arrays(keys)] if len(keys) > 1 else keys
                    yield from pairs((keys[0], block[:filled]), filled - len(u), b, u, i == j)

    return run


def soft_assignment(points: DataFrame, stats: DataFrame, key: str, vec: str, label: str = "label") -> DataFrame:
    """``(key, label, probability)`` by softmax(-d^2 / 2 tau^2), tau the mean cluster radius."""
    tau = F.greatest(F.avg("radius").over(Window.partitionBy()), F.lit(1e-12))
    table = stats.withColumn("tau", tau).select(label, "center", "tau")  # a row a cluster
    met = points.crossJoin(F.broadcast(table))
    z = -sq_euclidean(as_doubles(F.col(vec)), F.col("center")) / (2 * F.col("tau") * F.col("tau"))
    met = met.select(key, label, z.alias("z"))
    own = Window.partitionBy(key)
    met = met.withColumn("e", F.exp(F.col("z") - F.max("z").over(own)))
    return met.select(key, label, (F.col("e") / F.sum("e").over(own)).alias("probability"))


def confidence(soft: DataFrame, key: str) -> DataFrame:
    return soft.groupBy(key).agg(F.max("probability").alias("confidence"))


def active_batch(scores: DataFrame, key: str, n: int, by: str = "confidence", lowest: bool = True) -> DataFrame:
    return scores.orderBy(F.asc(by) if lowest else F.desc(by), key).limit(n)


def neighbours(stats: DataFrame, k: int = 3, label: str = "label") -> DataFrame:
    """The ``k`` nearest other clusters of each, with their distance and rank."""
    a = stats.select(label, F.col("center").alias("ca"))
    b = F.broadcast(stats.select(F.col(label).alias("other"), F.col("center").alias("cb")))
    met = a.crossJoin(b).where(F.col(label) != F.col("other")).withColumn("distance", F.sqrt(sq_euclidean(F.col("ca"), F.col("cb"))))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.round("distance", 9), "other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(label, "other", "distance", "rank")


def compare_snapshots(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """For each cluster after: the nearest before, the shift, the shift over its radius (1 if 0), and the mass ratio."""
    b = F.broadcast(before.select(F.col(label).alias("was"), F.col("center").alias("cb"), F.col("size").alias("sb")))
    met = after.crossJoin(b).withColumn("shift", F.sqrt(sq_euclidean(F.col("center"), F.col("cb"))))
    best = F.min(F.struct(F.round("shift", 9).alias("r"), "was", "shift", "sb")).alias("b")
    got = met.groupBy(label, "size", "radius").agg(best)
    scale = F.when(F.col("radius") > 0, F.col("radius")).otherwise(1.0)
    return got.select(label, F.col("b.was").alias("was"), F.col("b.shift").alias("shift"), (F.col("b.shift") / scale).alias("relative_shift"), (F.col("size") / F.col("b.sb")).alias("mass_ratio"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari`` from the contingency table of two label columns."""
    pairs = lambda x: x * (x - 1) / 2
    table = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    ra = table.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("pa"), F.sum("n").alias("total"))
    rb = table.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("pb"))
    both = table.agg(F.sum(pairs(F.col("n"))).alias("both"))
    met = both.crossJoin(ra).crossJoin(rb)  # single rows
    expected, most = F.col("pa") * F.col("pb") / pairs(F.col("total")), (F.col("pa") + F.col("pb")) / 2
    return met.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))

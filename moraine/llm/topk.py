"""Operator 8: exact top-k inner products by block-at-a-time pruning.

Vectors are turned into integers (``floor(scale * x)``).  Candidates are renumbered by content: a hash-chosen sample of
rows, ``CELLS`` at most, gives cells, a row belongs to the nearest, and cells are dealt to groups of about ``group_rows``
rows (a larger cell is split by a hash of the id).  A group is halved along its widest component until ranges hold
``block_rows`` rows: document-range blocks of the new numbers, each with the maximum and minimum of every component (a
term's extremes; weights can be negative).  For a query, the sum of the larger of weight * maximum and weight * minimum
bounds every score of the block.  Blocks are taken in falling order of that bound and scored through the block's rows,
until the next bound is below the query's kth score so far.

A first pass searches each query in one group of its own cell; the kth score found there is a floor for the second pass,
which meets all groups, so blocks below the floor are never scored.  How much is pruned depends on the data: clustered
vectors lose most blocks, vectors without any structure none (``Blocks`` counts blocks met and scored).

A group is packed in one row, its forward index; queries are packed in chunks of neighbouring cells and sent to every
group, as each query has to meet all rows: a task reads a group's index, then the chunks one by one.  A group returns k
rows a query at most, from which the k best follow.  Ties go to the smaller id; bounds equal to the kth score are still scored, so ties are kept right.

Defined results: vectors that are null, empty, of another length than most (of equally frequent lengths the smallest),
or that hold null or non-finite components take no part; repeated rows are candidates each, except those of the
query's own id; a query with fewer than k candidates gets all; a null id takes no part; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hash_sample, ship, stored

GROUP_ROWS, BLOCK_ROWS, QUERY_ROWS, SCALE, CELLS = 4096, 64, 512, 1024, 256
#: No score; its negative is a number too.
NONE = np.iinfo(np.int64).min + 1


def _pack(batches):
    """Rows (g, vec_id, v) sorted by g: one row for each g with ids and the matrix."""
    key, ids, rows = None, [], []

    def done():
        m = np.stack(rows).astype("<i8")
        return pa.record_batch([pa.array([key], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["g", "ids", "m"])

    for b in batches:
        g = b.column("g").to_numpy(zero_copy_only=False)
        vec = b.column("vec_id").to_numpy(zero_copy_only=False)
        v = b.column("v")
        flat = v.flatten().to_numpy(zero_copy_only=False)
        matrix = flat.reshape(len(g), -1) if len(g) else flat.reshape(0, 0)
        cuts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else []
        for a, z in zip(cuts, [*cuts[1:], len(g)], strict=True):
            if key is not None and g[a] != key:
                yield done()
                ids, rows = [], []
            key = int(g[a])
            ids += vec[a:z].tolist()
            rows += list(matrix[a:z])
    if key is not None:
        yield done()


def by_content(matrix: np.ndarray, rows: int) -> np.ndarray:
    """An order of the rows in which ranges of ``rows`` are alike: halves along the widest component, again and again."""
    out, todo = [], [np.arange(len(matrix))]
    while todo:
        at = todo.pop()
        if len(at) <= rows:
            out.append(at)
            continue
        x = matrix[at]
        widest = x[:, int((x.max(0) - x.min(0)).argmax())]
        half = (len(at) // 2 + rows - 1) // rows * rows  # whole blocks on the left
        order = np.argsort(widest, kind="stable")
        todo += [at[order[half:]], at[order[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Blocks:
    """Document-range blocks of a group with the extremes of every component."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, rows: int):
        order = by_content(matrix, rows)
        # products of integers: exact in float64 while sums stay below 2**53, else in int64
        self.exact = bool(matrix.size == 0 or float(np.abs(matrix.astype(float)).max()) ** 2 * matrix.shape[1] < 2**52)
        self.ids, self.matrix = ids[order], matrix[order].astype(np.float64 if self.exact else np.int64)
        self.begin = np.arange(0, len(ids), rows)
        self.end = np.minimum(self.begin + rows, len(ids))
        self.high = np.maximum.reduceat(self.matrix, self.begin, axis=0)
        self.low = np.minimum.reduceat(self.matrix, self.begin, axis=0)
        self.met = self.scored = 0  # blocks times queries, and those of them that were scored

    def top(self, qids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of the k best rows of this group for each query, but for some below ``floor``."""
        q = queries.astype(self.matrix.dtype)
        bound = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        n = len(qids)
        score = np.full((n, k), -np.inf if self.exact else NONE, self.matrix.dtype)
        vec = np.full((n, k), np.iinfo(np.int64).max)
        found = np.zeros(n, np.int64)
        floor = np.full(n, NONE) if floor is None else floor
        self.met += bound.size
        for step in range(order.shape[1]):
            now = order[:, step]
            best = bound[np.arange(n), now]
            live = np.flatnonzero((best >= floor) & ((found < k) | (best >= score[:, k - 1])))
            if not len(live):
                break
            self.scored += len(live)
            by = live[np.argsort(now[live], kind="stable")]
            cut = np.flatnonzero(np.append(True, now[by][1:] != now[by][:-1]))
            for a, z in zip(cut, [*cut[1:], len(by)], strict=True):
                rows, blk = by[a:z], now[by[a]]
                lo, hi = self.begin[blk], self.end[blk]
                s = q[rows] @ self.matrix[lo:hi].T
                own = self.ids[None, lo:hi] == qids[rows, None]
                s = np.where(own, score.dtype.type(-np.inf) if self.exact else NONE, s)
                alls = np.concatenate([score[rows], s], 1)
                allv = np.concatenate([vec[rows], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(self.ids[lo:hi], s.shape))], 1)
                best = np.lexsort((allv, -alls), axis=1)[:, :k]
                score[rows], vec[rows] = np.take_along_axis(alls, best, 1), np.take_along_axis(allv, best, 1)
                found[rows] += (~own).sum(1)
        good = vec != np.iinfo(np.int64).max
        r = np.nonzero(good)[0]
        return qids[r], vec[good], score[good].astype(np.int64)


def _search(dim: int, k: int, block_rows: int, floors: bool):
    """Rows sorted by group, its index before the chunks of queries; one group is held at a time.  With ``floors`` a
    query's last component is its floor; without, only kth scores are given."""

    def run(batches):
        key = blocks = None
        for b in batches:
            for i in range(b.num_rows):
                ids, m = (np.frombuffer(b.column(c)[i].as_buffer(), "<i8") for c in ("ids", "m"))
                g = b.column("g")[i].as_py()
                if not b.column("asks")[i].as_py():
                    key, blocks = g, Blocks(ids, m.reshape(-1, dim), block_rows)
                elif g == key:
                    m = m.reshape(len(ids), -1)
                    q, v, s = blocks.top(ids, m[:, :dim], k, m[:, dim] if floors else None)
                    yield pa.record_batch([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"]) if floors else _kth(q, s, k)

    return run


def _kth(q: np.ndarray, s: np.ndarray, k: int) -> pa.RecordBatch:
    """The kth score of the queries that have one; rows are by query and falling score."""
    at = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    full = at[np.diff(np.append(at, len(q))) >= k]
    return pa.record_batch([pa.array(q[full]), pa.array(s[full + k - 1])], ["query_id", "floor"])


def _cells(pivots: np.ndarray):
    """Number of the nearest pivot, as a column more."""
    half = (pivots.astype(float) ** 2).sum(1) / 2

    def run(batches):
        for b in batches:
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, pivots.shape[1]), np.int64)
            cell = (x.astype(float) @ pivots.T.astype(float) - half).argmax(1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([b.column("vec_id"), v, pa.array(cell.astype(np.int32))], ["vec_id", "v", "cell"])

    return run


def _filled(sizes: dict[int, int], cells: int, capacity: int) -> tuple[int, list[int], list[int]]:
    """Bins, and of every cell the first bin and how many: cells in order fill bins, a larger one has bins of its own."""
    first, many, n, room = [0] * cells, [1] * cells, 0, 0
    for c in sorted(sizes):
        if sizes[c] > capacity:
            first[c], many[c] = n + (room > 0), -(-sizes[c] // capacity)
            n, room = first[c] + many[c], 0
        else:
            if room + sizes[c] > capacity:
                n, room = n + 1, 0
            first[c], room = n, room + sizes[c]
    return n + (room > 0), first, many


def topk(vectors: DataFrame, query: F.Column | None = None, k: int = 10, scale: int = SCALE, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``query`` marks the query rows (default: ids divisible by 100)."""
    ship(texts=True)
    spark = vectors.sparkSession
    x = F.col("embedding")
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    ok = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)))
    lengths = ok.groupBy(F.size(x).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score long"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, n = lengths["d"], lengths["n"]
    rows = ok.where(F.size(x) == dim).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))
    # at most CELLS vectors; one cell where one group holds all
    pivots = np.array([r["v"] for r in hash_sample(rows, "vec_id", CELLS if n > group_rows else 1, n).collect()], np.int64)
    rows = stored(rows.mapInArrow(_cells(pivots), "vec_id long, v array<bigint>, cell int"), "vectors")
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows
    groups, first, many = _filled(sizes, len(pivots), group_rows)
    n_chunks, chunk, spread = _filled(sizes, len(pivots), 100 * QUERY_ROWS)  # one row in a hundred asks
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    home = pick(first).cast("long")
    part = lambda base, salts, seed: pick(base).cast("long") + F.pmod(F.xxhash64("vec_id", F.lit(seed)), pick(salts))
    parts, packed = int(spark.conf.get("spark.sql.shuffle.partitions")), "g long, ids binary, m binary"

    def dealt(df, most):
        return df.repartition(min(most, parts), "g").sortWithinPartitions("g", "vec_id").select("g", "vec_id", "v").mapInArrow(_pack, packed)

    def searched(chunks, floors, kind):
        todo = index.withColumn("asks", F.lit(False)).unionByName(chunks.withColumn("asks", F.lit(True)))
        todo = todo.repartition(min(groups, parts), "g").sortWithinPartitions("g", "asks")
        return todo.select("g", "asks", "ids", "m").mapInArrow(_search(dim, k, block_rows, floors), kind)

    index = stored(dealt(rows.withColumn("g", part(first, many, 1)), groups), "blocks")
    asked = rows.where(F.pmod(F.col("vec_id"), F.lit(100)) == 0 if query is None else query)
    floors = searched(dealt(asked.withColumn("g", home), groups), False, "query_id long, floor long").groupBy("query_id").agg(F.min("floor").alias("floor"))
    floored = asked.join(floors, asked.vec_id == floors.query_id, "left").withColumn("v", F.concat("v", F.array(F.coalesce("floor", F.lit(NONE)))))
    chunks = stored(dealt(floored.withColumn("g", part(chunk, spread, 2)), n_chunks), "chunks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    found = searched(chunks.drop("g").withColumn("g", every), True, "query_id long, vec_id long, score long")
    order = F.row_number().over(_by_score())
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _by_score():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def op8_block_pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

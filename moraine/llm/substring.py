"""Operator 3: substring deduplication by relative Lempel-Ziv parsing.

A word is removed when it lies in a window of ``width`` consecutive words whose sequence also starts elsewhere.

1. Seeds.  Every window has an anchor: the least hash among its ``SEED``-word grams.  Consecutive windows with
   one anchor are a piece; equal windows have equal anchors at equal places, so only pieces with an anchor in
   common can hold equal windows.  Anchors are counted with map-side combining; most pieces end here.
2. Pieces with an anchor in common are folded to distinct contents, with their number.  One piece of each content goes
   to the reference block of its anchor with its words, twice where the content has copies.
3. A block is indexed (rank tables by prefix doubling, which give a suffix order and the longest match of every
   position in the rest of the block) and each piece is factored against it greedily: the longest match, or
   one word, then on from its end.  Factors of ``width`` words or more are duplicate spans; the windows that
   straddle a factor boundary are looked up, as two sources may follow each other.
   Blocks hold whole anchors and about ``block_words`` words.  An anchor with more than ``hot`` contents would make a
   block without bound: its windows are compared as 128-bit keys with map-side combining instead, which gives the same.
4. Spans go from contents to all pieces that have them, then to their documents, and the kept words are written out.

Joins on anchors, contents and windows spread the keys that have more than ``limit`` rows over salts; the list of these
keys is broadcast and ``limit`` grows with the rows, so it has ``HEAVY_KEYS`` entries at most.

Defined results: null texts count as empty; texts of fewer than ``width`` words lose nothing; repeated rows are
copies of each other, so texts of ``width`` words or more go wholly; all of equal windows go, none is preferred;
ids of any type, null included, are carried as they are; an empty table gives an empty result; extra columns are ignored.
Words are compared by 64-bit hashes, windows by at least 112 bits of them, rows are told apart by 128 bits of id and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, stored
from .textkit import Words, as_i64, grams, mix, slices

U = np.uint64
WIDTH, SEED = 35, 8
BLOCK_WORDS, HOT = 1 << 18, 2048
#: Rows from which a key is spread over salts, and the most keys that are.
HEAVY_ROWS, HEAVY_KEYS = 8192, 1 << 19


def _least(v: np.ndarray, span: int) -> np.ndarray:
    """Position of the first least value among ``span`` values from each position on."""
    pos, have = np.arange(len(v)), 1

    def join(a, b):
        return np.where(v[b] < v[a], b, a)

    while have * 2 <= span:
        pos = join(pos[:-have], pos[have:])
        have *= 2
    if have < span:
        pos = join(pos[: len(pos) - (span - have)], pos[span - have :])
    return pos


class Pieces:
    """Windows of a column slice, cut in runs with one anchor."""

    def __init__(self, w: Words, width: int, seed: int):
        n = np.diff(w.off)
        doc = w.doc_of()
        inside = np.arange(len(w.hash)) + width <= w.off[1:][doc] if len(doc) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        self.width, self.n = width, n
        if not len(at):
            self.start = self.count = self.doc = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, U)
            return
        seeds = mix(grams(w.hash, seed))
        place = _least(seeds, width - seed + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[at[1:]] != doc[at[:-1]])
        first = np.flatnonzero(new)
        self.doc = doc[at[first]]
        self.start = at[first]
        self.count = np.diff(np.append(first, len(at)))
        self.anchor = seeds[place[first]]
        windows = grams(w.hash, width)[at]
        self.content = mix(np.add.reduceat(mix(windows ^ mix((place - at).astype(U))), first) + self.count.astype(U))


def _emit_pieces(width: int, seed: int):
    def run(batches):
        for b in slices(batches):
            w = Words(b.column("text"))
            p = Pieces(w, width, seed)
            take = pa.array(p.doc)
            yield pa.record_batch(
                [as_i64(p.anchor), as_i64(p.content), b.column("dk").take(take), b.column("th").take(take), pa.array((p.start - w.off[p.doc]).astype(np.int32)), pa.array(p.count.astype(np.int32))],
                ["anchor", "content", "dk", "th", "pos", "len"],
            )

    return run


def _emit_words(width: int):
    """For each asked piece of a document its word hashes."""

    def run(batches):
        for b in slices(batches):
            w = Words(b.column("text"))
            out = {k: [] for k in ("anchor", "content", "hot", "n", "words")}
            for i, asked in enumerate(b.column("asked").to_pylist()):
                for x in asked:
                    at = w.off[i] + x["pos"]
                    for k in ("anchor", "content", "hot", "n"):
                        out[k].append(x[k])
                    out["words"].append(w.hash[at : at + x["len"] + width - 1].tobytes())
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def longest_matches(text: np.ndarray, piece: np.ndarray, longest: int) -> np.ndarray:
    """For each position of a block the longest match (up to ``longest`` words, inside its piece) elsewhere in it.

    ``text`` are word hashes, ``piece`` the piece each belongs to.  Ranks of all 2**k-word substrings by prefix
    doubling; neighbours in the order of the longest give the match, as in a suffix array.
    """
    n = len(text)
    end = np.searchsorted(piece, piece, side="right")
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    tables, size = [rank], 1
    while size < longest:
        ok = np.arange(n) + size < end
        right = np.full(n, -1, np.int64)
        # past the piece's end every position is different: it sorts before all words and equals nothing
        right[ok] = rank[np.minimum(np.arange(n) + size, n - 1)[ok]]
        pair = (rank + 1) * (n + 2) + right + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        tables.append(rank)
        size *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        step = 1 << k
        while True:
            p, q = a + common, b + common
            ok = (p + step <= end[a]) & (q + step <= end[b])
            same = ok & (tables[k][np.minimum(p, n - 1)] == tables[k][np.minimum(q, n - 1)])
            common[same] += step
            if k != len(tables) - 1 or not same.any():
                break
    best = np.zeros(n, np.int64)
    if n > 1:
        np.maximum.at(best, a, common)
        np.maximum.at(best, b, common)
    return best


def factor(best: np.ndarray, begin: int, end: int, width: int) -> list[tuple[int, int]]:
    """Greedy parse of positions begin:end; the window ranges (first start, count) that repeat elsewhere."""
    spans, at = [], begin
    while at + 1 <= end:
        reach = max(1, int(best[at]))
        if reach >= width:
            spans.append((at, reach - width + 1))
        edge = at + reach
        # a repeated window over the boundary starts inside this factor and ends inside the next one
        for s in range(max(at, edge - width + 1, begin), min(edge, end - width + 1)):
            if s + width > edge and best[s] >= width:
                spans.append((s, 1))
        at = edge
    return spans


SPAN = "anchor long, content long, off int, len int, n long, w1 long, w2 long"
_NAMES, _TYPES = ["anchor", "content", "off", "len", "n", "w1", "w2"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def _windows(held: list[tuple], width: int) -> pa.RecordBatch:
    """128-bit keys of every window of the held pieces, with the number of the piece's copies."""
    cols = [[np.zeros(0, np.int64)] for _ in _NAMES]
    for anchor, content, n, raw in held:
        h = np.frombuffer(raw, U)
        one, two = grams(h, width).view(np.int64), grams(mix(h + U(77)), width).view(np.int64)
        for c, x in zip(cols, (anchor, content, np.arange(len(one)), 1, n, one, two), strict=True):
            c.append(np.broadcast_to(np.asarray(x, np.int64), len(one)))
    return pa.record_batch([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def _factor_blocks(width: int, block_words: int):
    """Rows sorted by hot, anchor and content.  Duplicate spans of each piece, or a hot anchor's windows (w1 is set);
    one block is held at a time."""

    def block(held):
        parts = [np.frombuffer(r[3], U) for r in held]
        twins = [p for p, r in zip(parts, held, strict=True) if r[2] > 1]  # the other copy of a repeated content
        size = np.array([len(p) for p in parts + twins])
        best = longest_matches(np.concatenate(parts + twins), np.repeat(np.arange(len(size)), size), 2 * width)
        begin = np.cumsum(size) - size
        out = []
        for (anchor, content, _, _), at, m in zip(held, begin.tolist(), size.tolist(), strict=False):
            out += [(anchor, content, s - at, count) for s, count in factor(best, at, at + m, width)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.record_batch([*(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=False)), *(pa.nulls(len(out), pa.int64()) for _ in range(3))], _NAMES)

    def run(batches):
        held, words, last = [], 0, None

        def done():
            return _windows(held, width) if last[0] else block(held)

        for b in batches:
            for hot, *row in zip(*(b.column(c).to_pylist() for c in ("hot", "anchor", "content", "n", "words")), strict=True):
                key = (hot, row[0], row[1])
                if key == last:
                    continue  # a repeated row gave the same piece
                # a block holds whole anchors; windows of hot ones need no company
                if held and words >= block_words and (hot or key[:2] != last[:2]) or last is not None and hot != last[0]:
                    yield done()
                    held, words = [], 0
                last = key
                held.append(row)
                words += len(row[3]) // 8
        if held:
            yield done()

    return run


def heavy(counted: DataFrame, keys: list[str], total: int, least: int) -> DataFrame:
    """``keys`` and ``salts`` of the keys whose ``n`` rows are too many for a task: ``HEAVY_KEYS`` keys at most."""
    limit = max(least, total // HEAVY_KEYS)
    return counted.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("salts"))


def meet(many: DataFrame, one: DataFrame, keys: list[str], salted: DataFrame, by: list[str]) -> DataFrame:
    """Inner join; rows of ``many`` with a key of ``salted`` are spread by a hash of ``by``, those of ``one`` repeated."""
    salted = F.broadcast(salted)
    left = many.join(salted, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    right = one.join(salted, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [*keys, "salt"]).drop("salt")


def _cut(width: int, texts: bool):
    """Drop the covered words; ``spans`` are window ranges of the row's document."""

    def run(batches):
        for b in slices(batches):
            w = Words(b.column("text"), hashed=False)
            n = np.diff(w.off)
            gone = np.zeros(len(w.start) + 1, np.int64)
            spans = b.column("spans")
            valid = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            for i, row in zip(valid.tolist(), spans.take(pa.array(valid)).to_pylist(), strict=True):
                pos = np.array([x["pos"] for x in row], np.int64) + w.off[i]
                end = pos + np.array([x["len"] for x in row], np.int64) + width - 1
                np.add.at(gone, pos, 1)
                np.add.at(gone, end, -1)
            covered = np.cumsum(gone[:-1]) > 0
            removed = np.add.reduceat(np.append(covered, False).astype(np.int64), w.off[:-1]) if len(n) else np.zeros(0, np.int64)
            removed[n == 0] = 0
            kept, raw = [], w.data.tobytes()
            begin, end = w.start.tolist(), (w.start + w.length).tolist()
            for i in range(len(n)):
                stay = np.flatnonzero(~covered[w.off[i] : w.off[i + 1]]) + w.off[i]
                kept.append(b" ".join([raw[begin[k] : end[k]] for k in stay.tolist()]))
            out = [b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                out.append(pa.array([x.decode("utf-8", "replace") for x in kept]))
                names.append("kept")
            yield pa.record_batch(out, names)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, block_words: int = BLOCK_WORDS, hot: int = HOT, texts: bool = False, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept])`` per document."""
    ship(texts=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.when(F.col(id_col).isNull(), F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(id_col))
    src = docs.select(F.col(id_col).alias("doc_id"), row.alias("dk"), F.xxhash64(text).alias("th"), text.alias("text"))
    pieces = src.select("dk", "th", "text").mapInArrow(_emit_pieces(width, seed), "anchor long, content long, dk long, th long, pos int, len int")
    place = ["dk", "th", "pos"]
    seen = stored(pieces.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = heavy(seen, ["anchor"], total, heavy_rows)
    shared = stored(meet(pieces, seen.select("anchor"), ["anchor"], many, place), "pieces")
    contents = shared.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct(*place, "len")).alias("at"))
    contents = stored(contents.select("anchor", "content", "n", "at.*"), "contents")
    crowd = contents.groupBy("anchor").agg((F.count("*") > hot).alias("hot"), (F.sum("n") > 1).alias("met"))
    asked = meet(contents, crowd.where("met").drop("met"), ["anchor"], many, ["content"])
    by_doc = asked.groupBy("dk", "th").agg(F.collect_list(F.struct("anchor", "content", "hot", "n", "pos", "len")).alias("asked"))
    worded = src.join(by_doc.hint("shuffle_hash"), ["dk", "th"]).select("text", "asked")
    worded = worded.mapInArrow(_emit_words(width), "anchor long, content long, hot boolean, n long, words binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col("hot"), F.xxhash64("content")).otherwise(F.lit(0))
    blocks = worded.withColumn("spread", spread).repartition(parts, "anchor", "spread").sortWithinPartitions("hot", "anchor", "content")
    found = stored(blocks.mapInArrow(_factor_blocks(width, block_words), SPAN), "spans")
    spans, windows = found.where("w1 is null").select("anchor", "content", "off", "len"), found.where("w1 is not null")
    n_windows = windows.count()
    if n_windows:
        key = ["w1", "w2"]
        twice = stored(windows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("n").alias("times")).where("times > 1").select(*key, "n"), "repeats")
        often = heavy(twice, key, n_windows, heavy_rows)
        spans = spans.union(meet(windows.drop("n"), twice.select(*key), key, often, ["anchor", "content", "off"]).select("anchor", "content", "off", "len"))
    copies = heavy(contents, ["anchor", "content"], total, heavy_rows)
    placed = meet(shared.drop("len"), spans, ["anchor", "content"], copies, place)
    covered = placed.select("dk", "th", (F.col("pos") + F.col("off")).alias("pos"), "len").groupBy("dk", "th").agg(F.collect_set(F.struct("pos", "len")).alias("spans"))
    out = src.join(covered.hint("shuffle_hash"), ["dk", "th"], "left").select("doc_id", "text", "spans")
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    return out.mapInArrow(_cut(width, texts), schema + (", kept string" if texts else ""))


def op3_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS win FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
twice AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT p.r, p.i + k AS i FROM p JOIN twice USING (win), range(35) AS t(k)),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS said FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""

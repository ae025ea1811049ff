"""Operator 9: exact n-gram Jaccard join by T-occurrence search (DivideSkip), with near-duplicate classes.

Two documents link when ``100 * |A & B| >= threshold * |A | B|`` for their sets of distinct word shingles.

1. Equal sets are folded to one representative each (a 128-bit digest of the set), so a group of copies of
   any size is one row from there on.
2. Partition signatures give candidates without loss.  Sets are put in size classes; a class whose largest
   set has U shingles allows D = floor((1 - t) / t * U) elements outside the intersection, so of D + 1 + e hash
   partitions of the shingles at least 1 + e are equal.  Documents that share an equal, non-empty partition
   meet; a document with more than e empty partitions also offers those.  As linked documents share several
   keys, each document leaves out its most common ones (prefix filter over the keys' group sizes), so passages
   that many documents share do not tie them.  Copies in a batch are folded before the shuffle.
3. Components of that candidate graph are the blocks to search.  A component above ``block_rows`` is searched by the
   stars of its candidates instead: documents that share a kept key share its group's first document, so each such
   document with those around it is a block that loses no link.
4. Inside a block T-occurrence search runs over inverted lists (DivideSkip): the short lists are merged by a heap that
   skips what can't reach the overlap, the longest are only probed by binary search for the survivors, and the overlap
   is checked exactly.  Near copies of one text are searched by their differences from what most of them hold, which
   is exact too (``InvertedLists``).  Queries stop for documents already connected to the block's most central one.
   A star above ``block_rows`` is dealt in parts.  Its most central document (that with the most keys in common) is
   searched in every part; only documents that don't link with it are then searched in all parts.  Parts carry sets
   of hashes, no texts.  Their cost is unlinked documents times parts: small for near copies of one text.
5. Components of the links are the classes.

Defined results: null or empty texts have an empty set, link with nothing and are their own class; texts with
fewer than n words give one shingle; repeated rows give one row each; the smallest id names a class, and rows of one
id are one document; rows with a null id get a null class; ids that aren't integers are told apart by 64-bit hashes;
an empty table gives an empty result.  Shingles are compared by 64-bit hashes; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..session import ship, stored
from .textkit import Words, grams, mix, slices

U = np.uint64
#: Growth of the size classes.
GROWTH = 1.3
BLOCK_ROWS = 4000
_SIG, _SET = 0, 1


def classes(threshold: int, top: int = 1 << 40) -> np.ndarray:
    """Upper sizes of the classes; sets up to the first size can only link when equal."""
    first = max(1, -(-threshold // (100 - threshold)) - 1) if threshold < 100 else top
    out = [first]
    while out[-1] < top:
        out.append(int(out[-1] * GROWTH) + 1)
    return np.array(out, dtype=np.int64)


def partitions(upper: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash partitions of a class, and how many of them are more than the elements that can differ leave equal.

    The union has at most 100/threshold times the smaller set's elements, so at most
    ``upper * (100 - threshold) / threshold`` differ.  The surplus is what a set of the class's smallest size
    leaves empty by chance, with a margin, so that hardly any document has to offer its empty partitions, and
    some more, so that linked documents share many keys and the prefix filter can leave common ones out.
    """
    least = upper * (100 - threshold) // threshold + 1
    empty = least * np.exp(-upper / GROWTH / least)
    surplus = np.ceil(empty + 4 * np.sqrt(empty) + 2).astype(np.int64) + least * (100 - threshold) // 100
    return least + surplus, surplus


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    w = Words(texts, lower=True)
    g = grams(w.hash, n)
    out = []
    for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(mix(grams(w.hash[a:b], b - a) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def _signatures(sets: list[np.ndarray], ids: np.ndarray, upper: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, their documents, and scheme * 2**32 + the least number of keys that a linked document shares."""
    size = np.array([len(s) for s in sets], np.int64)
    own = np.searchsorted(upper, size)
    keys, docs, tags = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # a set signs for its own size class and for every class above that a linked set can be in
    for step in range(int(np.ceil(np.log(100 / threshold) / np.log(GROWTH))) + 2):
        cls = np.minimum(own + step, len(upper) - 1)
        take = own > 0 if step == 0 else (size * 100 // threshold > upper[cls - 1]) & (size > 0)
        at = np.flatnonzero(take)
        if not at.size:
            continue
        g = np.concatenate([sets[i] for i in at])
        row = np.repeat(np.arange(len(at)), size[at])
        m, surplus = partitions(upper[cls[at]], threshold)
        part = ((g >> U(32)) * m[row].astype(np.uint64)) >> U(32)
        new = np.ones(len(g), bool)
        new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(mix(g + U(1)), first)
        label = cls[at][row[first]].astype(np.uint64) * U(1 << 40) + part[first]
        filled = np.bincount(row[first], minlength=len(at))
        shared = np.maximum(1, 1 + surplus - (m - filled)) + (step << 32)
        keys.append(mix(total ^ mix(label)))
        docs.append(ids[at[row[first]]])
        tags.append(shared[row[first]])
        for j in np.flatnonzero(m - filled > surplus):
            lack = np.setdiff1d(np.arange(m[j]), part[row == j].astype(np.int64))
            keys.append(mix(mix(lack.astype(np.uint64) + U(int(cls[at[j]]) << 40)) + U(3)))
            docs.append(np.full(len(lack), ids[at[j]]))
            tags.append(np.full(len(lack), shared[j]))
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(tags)


def _keyed(n: int, threshold: int):
    names = ["k1", "k2", "kind", "a", "b"]
    upper = classes(threshold)

    def rows(k1, k2, kind, a, b):
        full = lambda x: pa.array(np.broadcast_to(np.asarray(x), len(k1)).astype(np.int64))
        return pa.record_batch([pa.array(k1.view(np.int64)), full(k2), full(kind), full(a), full(b)], names)

    def run(batches):
        for batch in slices(batches):
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            sets = shingle_sets(batch.column("text"), n)
            size = np.array([len(s) for s in sets], np.int64)
            s1 = np.array([mix(s).sum(dtype=U) for s in sets], U)
            s2 = np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for s in sets], U)
            lone = size == 0  # empty sets equal nothing: a key of their own
            s1, s2 = np.where(lone, mix(ids.view(U)), s1), np.where(lone, mix(ids.view(U) + U(9)), s2)
            yield rows(s1, s2.view(np.int64), _SET, ids, size)
            # copies within the batch send one document's keys
            _, once = np.unique(np.stack([s1, s2], 1), axis=0, return_index=True)
            keys, docs, tags = _signatures([sets[i] for i in once], ids[once], upper, threshold)
            if len(keys):
                yield rows(keys, 0, _SIG, docs, tags)

    return run


#: Groups of more documents than this count as this many.
GROUP_CAP = 1024


def _groups(batches):
    """Rows sorted by key.  Set keys: (representative, document, set size).  Signature keys of two documents at
    least: (first document, document, tag, key, group size up to a cap).  Holds a group up to the cap at most."""
    names = ["a", "b", "n", "tag", "key", "size"]
    held: list[np.ndarray] = []  # the columns of the group that the last batch ended with, not yet given out
    center = size = None

    def give(cols, size):
        k1, _, kind, a, b, head = cols
        whole = kind == _SET
        take = whole | (size > 1)
        cols = (head, a, np.where(whole, b, -1), np.where(whole, 0, b), np.where(whole, 0, k1), np.where(whole, 0, np.minimum(size, GROUP_CAP)))
        return pa.record_batch([pa.array(np.asarray(x, np.int64)[take]) for x in cols], names)

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(cols[0]):
            continue
        if held:
            cols = [np.concatenate([x, y]) for x, y in zip(held[:5], cols, strict=True)]
        k1, k2, kind, a, _ = cols
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (kind[1:] != kind[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        count = np.diff(np.append(first, len(k1)))
        heads = a[first]
        if held:  # what was given out of the first group before
            heads[0] = center
            count[0] += size
        last = first[-1]
        full = [*cols, heads[group]]
        ready = count[group]
        if count[-1] >= GROUP_CAP:
            held, center, size = [x[-1:] for x in full], heads[-1], count[-1] - 1
        else:
            keep = len(k1) - last
            size = count[-1] - keep
            held, center = [x[last:] for x in full], heads[-1]
        m = len(k1) - len(held[0])
        if m:
            yield give([x[:m] for x in full], ready[:m])
    if held:
        yield give(held, np.full(len(held[0]), size + len(held[0])))


class InvertedLists:
    """T-occurrence search over a block of sets: inverted lists of positions, short ones merged by a heap, long ones probed.

    ``sets`` may be differences from one common set, with the ``sizes`` of the whole sets: two sets differ where their
    differences do, so with ``excess`` = (100 + t) * |difference| - (100 - t) * |set| they link when the differences
    have ``(excess + excess) / (2 * (100 + t))`` elements in common, without any when that isn't above 0.
    """

    def __init__(self, sets: list[np.ndarray], threshold: int, sizes: np.ndarray | None = None):
        self.t, self.sets = threshold, sets
        self.held = np.array([len(s) for s in sets], np.int64)
        self.size = self.held if sizes is None else sizes
        self.excess = (100 + self.t) * self.held - (100 - self.t) * self.size
        flat = np.concatenate(sets) if sets else np.zeros(0, U)
        owner = np.repeat(np.arange(len(sets)), self.held)
        order = np.argsort(flat, kind="stable")
        self.posting = owner[order]
        self.token, self.begin = np.unique(flat[order], return_index=True)
        self.end = np.append(self.begin[1:], len(flat))
        self.probe = np.repeat(np.arange(len(self.token)), self.end - self.begin) * max(1, len(sets)) + self.posting
        self.listed = self.posting.tolist()

    def merge(self, lists: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions on ``need`` of the lists or more, and on how many, by a heap over the lists' heads.

        Heads that can't reach ``need`` are popped together, and their lists go on at the least position that can.
        """
        post = self.listed
        at, stop = self.begin[lists].tolist(), self.end[lists].tolist()
        heap = [(post[a], i) for i, a in enumerate(at)]
        heapq.heapify(heap)
        cand, count = [], []
        while len(heap) >= need:
            first, out = heap[0][0], []
            while heap and heap[0][0] == first:
                out.append(heapq.heappop(heap)[1])
            if len(out) >= need:
                cand.append(first)
                count.append(len(out))
                goal = first + 1
            else:
                while heap and len(out) < need - 1:
                    out.append(heapq.heappop(heap)[1])
                if not heap:
                    break
                goal = heap[0][0]
            for i in out:
                a = at[i] = bisect_left(post, goal, at[i], stop[i])
                if a < stop[i]:
                    heapq.heappush(heap, (post[a], i))
        return np.array(cand, np.int64), np.array(count, np.int64)

    def search(self, query: np.ndarray, size: int | None = None) -> np.ndarray:
        """Positions of the sets that link with ``query``, which has ``size`` elements as a whole set."""
        size = len(query) if size is None else size
        needs = -(-((100 + self.t) * len(query) - (100 - self.t) * size + self.excess) // (2 * (100 + self.t)))
        fits = (100 * np.minimum(self.size, size) >= self.t * np.maximum(self.size, size)) & (needs <= np.minimum(self.held, len(query)))
        sure = np.flatnonzero(fits & (needs <= 0))
        fits &= needs > 0
        if not fits.any():
            return sure
        need = int(needs[fits].min())  # the least overlap that any linked set can have
        at = np.searchsorted(self.token, query)
        inside = at < len(self.token)
        at, wanted = at[inside], query[inside]
        at = at[self.token[at] == wanted]
        if len(at) < need:
            return sure
        length = self.end[at] - self.begin[at]
        at = at[np.argsort(length, kind="stable")]
        top = int(length.max())
        n_long = min(need - 1, int(need / (0.01 * np.log2(top + 1) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        cand, count = self.merge(short, need - n_long)
        keep = fits[cand] & (count + len(long) >= needs[cand])
        cand, count = cand[keep], count[keep]
        while len(cand) and len(long):  # binary probes of the long lists, several lists at once
            step = max(8, (1 << 17) // len(cand))
            now, long = long[:step], long[step:]
            wanted = (now[:, None] * len(self.sets) + cand[None, :]).ravel()
            spot = np.searchsorted(self.probe, wanted)
            hit = self.probe[np.minimum(spot, len(self.probe) - 1)] == wanted
            count = count + hit.reshape(len(now), len(cand)).sum(0)
            alive = count + len(long) >= needs[cand]
            cand, count = cand[alive], count[alive]
        return np.concatenate([sure, cand])  # all lists are counted, so these have as many in common as they need


#: A family has so many sets at least; so many sets are tried as leaders; least rows of a band and growth of its overlap.
FAMILY, LEADERS, BAND_ROWS, BAND_STEP = 32, 16, 64, 16


def families(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The family of each set (-1: none), and each family's center: what most of its sets hold.

    A leader is the set whose elements are the most common ones; its family are the sets that have more than half in common.
    """
    family, centers = np.full(len(sets), -1), []
    if len(sets) < FAMILY:
        return family, centers
    size = np.array([len(s) for s in sets], np.int64)
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(sets)), size)
    tried = np.zeros(len(sets), bool)

    def alike(held):
        shared = np.bincount(owner[held[at]], minlength=len(sets))
        return (family < 0) & (2 * shared > np.maximum(size, held.sum()))

    for _ in range(LEADERS):
        common = np.bincount(at[family[owner] < 0], minlength=len(token))
        mean = np.where((family < 0) & ~tried, np.bincount(owner, common[at], len(sets)) / np.maximum(size, 1), 0)
        leader = int(mean.argmax())
        if mean[leader] < 2:
            break
        tried[leader] = True
        held = np.zeros(len(token), bool)
        held[at[begin[leader] : begin[leader] + size[leader]]] = True
        kin = alike(held)
        if kin.sum() < FAMILY:
            continue
        held = 2 * np.bincount(at[kin[owner]], minlength=len(token)) > kin.sum()
        kin = alike(held)
        if kin.sum() >= FAMILY:
            family[kin] = len(centers)
            centers.append(token[held])
    return family, centers


class Block:
    """The sets of a block.  Near copies of one text are indexed by their differences from what most of them hold: these
    are few and in short lists, while lists of what they hold are as long as the family and no skip shortens them.
    Lists are kept in bands of sets that need about as much overlap."""

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.sets = sets
        family, centers = families(sets)
        self.bands: list[tuple[int, np.ndarray, InvertedLists]] = []
        self.centers = [np.zeros(0, U), *centers]
        order = []
        for k, center in enumerate(self.centers):
            member = np.flatnonzero(family == k - 1)
            size = np.array([len(sets[i]) for i in member], np.int64)
            parts = [self.apart(sets[i], center) for i in member]
            need = ((100 + threshold) * np.array([len(x) for x in parts], np.int64) - (100 - threshold) * size) // (2 * (100 + threshold))
            rank = np.argsort(need, kind="stable")
            order.append(member[rank] if k else member)
            cuts = [0]
            for i in range(len(rank)):
                if i - cuts[-1] >= BAND_ROWS and need[rank[i]] - need[rank[cuts[-1]]] >= BAND_STEP:
                    cuts.append(i)
            for a, b in zip(cuts, [*cuts[1:], len(rank)], strict=True):
                if b > a:
                    some = np.sort(rank[a:b])
                    self.bands.append((k, member[some], InvertedLists([parts[i] for i in some], threshold, size[some])))
        #: The sets nearest to the centers of the largest families first, then those without a family.
        self.order = np.concatenate([*sorted(order[1:], key=len, reverse=True), order[0]])

    @staticmethod
    def apart(s: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.setxor1d(s, center, assume_unique=True) if len(center) else s

    def search(self, query: np.ndarray) -> np.ndarray:
        """Positions of the sets that link with ``query``."""
        apart = {k: self.apart(query, self.centers[k]) for k in {k for k, _, _ in self.bands}}
        return np.concatenate([np.zeros(0, np.int64), *(member[lists.search(apart[k], len(query))] for k, member, lists in self.bands)])


def link_block(ids: np.ndarray, sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """A spanning set of links of a block."""
    block = Block(sets, threshold)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, root = [], int(block.order[0])
    for i in block.order.tolist():
        if i != root and find(i) == find(root):
            continue
        for j in block.search(sets[i]).tolist():
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _search(n: int, threshold: int):
    """Rows sorted by block; one block is held at a time."""

    def run(batches):
        key, ids, sets = None, [], []

        def done():
            links = link_block(np.array(ids, np.int64), sets, threshold)
            return pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in slices(batches):
            found = shingle_sets(batch.column("text"), n)
            for block, doc, s in zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), found, strict=True):
                if block != key:
                    if ids:
                        yield done()
                    key, ids, sets = block, [], []
                ids.append(doc)
                sets.append(s)
        if ids:
            yield done()

    return run


def _probe(threshold: int):
    """Rows sorted by part (head, salt), members before queries; all links of the queries with the members of their part.
    One part is held at a time."""

    def run(batches):
        key, ids, sets, block = None, [], [], None
        for batch in slices(batches, "grams"):
            found: list[tuple[int, int]] = []
            for head, salt, query, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("head", "salt", "query", "id", "grams")), strict=True):
                if (head, salt) != key:
                    key, ids, sets, block = (head, salt), [], [], None
                if not query:
                    ids.append(doc)
                    sets.append(np.frombuffer(raw, U))
                    continue
                block = block or Block(sets, threshold)
                found += [(doc, ids[j]) for j in block.search(np.frombuffer(raw, U)).tolist() if ids[j] != doc]
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _hashed_sets(n: int):
    def run(batches):
        for batch in slices(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), n)]
            yield pa.record_batch([*(batch.column(c) for c in ("head", "salts", "pivot", "id")), pa.array(sets, pa.binary())], ["head", "salts", "pivot", "id", "grams"])

    return run


def _large_stars(stars: DataFrame, known: DataFrame, n: int, threshold: int, block_rows: int, parts: int) -> DataFrame:
    """Links of stars (head, id, keys, size) of more than ``block_rows`` documents."""
    central = stars.groupBy("head").agg(F.max_by("id", F.struct("keys", -F.col("id"))).alias("pivot"), F.ceil(F.count("*") / block_rows).cast("int").alias("salts"))
    held = stars.select("head", "id").join(central, "head").join(known.hint("shuffle_hash"), "id").select("head", "salts", "pivot", "id", "text")
    held = stored(held.mapInArrow(_hashed_sets(n), "head long, salts int, pivot long, id long, grams binary"), "stars")
    member = held.select("head", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("query"), "id", "grams")

    def asked(rows):
        every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
        todo = member.union(rows.select("head", every.alias("salt"), F.lit(True), "id", "grams"))
        return todo.repartition(parts, "head", "salt").sortWithinPartitions("head", "salt", "query", "id").mapInArrow(_probe(threshold), "a long, b long")

    first = stored(asked(held.where("id = pivot")), "pivots")
    beside = first.join(central.select("head", F.col("pivot").alias("a")), "a").select("head", F.col("b").alias("id"))
    rest = held.where("id <> pivot").join(beside, ["head", "id"], "left_anti")
    return first.union(asked(rest)) if rest.limit(1).count() else first


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: int = 90, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, n_shingles, component_id)`` per document; ``threshold`` is the least Jaccard similarity in hundredths."""
    ship(texts=True)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = src.where("id is not null")
    keyed = known.mapInArrow(_keyed(n, threshold), "k1 long, k2 long, kind long, a long, b long")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = stored(
        keyed.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "kind", "a")
        .mapInArrow(_groups, "a long, b long, n long, tag long, key long, size long"),
        "groups",
    )
    sets = groups.where("n >= 0").groupBy("b").agg(F.min("a").alias("rep"), F.max("n").alias("n"), F.count("*").alias("rows"))
    # a linked pair shares `tag` keys at least, so it also shares one that is not among the tag - 1 most common of either
    ranked = groups.where("n < 0").groupBy("b", "tag").agg(F.sort_array(F.collect_list(F.struct("size", "key", "a"))).alias("k"))
    kept = F.greatest(F.size("k") - F.col("tag").bitwiseAND(0xFFFFFFFF).cast("int") + 1, F.lit(0))
    near = ranked.select(F.explode(F.slice("k", 1, kept)).alias("k"), "b").groupBy("k.a", "b").agg(F.count("*").alias("keys"))
    rep = sets.select("b", "rep")
    met = (
        near.join(rep, "b").select("a", F.col("rep").alias("y"), "keys").join(rep, F.col("a") == rep.b).select(F.col("rep").alias("x"), "y", "keys")
        .groupBy("x", "y").agg(F.max("keys").alias("keys"))
    )
    met = stored(met, "met")
    coarse = connected_components(met.where("x <> y"), "x", "y")
    sized = coarse.groupBy("component").agg(F.count("*").alias("members"))
    blocks = stored(coarse.join(sized, "component").select(F.col("node").alias("id"), F.col("component").alias("block"), "members"), "blocks")
    small = blocks.where(F.col("members") <= block_rows).select("id", "block")
    large = None
    if blocks.where(F.col("members") > block_rows).limit(1).count():
        heads = blocks.where(F.col("members") > block_rows).select(F.col("id").alias("head"))
        around = met.join(heads, F.col("x") == F.col("head")).select("head", F.col("y").alias("id"), "keys")
        around = around.union(heads.select("head", "head", F.lit(0).cast("long"))).groupBy("head", "id").agg(F.max("keys").alias("keys"))
        wide = around.groupBy("head").agg(F.count("*").alias("size")).where("size > 1")
        stars = stored(around.join(wide, "head"), "around")
        small = small.union(stars.where(F.col("size") <= block_rows).select("id", "head"))
        wide = stars.where(F.col("size") > block_rows)
        if wide.limit(1).count():
            large = _large_stars(wide, known, n, threshold, block_rows, parts)
    todo = known.join(small.hint("shuffle_hash"), "id").select("block", "id", "text")
    links = todo.repartition(parts, "block").sortWithinPartitions("block", "id").mapInArrow(_search(n, threshold), "a long, b long")
    links = links if large is None else links.union(large)
    fine = connected_components(stored(links, "links"))
    out = sets.join(fine.select(F.col("node").alias("rep"), "component"), "rep", "left")
    labelled = out.select(F.col("b").alias("id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), "rows")
    labelled = labelled.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows", "copy")
    return labelled


def _sizes_only(n: int):
    def run(batches):
        for batch in slices(batches):
            size = [len(s) for s in shingle_sets(batch.column("text"), n)]
            yield pa.record_batch([batch.column("id"), pa.array(size, pa.int64()), pa.nulls(len(size), pa.int64())], ["id", "n_shingles", "component_id"])

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: int = 90, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As ``jaccard_classes``, with the rows of null ids too, and for ids of any type."""
    ship(texts=True)
    kind = docs.schema[id_col].dataType
    whole = isinstance(kind, T.IntegralType)
    named = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    src = docs.select(named.alias("id"), F.col(text_col).alias("text"), F.col(id_col).alias("name"))
    found = jaccard_classes(src, "id", "text", n, threshold, block_rows)
    lost = src.where("id is null").select("id", "text").mapInArrow(_sizes_only(n), "id long, n_shingles long, component_id long")
    if whole:
        return found.union(lost)
    found = stored(found, "classes").join(src.where("id is not null").select("id", "name").distinct(), "id")
    lowest = found.groupBy("component_id").agg(F.min("name").alias("lowest"))
    found = found.join(lowest, "component_id").select(F.col("name").alias("id"), "n_shingles", F.col("lowest").alias("component_id"))
    return found.union(lost.select(F.lit(None).cast(kind), "n_shingles", F.lit(None).cast(kind)))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT r, r AS node FROM d UNION SELECT reach.r, b FROM reach JOIN links ON a = node),
lowest AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = node GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN lowest USING (r)
"""

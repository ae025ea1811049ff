"""Operator 1: benchmark decontamination by latent semantic retrieval.

Passages of ``width`` words are TF-IDF vectors over hashed words, without case and ASCII punctuation.

1. Document frequencies over all passages of the corpus: one fixed table of ``BUCKETS`` counts per task, summed.
2. Distributed randomised SVD of the TF-IDF matrix of all passages and the benchmark's, in ``COLUMNS`` hashed columns:
   each task returns its part of the sketch A'(A W), of columns x (``rank`` + ``spare``) numbers.  The basis has ``rank``
   vectors, fewer than the benchmark has passages, so words that occur together are drawn together.
3. Candidates: passages (every ``stride`` words) whose cosine with a passage of an item in latent space, where both have
   length 1, is ``cosine`` or more, and which hold ``loose`` of its words.  Long items are cut in passages too.
   Besides, every region of a document that can pass the first rule of step 4 at all: of an item's words the rarest are
   looked up by hash, as many as an accepted span may lack and ``least`` more, and a region needs ``least`` of them
   within twice the item's length.  Frequencies only order the words here, so this path loses nothing, however common
   an item's words became with the copies of a document, and however far a text is from every passage.
4. Longest common subsequence of the words of item and candidate (a passage with its neighbourhood) over the item's
   words, in a span at most twice the item's length.  A hit has ``overlap`` or more and, below ``exact``, its answer: the
   item's last ``answer`` words share a common subsequence of half their number with the span.  A paraphrase further off
   is a hit if latent space found it, it has ``loose`` or more, and all but one of the answer's words are in order within
   twice the answer's length.
   A hit's cosine is that of the latent candidate, or without one that of item and span as TF-IDF vectors.

Benchmark items are loaded on the driver in blocks of ``ITEMS`` passages (or one item); further blocks are further passes.
Defined results: null or empty texts and items match nothing; items of fewer than ``min_words`` words count verbatim
only, those of fewer than ``LEAST_WORDS`` not at all (too short to tell); repeated rows each give their hits, equal items
of one id give one; of equally good spans the first counts; ids of any type, null included, are carried as they are;
extra columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from .textkit import Words, mix, slices

U = np.uint64
BUCKETS, CHUNK, COLUMNS = 1 << 18, 1 << 13, 1 << 13
WIDTH, STRIDE, RANK, SPARE, ITEMS, LEAST_WORDS, STEP = 32, 16, 64, 8, 1000, 4, 64


def _words(texts: pa.Array) -> Words:
    """Words without case and ASCII punctuation."""
    return Words(pc.utf8_lower(texts), bare=True)


def _passages(w: Words, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and end word of every passage; the last one of a document ends at its end."""
    n = np.diff(w.off)
    many = np.where(n == 0, 0, np.maximum(1, -(-(n - width) // stride) + 1))
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    begin = w.off[:-1][doc] + k * stride
    return doc, begin, np.minimum(begin + width, w.off[1:][doc])


def _terms(bucket: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, bucket) pairs with their term frequency."""
    size = end - begin
    row = np.repeat(np.arange(len(begin)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + begin[row]
    key = np.sort(row * BUCKETS + bucket[at])
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first] // BUCKETS, key[first] % BUCKETS, np.diff(np.append(first, len(key)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h + U(5)) & U(BUCKETS - 1)).astype(np.int64)


def _frequencies(width: int, stride: int):
    def run(batches):
        df, passages = np.zeros(BUCKETS, np.int64), 0
        for b in slices(batches):
            w = _words(b.column("text"))
            _, begin, end = _passages(w, width, stride)
            _, term, _ = _terms(_bucket(w.hash), begin, end)
            df += np.bincount(term, minlength=BUCKETS)
            passages += len(begin)
        if passages:
            parts = [df[i : i + CHUNK].tobytes() for i in range(0, BUCKETS, CHUNK)]
            yield pa.record_batch([pa.array([-1, *range(len(parts))], pa.int32()), pa.array([np.array([passages]).tobytes(), *parts], pa.binary())], ["part", "sums"])

    return run


def _summed(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Add up the equally long arrays of each part, streaming, one sum a part held; returns the table's few parts."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(raw, kind)
                total[k] = total[k] + x if k in total else x
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "sums"])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.repartition(n, "part").mapInArrow(add, "part int, sums binary").collect()  # a fixed table
    return {r["part"]: np.frombuffer(r["sums"], kind) for r in rows}


def _vectors(w: Words, begin: np.ndarray, end: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows of passages as (row, column, value)."""
    row, term, tf = _terms(_bucket(w.hash), begin, end)
    value = (1 + np.log(np.arange(1, int(tf.max(initial=0)) + 1))).astype(np.float32)[tf - 1] * idf[term]
    norm = np.sqrt(np.bincount(row, value**2, len(begin)))
    return row, term & (COLUMNS - 1), (value / np.maximum(norm[row], 1e-9)).astype(np.float32)


class _Items:
    """Words of the items, and their passages as TF-IDF rows."""

    def __init__(self, texts: list[str], idf: np.ndarray, width: int, stride: int, min_words: int):
        w = _words(pa.array(texts, pa.string()))
        self.words = [w.hash[a:b] for a, b in zip(w.off[:-1], w.off[1:], strict=True)]
        self.use = np.array([len(x) >= LEAST_WORDS for x in self.words], bool)
        self.verbatim = np.array([len(x) < min_words for x in self.words], bool)
        self.owner, begin, end = _passages(w, width, stride)
        row, col, value = _vectors(w, begin, end, idf)
        self.rows = np.zeros((len(begin), COLUMNS), np.float32)
        np.add.at(self.rows, (row, col), value)
        self.holds = np.zeros((len(begin), COLUMNS + 1), bool)  # the column beyond the last is in no passage
        self.holds[:, :COLUMNS] = self.rows > 0
        self.size = np.bincount(row, minlength=len(begin))


def _padded(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns and values of sparse rows (sorted by row) in segments of ``width``, and how many segments each row has.

    What a segment lacks are zeros in a column beyond the last."""
    many = np.bincount(row, minlength=n)
    parts = -(-many // width)
    at = np.arange(len(row)) + np.repeat((np.cumsum(parts) - parts) * width - np.cumsum(many) + many, many)
    cols, values = np.full(int(parts.sum()) * width, COLUMNS, np.int32), np.zeros(int(parts.sum()) * width, np.float32)
    cols[at], values[at] = col, value
    return cols.reshape(-1, width), values.reshape(-1, width), parts


def _rows(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one segment a row, of a multiple of eight columns."""
    return _padded(row, col, value, n, -(-int(np.bincount(row).max()) // 8) * 8)[:2]


def _times(cols: np.ndarray, values: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Segments times a dense matrix."""
    out = np.empty((len(cols), matrix.shape[1]), np.float32)
    step = max(1, (STEP * WIDTH) // cols.shape[1])
    for a in range(0, len(cols), step):  # rows whose products fit a core's cache
        part = matrix.take(cols[a : a + step], 0, mode="clip")
        np.matmul(values[a : a + step, None, :], part, out=out[a : a + step, None, :])
    return out


def _sketch(shared, width: int):
    def run(batches):
        idf, test = shared.value
        got = np.zeros(test.shape, np.float32)
        some = False
        for b in slices(batches):
            w = _words(b.column("text"))
            _, begin, end = _passages(w, width, width)
            if not len(begin):
                continue
            some = True
            row, col, value = _vectors(w, begin, end, idf)
            y = _times(*_rows(row, col, value, len(begin)), test)
            order = np.argsort(col.astype(np.int16), kind="stable")
            rows, values, parts = _padded(col[order], row[order], value[order], len(test), 8)
            held = np.flatnonzero(parts)
            got[held] += np.add.reduceat(_times(rows, values, y), (np.cumsum(parts) - parts)[held])
        if some:
            yield pa.record_batch([pa.array(np.arange(len(got), dtype=np.int32)), pa.array([x.tobytes() for x in got], pa.binary())], ["part", "sums"])

    return run


def latent(rows: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Projected rows, scaled to length 1."""
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9) if len(rows) else rows.reshape(0, basis.shape[1])


def near_passages(passages: np.ndarray, cols: np.ndarray, items: _Items, places: np.ndarray, cosine: float, loose: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, passage of an item, cosine) of the candidates; ``cols`` are the columns of the passages' words."""
    holds, out = items.holds.ravel(), []
    for a in range(0, len(places), 1024):
        near = passages @ places[a : a + 1024].T
        flat = np.flatnonzero(near >= cosine)
        p, i = np.divmod(flat, near.shape[1])
        got = near.ravel()[flat]
        i += a
        for z in range(0, len(p), 1 << 13):
            q, j = p[z : z + (1 << 13)], i[z : z + (1 << 13)]
            hit = holds.take(cols[q] + (j * (COLUMNS + 1))[:, None])
            both = np.bitwise_count(hit.view(np.uint64)).sum(1, dtype=np.int32)  # bytes of one bit
            keep = both >= loose * items.size[j]
            out.append((q[keep], j[keep], got[z : z + (1 << 13)][keep]))
    return tuple(np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, np.int64, np.float32), zip(*out, strict=True) if out else ((), (), ()), strict=True))


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, a bit-parallel row at a time."""
    masks: dict[int, int] = {}
    for i, h in enumerate(item.tolist()):
        masks[h] = masks.get(h, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for h in text.tolist():
        m = masks.get(h)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _best_span(item: np.ndarray, text: np.ndarray, least: float = 1) -> tuple[int, int, int]:
    """(common words, begin, end) of the first best span of at most twice the item's words, with ``least`` in common."""
    span = 2 * len(item)
    begin = np.arange(0, max(1, len(text) - span // 2), max(1, len(item) // 2))
    end = np.minimum(begin + span, len(text))
    sorted_item = np.sort(item)
    held = np.append(0, np.cumsum(sorted_item[np.minimum(np.searchsorted(sorted_item, text), len(item) - 1)] == text))
    bound = held[end] - held[begin]  # no span has more in common than words of the item
    best = (0, 0, 0)
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] < max(least, best[0]):
            break
        n = common_subsequence(item, text[begin[k] : end[k]])
        if n > best[0] or n == best[0] and n and begin[k] < best[1]:
            best = (n, int(begin[k]), int(end[k]))
    return best


def _rarest(words: list[np.ndarray], use: np.ndarray, verbatim: np.ndarray, df: np.ndarray, overlap: float) -> tuple[np.ndarray, ...]:
    """The rarest words of every item, as arrays for ``_regions``."""
    size = np.array([len(x) for x in words], np.int64)
    need = np.where(verbatim, size, np.ceil(overlap * size).astype(np.int64))
    least = np.clip(size // 8, 1, np.maximum(need, 1))
    few = [x[np.argsort(df[_bucket(x)], kind="stable")[: n - m + k]] if u else x[:0] for x, n, m, k, u in zip(words, size, need, least, use, strict=True)]
    few = [np.unique(x) for x in few]
    h, item = np.concatenate([np.zeros(0, U), *few]), np.repeat(np.arange(len(words)), [len(x) for x in few])
    order = np.argsort(h, kind="stable")
    key, begin, many = np.unique(h[order], return_index=True, return_counts=True)
    held = np.zeros(BUCKETS, bool)
    held[_bucket(key)] = True
    return size, need, least, held, key, begin, many, item[order]


def _regions(w: Words, rare: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, item, first and end word of every region with enough of an item's rarest words; those that meet are one."""
    size, _, least, held, key, begin, many, items = rare
    at = np.flatnonzero(held[_bucket(w.hash)])
    k = np.minimum(np.searchsorted(key, w.hash[at]), max(len(key) - 1, 0))
    same = key[k] == w.hash[at]
    at, k = at[same], k[same]
    step = np.arange(int(many[k].sum())) - np.repeat(np.cumsum(many[k]) - many[k], many[k])
    pos, item = np.repeat(at, many[k]), items[np.repeat(begin[k], many[k]) + step]
    group = (np.searchsorted(w.off, pos, "right") - 1) * len(size) + item
    order = np.argsort(group, kind="stable")
    group, pos, item = group[order], pos[order], item[order]
    last = np.arange(len(pos)) + least[item] - 1
    full = last < len(pos)
    last = np.minimum(last, len(pos) - 1)
    span = 2 * size[item]
    near = full & (group[last] == group) & (pos[last] - pos < span)
    lo, hi, group, item = (pos[last] - span + 1)[near], (pos + span)[near], group[near], item[near]
    doc = group // len(size)
    lo, hi = np.maximum(lo, w.off[doc]), np.minimum(hi, w.off[doc + 1])
    new = np.ones(len(lo), bool)
    new[1:] = (group[1:] != group[:-1]) | (lo[1:] > hi[:-1])
    return doc[new], item[new], lo[new], hi[np.append(new, True)[1:]]


def plain_cosine(x: np.ndarray, y: np.ndarray, idf: np.ndarray) -> float:
    """Cosine of two word sequences as TF-IDF vectors."""
    (a, m), (b, n) = np.unique(_bucket(x), return_counts=True), np.unique(_bucket(y), return_counts=True)
    p, q = (1 + np.log(m)) * idf[a], (1 + np.log(n)) * idf[b]
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return float(min(1.0, (p[i] * q[j]).sum() / max(np.sqrt((p * p).sum() * (q * q).sum()), 1e-9)))


def _search(shared, width: int, stride: int, cosine: float, overlap: float, exact: float, loose: float, answer: int, id_type: pa.DataType):
    def run(batches):
        idf, basis, items, places, rare, ids = shared.value
        words, need = items.words, rare[1]
        sets = [set(x.tolist()) for x in words]
        answers = [x[-answer:] for x in words]
        told = [set(x.tolist()) for x in answers]

        def has(i, said, least):
            """Whether ``least`` words of the item can be there: its distinct words, and the times that it repeats some."""
            return len(sets[i].intersection(said)) >= least - (len(words[i]) - len(sets[i]))

        def held_by(i, text):
            """(share of the item, span) where the text holds the item itself."""
            item = words[i]
            if items.verbatim[i]:
                for a in np.flatnonzero(text[: max(0, len(text) - len(item) + 1)] == item[0]).tolist():
                    if (text[a : a + len(item)] == item).all():
                        return 1.0, text[a : a + len(item)]
                return None
            n, a, z = _best_span(item, text, overlap * len(item))
            if n < overlap * len(item) or n < exact * len(item) and 2 * common_subsequence(answers[i], text[a:z]) < len(answers[i]):
                return None
            return n / len(item), text[a:z]

        def told_by(i, text):
            """The same where the text has the answer and less of the item."""
            n, a, z = _best_span(words[i], text, loose * len(words[i]))
            if n < loose * len(words[i]) or _best_span(answers[i], text[a:z])[0] < len(answers[i]) - 1:
                return None
            return n / len(words[i]), text[a:z]

        for b in slices(batches):
            w = _words(b.column("text"))
            doc, begin, end = _passages(w, width, stride)
            hits: dict[tuple[int, int], tuple[float, float]] = {}
            near: dict[tuple[int, int], float] = {}
            places_of: dict[tuple[int, int], list] = {}
            if len(doc):
                cols, values = _rows(*_vectors(w, begin, end, idf), len(doc))
                passages = latent(_times(cols, values, basis), basis)
                for p, j, cos in zip(*(x.tolist() for x in near_passages(passages, cols, items, places, cosine, loose)), strict=True):
                    i, d = int(items.owner[j]), int(doc[p])
                    if not items.use[i] or items.verbatim[i]:
                        continue
                    lo, hi = max(w.off[d], begin[p] - 2 * len(words[i])), min(w.off[d + 1], end[p] + 2 * len(words[i]))
                    near[d, i] = max(near.get((d, i), 0.0), cos)
                    places_of.setdefault((d, i), []).append((int(lo), int(hi)))
            for (d, i), spans in places_of.items():
                for lo, hi in merged(spans):
                    text = w.hash[lo:hi]
                    said = text.tolist()
                    at, k = [x for x, h in enumerate(said) if h in told[i]], len(answers[i]) - 2
                    if any(z - a < 2 * len(answers[i]) for a, z in zip(at, at[k:], strict=False)):  # the answer may be there
                        got = told_by(i, text)
                    elif has(i, said, exact * len(words[i])):
                        got = held_by(i, text)
                    else:
                        continue
                    if got and got[0] > hits.get((d, i), (0, 0))[1]:
                        hits[d, i] = (near[d, i], got[0])
            for d, i, lo, hi in zip(*(x.tolist() for x in _regions(w, rare)), strict=True):
                text = w.hash[lo:hi]
                if hits.get((d, i), (0, 0))[1] >= exact or not has(i, text.tolist(), need[i]):
                    continue
                got = held_by(i, text)
                if got and got[0] > hits.get((d, i), (0, 0))[1]:
                    hits[d, i] = (near.get((d, i)) or plain_cosine(words[i], got[1], idf), got[0])
            at = pa.array([d for d, _ in hits], pa.int64())
            cols = [b.column("doc_id").take(at), pa.array([ids[i] for _, i in hits], id_type)]
            cols += [pa.array([x[k] for x in hits.values()], pa.float64()) for k in (0, 1)]
            yield pa.record_batch(cols, ["doc_id", "item_id", "cosine", "overlap"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that meet are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def leading(items: np.ndarray, sketch: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of [benchmark rows; passages] from the one-pass sketch of the passages.

    Nystrom form of the randomised SVD: with Y = C W for C = M'M, C is close to Y (W'Y)^-1 Y'.
    """
    y = sketch + items.T @ (items @ test)
    shift = 1e-6 * np.linalg.norm(y) + 1e-12
    y = y + shift * test
    inner = test.T @ y
    lower = np.linalg.cholesky((inner + inner.T) / 2 + shift * np.eye(len(inner)))
    u, s, _ = np.linalg.svd(np.linalg.solve(lower, y.T).T, full_matrices=False)
    kept = max(1, min(rank, int((s**2 > 4 * shift).sum())))
    return np.ascontiguousarray(u[:, :kept], dtype=np.float32)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, stride: int = STRIDE, rank: int = RANK, spare: int = SPARE, cosine: float = 0.6, overlap: float = 0.6, exact: float = 0.8, loose: float = 0.35, answer: int = 6, min_words: int = 8) -> DataFrame:
    """``(doc_id, item_id, cosine, overlap)`` per document and benchmark item that it holds."""
    ship(texts=True)
    spark = docs.sparkSession
    src = docs.select("doc_id", "text").where("text is not null")
    whole = isinstance(items.schema["item_id"].dataType, T.IntegralType)
    known = items.select(F.col("item_id").cast("long") if whole else "item_id", F.col("text").cast("string")).where("text is not null").distinct()
    id_type = known.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {id_type.simpleString()}, cosine double, overlap double"
    df = _summed(src.select("text").mapInArrow(_frequencies(width, width), "part int, sums binary"), "<i8")
    passages = int(df[-1][0]) if df else 0
    counts = np.concatenate([df[k] for k in sorted(df) if k >= 0]) if df else np.zeros(BUCKETS, np.int64)
    idf = (np.log((passages + 1) / (counts + 1.0)) + 0.1).astype(np.float32)

    def search(block):
        found = _Items([r["text"] for r in block], idf, width, stride, min_words)
        n = max(1, min(rank, len(found.rows) - 1))
        test = np.linalg.qr(np.random.default_rng(11).normal(size=(COLUMNS, n + spare)))[0].astype(np.float32)
        shared = spark.sparkContext.broadcast((idf, test))  # tables of a fixed size
        sketch = np.zeros(test.shape)
        for j, x in _summed(src.select("text").mapInArrow(_sketch(shared, width), "part int, sums binary"), "<f4").items():
            sketch[j] = x
        basis = leading(found.rows, sketch, test.astype(float), n)
        places = latent(found.rows @ basis, basis)
        del found.rows
        rare = _rarest(found.words, found.use, found.verbatim, counts, overlap)
        # fixed tables, and of ITEMS passages (or one item) the words, bits and latent rows
        ready = spark.sparkContext.broadcast((idf, basis, found, places, rare, [r["item_id"] for r in block]))
        return src.mapInArrow(_search(ready, width, stride, cosine, overlap, exact, loose, answer, to_arrow_type(id_type)), schema)

    block, size, out = [], 0, None
    for r in known.orderBy("item_id", "text").toLocalIterator():
        many = len(r["text"].split()) // stride + 1
        if block and size + many > ITEMS:
            out, block, size = search(block) if out is None else out.union(search(block)), [], 0
        block.append(r)
        size += many
    if block:
        out = search(block) if out is None else out.union(search(block))
    return spark.createDataFrame([], schema) if out is None else out


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items)

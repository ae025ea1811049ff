"""Operators 3 and 9 against brute force, with nulls, empty and long texts, repeated rows and hot groups."""

import collections
import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from moraine.llm import jaccard
from moraine.llm.jaccard import InvertedLists, classes, jaccard_join, partitions, shingle_sets
from moraine.llm.substring import longest_matches, substring_dedup
from moraine.llm.textkit import Words, grams

import numpy as np
import pyarrow as pa

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    rows, passage = [], text(60)
    for i in range(n):
        kind = i % 6
        t = text(rng.randint(1, 150))
        if kind == 1 and rows:
            t = rows[rng.randrange(len(rows))][1] or ""
        elif kind == 2 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "x").split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        elif kind == 3:
            t = t + "\n" + passage + "\t" + text(20)
        rows.append((i, t))
    base = text(300).split()
    for k in range(40):  # a hot group of near copies
        w = list(base)
        w[k * 7] = "x%d" % k
        rows.append((n + k, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "  \n "), (903, "One Two"), (904, "one two"), (905, "the " * 500), (906, "The " * 400), (907, "é" * 9000), (908, text(3000))]
    return rows


def brute_jaccard(rows, n, t):
    sets, parent = {}, {}
    for i, x in rows:
        w = WORD.findall((x or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for p, i in enumerate(ids):
        for j in ids[:p]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= t * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n,t,block", [(3, 90, 4000), (5, 80, 4000), (3, 90, 4), (2, 60, 16)])
def test_jaccard_join(spark, n, t, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("id", F.lit("x")).repartition(5)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(df, n=n, threshold=t, block_rows=block).collect()}
    assert got == brute_jaccard(rows, n, t)


def test_jaccard_edges(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")]
    got = sorted(tuple(r) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).where("id is not null").collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert [tuple(r) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).where("id is null").collect()] == [(None, 2, None)]


def test_jaccard_of_sets_of_very_different_sizes(spark):
    words = ["w%d" % k for k in range(400)]
    rows = [(i, " ".join(words[:k])) for i, k in enumerate([100, 130, 160, 199, 230, 260, 330, 399])]
    for t in (50, 60, 70):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(spark.createDataFrame(rows[::3], "doc_id long, text string"), n=1, threshold=t).collect()}
        assert got == brute_jaccard(rows[::3], 1, t)


def test_jaccard_string_ids(spark):
    rows = [(f"id-{i:03d}", t) for i, t in corpus()] + [(None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(df).collect()}
    assert got.pop(None) == (2, None) and got == brute_jaccard(rows[:-1], 3, 90)


def test_jaccard_hot_stars_that_hardly_link(spark):
    """Near copies of a text that don't link with each other, and chains of them, in parts smaller than the star."""
    rng, base = random.Random(4), ["w%d" % k for k in range(200)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.choice((1, 2, 4, 6))):
            w[rng.randrange(200)] = "x%d" % rng.randrange(10**6)
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (7, 4000):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(df, block_rows=block).collect()}
        assert got == brute_jaccard(rows, 3, 90)


def test_partitions_cover_every_difference():
    for t in (60, 80, 90, 95):
        upper = classes(t, 5000)
        m, surplus = partitions(upper, t)
        assert (m - surplus > upper * (100 - t) // t).all() and (surplus > 0).all()


def test_search_matches_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40)).astype(np.uint64)) for _ in range(80)]
    index = InvertedLists(sets, 60)
    for q in sets + [np.unique(rng.integers(0, 90, 30).astype(np.uint64)) for _ in range(40)]:
        want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 60 * len(np.union1d(q, s))]
        assert sorted(index.search(q).tolist()) == want


def near_copies(rng, count, size=300, edits=(4, 30), run=5):
    """Sets made from one by replacing runs of its elements, as edits of a text do; about half link with none at 80."""
    base = rng.integers(1, 1 << 62, size).astype(np.uint64)
    out = []
    for _ in range(count):
        lost = np.zeros(size, bool)
        for a in rng.integers(0, size, rng.integers(*edits)):
            lost[a : a + run] = True
        out.append(np.unique(np.concatenate([base[~lost], rng.integers(1, 1 << 62, int(lost.sum())).astype(np.uint64)])))
    return out


def test_near_copies_are_linked_without_reading_all_they_share(monkeypatch):
    """Families of near copies of which most don't link, among other sets; work is counted in positions the heap gives out."""
    rng = np.random.default_rng(3)
    a, b = near_copies(rng, 400), near_copies(rng, 150, 500, (1, 60))
    sets = [*a, *b, *(np.unique(rng.integers(0, 3000, rng.integers(1, 200)).astype(np.uint64)) for _ in range(100)), *(np.append(x[:-30], x[-1]) for x in a[:20])]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    pops = []
    monkeypatch.setattr(jaccard.heapq, "heappop", lambda heap, pop=heapq.heappop: pops.append(1) or pop(heap))
    links = jaccard.link_block(np.arange(len(sets)), sets, 80)
    parent, want = list(range(len(sets))), list(range(len(sets)))

    def root(of, x):
        while of[x] != x:
            x = of[x]
        return x

    def join(of, x, y):
        x, y = sorted((root(of, x), root(of, y)))
        of[y] = x

    for x, y in links:
        join(parent, x, y)
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    held = np.zeros((len(sets), len(token)), np.float32)
    held[np.repeat(np.arange(len(sets)), size), at] = 1
    both = (held @ held.T).astype(int)
    linked = 100 * both >= 80 * (size[:, None] + size - both)
    for x, y in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
        join(want, x, y)
    assert [root(parent, x) for x in range(len(sets))] == [root(want, x) for x in range(len(sets))]
    assert len(pops) < len(sets) ** 2
    block = jaccard.Block(sets, 80)
    assert len(block.centers) > 2
    assert all(sorted(block.search(s).tolist()) == np.flatnonzero(linked[i]).tolist() for i, s in enumerate(sets))


def brute_windows(rows, width):
    seen, words = collections.Counter(), []
    for i, t in rows:
        w = WORD.findall(t or "")
        words.append((i, w))
        for k in range(len(w) - width + 1):
            seen[tuple(w[k : k + width])] += 1
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,seed,hot,words", [(35, 8, 2048, 1 << 18), (35, 8, 3, 200), (12, 5, 2048, 400), (12, 5, 2, 1 << 18)])
def test_substring_dedup(spark, width, seed, hot, words):
    rows = corpus(2) + [(3, None), (None, "x y"), (500, corpus(2)[3][1]), (500, corpus(2)[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("anchor", F.lit(1)).withColumn("spans", F.lit("s")).repartition(5)
    for heavy_rows in (8192, 3):
        got = sorted((tuple(r) for r in substring_dedup(df, width=width, seed=seed, hot=hot, block_words=words, heavy_rows=heavy_rows).collect()), key=str)
        assert got == brute_windows(rows, width)


def test_substring_string_and_null_ids(spark):
    rows = [(f"id-{i}" if i % 5 else None, t) for i, t in corpus(2)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    assert sorted((tuple(r) for r in substring_dedup(df).collect()), key=str) == brute_windows(rows, 35)


def test_substring_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_longest_matches():
    rng = np.random.default_rng(1)
    text, piece = rng.integers(0, 3, 120).astype(np.uint64), np.repeat(np.arange(6), 20)
    got = longest_matches(text, piece, 16)
    for i in range(120):
        best = 0
        for j in range(120):
            k = 0
            while j != i and i + k < 120 and j + k < 120 and piece[i + k] == piece[i] and piece[j + k] == piece[j] and text[i + k] == text[j + k]:
                k += 1
            best = max(best, k)
        assert min(got[i], 16) == min(best, 16)


def test_words_and_grams():
    texts = [r[1] for r in corpus(3)]
    w = Words(pa.array(texts, pa.string()))
    want = [x.encode() for t in texts for x in WORD.findall(t or "")]
    assert [bytes(w.data[s : s + n]) for s, n in zip(w.start, w.length, strict=True)] == want
    g, seen = grams(w.hash, 7), {}
    for k in range(len(g)):
        assert seen.setdefault(tuple(want[k : k + 7]), g[k]) == g[k]
    assert len(set(seen.values())) == len(seen)
    assert len(shingle_sets(pa.array([None, "a"], pa.string()), 3)[0]) == 0

"""Algebra of features and the heads, against known values, invariants and brute force."""

import numpy as np
import pytest

from moraine.functions import linalg
from moraine.functions.stats import chi2_quantile
from moraine.operators import kernels as K
from moraine.operators.prepare import budget_max_leaves


def blobs(seed=0, per=600):
    rng = np.random.default_rng(seed)
    centers = np.array([(0, 0), (9, 0), (0, 9), (9, 9)], float)
    return np.concatenate([rng.normal(c, 0.6, (per, 2)) for c in centers]), np.repeat(range(4), per)


def test_merge_known_values():
    f = K.Features.points(np.array([(1, 2, 3), (3, 4, 5), (5, 6, 7)], float)).merge(np.zeros(3, int), 1)
    assert f.n[0] == 3 and np.allclose(f.mean[0], (3, 4, 5)) and np.isclose(f.trace()[0], 24)
    full = K.Features.points(np.array([(0, 0), (1, 2), (2, 4)], float), full=True).merge(np.zeros(3, int), 1)
    assert np.allclose(full.s[0] / 3, [[2 / 3, 4 / 3], [4 / 3, 8 / 3]])


def test_merge_is_associative_and_stable():
    x = np.random.default_rng(1).normal(size=(500, 4)) + 1e8
    f = K.Features.points(x)
    whole = f.merge(np.zeros(500, int), 1)
    parts = f.merge(np.arange(500) % 7, 7).merge(np.zeros(7, int), 1)
    assert np.allclose(whole.s, parts.s, rtol=1e-6) and np.allclose(whole.s[0] / 500, x.var(0), rtol=1e-6)


@pytest.mark.parametrize("route", ["euclidean", "manhattan", "ward", "average"])
def test_compress_keeps_mass_and_bound(route):
    x, _ = blobs()
    f, _, rebuilds = K.compress(K.Features.points(x), 100, route=route)
    assert len(f) <= 100 and np.isclose(f.n.sum(), len(x)) and rebuilds
    assert np.allclose((f.n[:, None] * f.mean).sum(0) / len(x), x.mean(0))
    assert np.isclose(f.merge(np.zeros(len(f), int), 1).trace()[0], ((x - x.mean(0)) ** 2).sum())


def test_compress_follows_density_at_every_size():
    """Many rows keep their resolution beside a far row and beside a much wider axis."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.5, (5000, 2)) for c in ((0, 0), (10, 0), (0, 10), (10, 10))] + [np.array([[1e6, 1e6]])])
    y = np.append(np.repeat(range(4), 5000), 4)
    f, threshold, _ = K.compress(K.Features.points(x), 500)
    assert 450 <= len(f) <= 500 and np.isclose(f.n.sum(), len(x)) and threshold < 1
    f, _, _ = K.compress(f.join(K.Features.points(x)), 500, threshold)
    near = K.nearest(x, f.mean)[0]
    assert all(len(set(y[near == k])) <= 1 for k in range(len(f))) and np.isclose(f.n.sum(), 2 * len(x))
    wide = np.c_[rng.normal(0, 1000, 20000), rng.integers(0, 11, 20000) / 100, rng.integers(0, 9, 20000) / 100, rng.integers(1, 51, 20000)]
    assert len(K.compress(K.Features.points(wide), 2000)[0]) >= 1900
    same = np.repeat(rng.normal(size=(7, 3)) * 1e5 + 0.1, 1000, axis=0)
    assert len(K.compress(K.Features.points(same), 100)[0]) == 7


def test_nearest_matches_brute_force():
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    at, d = K.nearest(x, c)
    table = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (at == table.argmin(1)).all() and np.allclose(d, table.min(1))
    assert K.nearest(np.zeros((1, 2)), np.array([[1.0, 0], [0, 1.0]]))[0][0] == 0


def test_nearest_by_cells_is_that_of_all():
    rng = np.random.default_rng(9)
    for d in (1, 2, 4, 8):
        x = np.concatenate([rng.normal(size=(3000, d)), np.round(rng.normal(size=(2000, d)), 1), 50 * rng.normal(size=(5, d))])
        c = np.concatenate([x[rng.integers(0, 5000, 600)], np.round(rng.normal(size=(300, d)), 1), x[:50], np.full((1, d), 80.0)])
        at, dist = K.nearest(x, c)
        want, gap = K.nearest_of_all(x, c)
        assert (at == want).all() and np.allclose(dist, gap, rtol=1e-12, atol=0)


@pytest.mark.parametrize("method", ["kmeans", "gmm", "gmm-full", "ward", "hdbscan"])
def test_heads_find_blobs(method):
    from moraine.estimator import heads

    x, y = blobs()
    full = method == "gmm-full"
    f, _, _ = K.compress(K.Features.points(x, full), 300)
    labels, resp = heads(f, method, 4, 100, 0, min_cluster_size=8)
    found = labels[K.nearest(x, f.mean)[0]]
    assert K.adjusted_rand(found, y) > 0.95
    if resp is not None:
        assert (resp.argmax(1) == labels).all() and np.allclose(resp.sum(1), 1)


def test_automatic_k():
    x, _ = blobs()
    f, _, _ = K.compress(K.Features.points(x), 300)
    assert len(set(K.xmeans(f)[0])) == 4
    assert len(set(K.ward(f, 0))) == 4


def test_hdbscan_separates_moons():
    rng = np.random.default_rng(1)
    t = np.pi * rng.random(700)
    x = np.concatenate([np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)]]) + rng.normal(0, 0.06, (1400, 2))
    labels = K.hdbscan(K.Features.points(x), 5, 40)
    assert K.adjusted_rand(labels, np.repeat([0, 1], 700)) > 0.9


def test_ward_matches_brute_force():
    x = np.random.default_rng(3).normal(size=(25, 2))
    f = K.Features.points(x)
    groups = [[i] for i in range(25)]
    heights = []
    while len(groups) > 1:
        best = min((len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(best[0])
        groups[best[1]] = groups[best[1]] + groups.pop(best[2])
    assert np.allclose([h for h, _, _ in K.ward_merges(f)], sorted(heights))


def test_constraints():
    f = K.Features.points(np.array([[0.0], [0.1], [5.0], [5.1]]))
    labels = K.cop_kmeans(f, 2, [(0, 2)], [(0, 1)])
    assert labels[0] == labels[2] and labels[0] != labels[1]
    with pytest.raises(K.ContradictionError):
        K.cop_kmeans(f, 2, [(0, 1)], [(0, 1)])
    with pytest.raises(K.InfeasibleError):
        K.cop_kmeans(f, 2, [], [(0, 1), (1, 2), (0, 2)])


def test_kprototypes():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.4, (150, 2)), rng.normal(8, 0.4, (150, 2))])
    code = np.repeat([0, 1], 150)
    labels, mean, mode, _ = K.kprototypes(K.Mixed(K.Features.points(x), [np.eye(2)[code]]), 2, 1.0)
    assert K.adjusted_rand(labels, code) > 0.95 and mean.shape == (2, 2) and sorted(mode[:, 0]) == [0, 1]


def test_frequent_directions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 20))
    a = K.FrequentDirections(20, 10).add(x[:150]).merge(K.FrequentDirections(20, 10).add(x[150:]))
    assert np.allclose(a.covariance(), np.cov(x.T, bias=True), atol=1e-6 * np.abs(x).max() ** 2) and a.n == 400
    before = a.covariance()
    assert np.allclose(a.decay(0.5).covariance(), before) and a.n == 200


def test_bridges_and_spanning_tree():
    assert K.bridges(5, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (3, 4)]) == [3]
    x = np.random.default_rng(5).normal(size=(30, 2))
    core = K.core_distances(x, 3)
    edges = K.spanning_tree(x, core)
    d = np.maximum(np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), core[:, None]), core[None])
    total, root = 0.0, np.arange(30)
    for i, j in sorted(((i, j) for i in range(30) for j in range(i)), key=lambda p: d[p]):
        if root[i] != root[j]:
            total += d[i, j]
            root[root == root[i]] = root[j]
    assert np.isclose(sum(e[0] for e in edges), total)


@pytest.mark.parametrize("d,p,want", [(2, 0.95, 5.991465), (10, 0.99, 23.209251), (1, 0.95, 3.841459), (5, 0.5, 4.351460)])
def test_chi2(d, p, want):
    assert abs(chi2_quantile(d, p) - want) < 1e-3


def test_linear_algebra_and_budget():
    a = np.array([[4.0, 2], [2, 3]])
    low = linalg.cholesky_lower(a)
    assert np.allclose(linalg.inverse(low) @ a, np.eye(2)) and np.isclose(linalg.logdet(low), np.log(8))
    assert linalg.cholesky_lower(-a) is None and np.isclose(linalg.mahalanobis_sq(low, np.array([2.0, 2])), np.array([2.0, 2]) @ np.linalg.inv(a) @ np.array([2.0, 2]))
    assert budget_max_leaves(1e-6, 10, "spherical") == 33

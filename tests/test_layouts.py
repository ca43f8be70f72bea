"""The neighbour graph and the layouts against plain versions."""

import numpy as np
import pytest

from mapweave.operators import layout, neighbours, tsne
from mapweave.operators.pairwise import distances


def frame(spark, x, name="id"):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, vector array<double>").repartition(4)


def plain_nearest(x, k):
    d = distances(x, x, "cosine")
    np.fill_diagonal(d, np.inf)
    return [list(np.lexsort((np.arange(len(x)), d[i]))[:k]) for i in range(len(x))], d


def test_small_graph_is_exact(spark):
    x = np.random.default_rng(0).normal(size=(120, 9))
    x[50:60] = x[10:20]  # ties at no distance
    found = neighbours.nearest_graph(frame(spark, x), 7).toPandas()
    expected, d = plain_nearest(x, 7)
    got = found.sort_values(["id", "place"]).groupby("id")
    assert all(sorted(np.round(g.distance, 9)) == sorted(np.round(d[i, expected[i]], 9)) for i, g in got)
    assert set(found.place) == set(range(1, 8)) and (found.id != found.other).all()


def test_recall_without_structure(spark):
    """Unit vectors in all directions of 64 dimensions are the hardest case."""
    x = np.random.default_rng(5).normal(size=(2000, 64))
    found = neighbours.nearest_graph(frame(spark, x), 10, leaf=128).toPandas().groupby("id").other.apply(set)
    expected, _ = plain_nearest(x, 10)
    assert np.mean([len(found[i] & set(e)) / 10 for i, e in enumerate(expected)]) > 0.9


def test_graph_of_copies_and_few_rows(spark):
    x = np.ones((700, 3))
    found = neighbours.nearest_graph(frame(spark, x), 4, leaf=64).toPandas()
    assert len(found) == 2800 and found.distance.abs().max() < 1e-9
    assert neighbours.nearest_graph(frame(spark, x[:1]), 4).count() == 0
    assert neighbours.nearest_graph(frame(spark, x[:0]), 4).count() == 0
    assert neighbours.nearest_graph(frame(spark, x[:3]), 4).count() == 6


# -- t-SNE


def plain_affinities(d, k, perplexity):
    n, p = len(d), np.zeros_like(d)
    for i in range(n):
        near = np.argsort(d[i], kind="stable")[:k]
        squares = d[i, near] ** 2
        low, high = 0.0, 1e9
        for _ in range(200):
            b = (low + high) / 2
            w = np.exp(-(squares - squares.min()) * b)
            w /= w.sum()
            low, high = (b, high) if -(w * np.log(np.maximum(w, 1e-300))).sum() > np.log(perplexity) else (low, b)
        p[i, near] = w
    return (p + p.T) / (2 * n)


def plain_divergence(p, y):
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    q = 1 / (1 + d)
    np.fill_diagonal(q, 0)
    z, some = q.sum(), p > 0
    w = p * q - q * q / z
    return (p[some] * np.log(p[some] * z / q[some])).sum(), 4 * (w.sum(axis=1)[:, None] * y - w @ y)


def plain_layout(p, y, still):
    """All pairs, with the steps and the rest of the operator."""
    n, v, gains, seen = len(p), np.zeros_like(y), np.ones_like(y), []
    while len(seen) < 31 or seen[-11] - seen[-1] >= still * seen[-11]:
        seen.append(plain_divergence(p, y)[0])
        gradient = plain_divergence(p * (4 if len(seen) <= 20 else 1), y)[1]
        gains = np.maximum(0.01, np.where(np.sign(gradient) == np.sign(v), gains * 0.8, gains + 0.2))
        v = (0.5 if len(seen) <= 20 else 0.8) * v - n / 4 * gains * gradient
        y = y + v
    return seen[-1]


def groups(n, dims=8, seed=2):
    g = np.random.default_rng(seed)
    return g.normal(size=(8, dims))[np.arange(n) % 8] + 0.3 * g.normal(size=(n, dims))


def test_affinities_as_plain(spark):
    x = groups(60)
    near, d = plain_nearest(x, 15)
    rows = [(i, int(j), float(d[i, j])) for i in range(60) for j in near[i]]
    found = tsne.affinities(spark.createDataFrame(rows, "id long, other long, distance double"), 5.0).toPandas()
    p = np.zeros((60, 60))
    p[found.u, found.v] = found.p
    assert np.abs(p - plain_affinities(d, 15, 5.0)).max() < 1e-7
    assert len(tsne.widths(np.array([1.0, 1.0]), 5.0)) == 2


@pytest.mark.parametrize("theta", [0.2, 0.5])
def test_quadtree_as_plain(theta):
    g = np.random.default_rng(0)
    y = np.vstack([g.normal(size=(150, 2)) * 3, g.normal(size=(50, 2)) * 0.05 + 4, np.full((20, 2), -2.0)])
    h = 2.2 * np.abs(y).max() / 256
    cells, own = np.unique(np.floor(y / h), axis=0, return_inverse=True)
    total = lambda w: np.bincount(own.ravel(), w)
    tree = tsne.Quadtree(cells[:, 0], cells[:, 1], np.bincount(own.ravel()), total(y[:, 0]), total(y[:, 1]), h, 10)
    q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
    np.fill_diagonal(q, 0)
    w = q * q
    exact = np.column_stack([w.sum(axis=1)[:, None] * y - w @ y, q.sum(axis=1)])
    error = np.abs(tree.push(y, theta) - exact).max(axis=0) / np.abs(exact).max(axis=0)
    assert error.max() < 0.1 * theta**2  # cells that look smaller than theta stand for their points to second order


def test_layout_rests_where_the_plain_one_does(spark):
    x = groups(200)
    near, d = plain_nearest(x, 30)
    found = tsne.layout(frame(spark, x, "article_id"), perplexity=10, still=0.05).toPandas().sort_values("article_id")
    y, p = found[["x", "y"]].to_numpy(), plain_affinities(d, 30, 10.0)
    divergence = plain_divergence(p, y)[0]
    assert divergence == pytest.approx(found.divergence.iloc[0], rel=0.03)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.svd(unit - unit.mean(axis=0), full_matrices=False)
    start = axes[0][:, :2] * axes[1][:2]
    assert found.divergence.iloc[0] == pytest.approx(plain_layout(p, start / start[:, 0].std(), 0.05), rel=0.1)
    own = np.arange(200) % 8
    close = np.argsort(((y[:, None] - y[None]) ** 2).sum(axis=2) + np.eye(200) * 1e9, axis=1)[:, :5]
    assert (own[close] == own[:, None]).mean() > 0.9


def test_layouts_that_do_not_rest_are_errors(spark):
    x = frame(spark, groups(40), "article_id")
    with pytest.raises(RuntimeError, match="rest"):
        tsne.layout(x, perplexity=5, max_rounds=2)
    with pytest.raises(RuntimeError, match="rest"):
        layout.neighbour_layout(x, k=5, max_rounds=2)
    assert tsne.layout(x.limit(2)).count() == 2 and tsne.layout(x.limit(0)).count() == 0

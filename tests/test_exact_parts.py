"""Quantiles by narrowing histograms and rings by pointer doubling against plain versions."""

import random

import numpy as np
import pytest

from mapweave.operators import labels, quantiles, spatial


@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 1.0])
def test_quantiles_as_plain(spark, p):
    g = random.Random(4)
    rows = [(c, g.choice([g.gauss(0, 1), float(g.randrange(3)), 1e300 * g.random(), -1e-300 * g.random()])) for c in (1, 2, None) for _ in range(151)]
    rows += [(4, 7.5), (5, None), (1, None), (2, float("nan"))] + [(6, 2.0)] * 40
    found = quantiles.quantiles(spark.createDataFrame(rows, "country int, x double"), "x", p, "country", bins=16).collect()
    plain = {c: np.quantile([v for k, v in rows if k == c and v is not None and v == v], p) for c in (1, 2, None, 4, 6)}
    assert {r.country: r["quantile"] for r in found} == pytest.approx(plain, rel=1e-12)


def test_quantile_of_all_rows(spark):
    frame = spark.createDataFrame([(i, float(i * i % 101)) for i in range(500)], "id long, d double")
    values = sorted(float(i * i % 101) for i in range(500))
    assert quantiles.quantiles(frame, "d", 0.9).first()[0] == pytest.approx(np.quantile(values, 0.9))
    below = labels.below_percentile(frame, "d", 0.9)
    assert below.count() == sum(v < np.quantile(values, 0.9) for v in values)
    assert "percentile" not in below._jdf.queryExecution().toString().lower()
    assert labels.below_percentile(frame.limit(0), "d", 0.9).count() == 0


def plain_rings(edges):
    """Follow each edge to the one that turns most to the left."""
    left, rings = set(edges), []
    while left:
        ring = [min(left)]
        while True:
            x1, y1, x2, y2 = ring[-1]
            turn = lambda e, ax=x2 - x1, ay=y2 - y1: np.arctan2(ax * (e[3] - e[1]) - ay * (e[2] - e[0]), ax * (e[2] - e[0]) + ay * (e[3] - e[1]))
            following = max((e for e in edges if e[:2] == (x2, y2)), key=turn)
            if following == ring[0]:
                break
            ring.append(following)
        left -= set(ring)
        rings.append(ring)
    return rings


def test_rings_as_plain(spark):
    g = random.Random(2)
    cells = [(x, y, g.choice([0, 0, 1])) for x in range(14) for y in range(14)]
    border = spatial.borders(spatial.regions(spark.createDataFrame(cells, "cx long, cy long, country int")), 1.0)
    per_region = {}
    for e in border.collect():
        per_region.setdefault(e.region, []).append((e.x1, e.y1, e.x2, e.y2))
    expected = set()
    for region, edges in per_region.items():
        for ring in plain_rings(edges):
            area = sum(e[0] * e[3] - e[2] * e[1] for e in ring)
            expected.add((region, area < 0, tuple(e[:2] for e in [*ring, ring[0]])))
    rows = spatial.outlines(border).collect()
    assert {(r.region, r.hole, tuple((p.x, p.y) for p in r.points)) for r in rows} == expected and len(rows) == len(expected)
    assert any(r.hole for r in rows) and max(len(r.points) for r in rows) > 20
    assert sorted((r.region, r.ring) for r in rows) == sorted((k, i) for k in per_region for i in range(sum(r.region == k for r in rows)))


def test_no_borders_have_no_rings(spark):
    empty = spark.createDataFrame([], "region long, country int, x1 double, y1 double, x2 double, y2 double")
    assert spatial.outlines(empty).count() == 0

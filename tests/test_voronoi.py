"""The Voronoi graph and its relief against plain versions."""

import heapq
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from mapweave.operators import voronoi


def frame(spark, points):
    return spark.createDataFrame(points, "id long, x double, y double, country int").repartition(4)


def area(cell):
    at = lambda e: (Fraction(e[1][0], e[1][2]), Fraction(e[1][1], e[1][2]))
    return sum(at(a)[0] * at(b)[1] - at(b)[0] * at(a)[1] for a, b in zip([cell[-1], *cell], cell, strict=False)) / 2


@pytest.mark.parametrize("points", [[(i, random.Random(i).randrange(10**9), random.Random(-i - 1).randrange(10**9)) for i in range(60)], [(10 * i + j, i * 10, j * 10) for i in range(6) for j in range(6)]])
def test_cells_tile_the_box(points):
    box = (-50, -50, 10**9 + 50, 10**9 + 50)
    cells = {p[0]: voronoi.cut(p[1:], [o for o in points if o != p], box) for p in points}
    assert sum(area(c) for c in cells.values()) == (10**9 + 100) ** 2
    assert all(any(n == i for n, _ in cells[o]) for i, c in cells.items() for o, _ in c if o is not None)


def plain_triangles(points):
    """All triples whose circle holds no other point."""
    found = set()
    xy = {i: (x, y) for i, x, y in points}
    for i, (a, ax, ay) in enumerate(points):
        for j in range(i + 1, len(points)):
            b, bx, by = points[j]
            for k in range(j + 1, len(points)):
                c, cx, cy = points[k]
                w = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
                if w:
                    ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / w
                    uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / w
                    r = (ax - ux) ** 2 + (ay - uy) ** 2
                    if all((x - ux) ** 2 + (y - uy) ** 2 > r for o, (x, y) in xy.items() if o not in (a, b, c)):
                        found.add((a, b, c, round(ux, 6), round(uy, 6)))
    return found


def test_graph_as_plain_triangulation(spark):
    g = random.Random(3)
    points = [(2**60 + i, g.random() * 100, g.random() * 100) for i in range(40)] + [(i, 40 + g.random(), 50 + g.random()) for i in range(15)]
    points = [(i, round(x * 2**20) / 2**20, round(y * 2**20) / 2**20) for i, x, y in points]
    centres, corners, edges = voronoi.voronoi_graph(frame(spark, [(*p, p[0] % 3) for p in points]), margin=10.0, first=4)
    places = {r.corner: (round(r.x, 6), round(r.y, 6)) for r in corners.collect()}
    got = edges.collect()
    around = {}
    for e in got:
        for c in (e.v, e.w):
            around.setdefault(places[c], set()).update((e.a, e.b))
    inside = lambda x, y: min(p[1] for p in points) - 10 < x < max(p[1] for p in points) + 10 and min(p[2] for p in points) - 10 < y < max(p[2] for p in points) + 10
    triangles = {t for t in plain_triangles(sorted(points)) if inside(*t[3:])}
    assert {(*sorted(ids), *c) for c, ids in around.items() if len(ids) == 3} == triangles
    assert all(e.is_border == (e.a % 3 != e.b % 3) for e in got)
    borders = {i for e in got if e.is_border for i in (e.a, e.b)}
    assert {r.id for r in centres.collect() if r.is_border} == borders
    xy = {i: (x, y) for i, x, y in points}
    for e in got:  # a lies to the left
        (vx, vy), (wx, wy), (ax, ay) = places[e.v], places[e.w], xy[e.a]
        assert (wx - vx) * (ay - vy) - (wy - vy) * (ax - vx) > 0


def test_graph_of_grids_copies_and_few_points(spark):
    grid = [(10 * i + j, float(i), float(j), 1) for i in range(7) for j in range(7)] + [(1000 + i, 3.0, 3.0, 2) for i in range(20)] + [(5000, None, 1.0, 1), (5001, float("nan"), 1.0, 1)]
    centres, corners, edges = voronoi.voronoi_graph(frame(spark, grid), margin=0.5)
    assert centres.count() == 49 and edges.count() == 84 and corners.count() == 60
    assert voronoi.voronoi_graph(frame(spark, grid[:2]))[2].count() == 1
    alone = voronoi.voronoi_graph(frame(spark, grid[:1]))
    assert [t.count() for t in alone] == [1, 0, 0]
    assert [t.count() for t in voronoi.voronoi_graph(frame(spark, grid).limit(0))] == [0, 0, 0]


def test_relief_as_a_priority_queue(spark):
    g = random.Random(9)
    points = [(i, g.random() * 60, g.random() * 60, 9 if i < 60 else i % 2) for i in range(120)]
    points = [(i, x + (100 if c == 9 else 0), y, c) for i, x, y, c in points]
    centres, _, edges = voronoi.voronoi_graph(frame(spark, points), margin=5.0)
    drawn = F.pmod(F.xxhash64(F.least("v", "w"), F.greatest("v", "w"), F.lit(6)), F.lit(1 << 40)) / float(1 << 40)
    sides = edges.withColumn("drawn", drawn).collect()
    country = {r.id: r.country for r in centres.collect()}
    dry = {c for e in sides if country[e.a] != 9 or country[e.b] != 9 for c in (e.v, e.w)}
    ways = {}
    for e in sides:
        rise = 0.01 + (1 + e.drawn if e.v in dry and e.w in dry else 0)
        ways.setdefault(e.v, []).append((e.w, rise))
        ways.setdefault(e.w, []).append((e.v, rise))
    heights = {c: math.inf for c in ways} | {c: 0.0 for e in sides if e.is_border for c in (e.v, e.w)}
    queue = [(h, c) for c, h in heights.items() if h == 0]
    heapq.heapify(queue)
    while queue:
        h, c = heapq.heappop(queue)
        for d, rise in ways[c] if h == heights[c] else []:
            if h + rise < heights[d]:
                heights[d] = h + rise
                heapq.heappush(queue, (h + rise, d))
    corners, means = voronoi.relief(centres, edges, 9)
    assert {r.corner: r.elevation for r in corners.collect()} == pytest.approx(heights)
    own = {}
    for e in sides:
        for i in (e.a, e.b):
            own.setdefault(i, set()).update((e.v, e.w))
    assert {r.id: r.elevation for r in means.collect()} == pytest.approx({i: sum(heights[c] for c in cs) / len(cs) for i, cs in own.items()})
    assert max(heights.values()) > 1 and min(heights.values()) == 0

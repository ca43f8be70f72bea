"""Exact Voronoi graph (G4): centres, corners and edges as tables, without a triangulation in one place.

A centre's cell is the box cut by the bisectors towards its neighbours. It starts with the nearest few others; then every corner of every
cell asks for the centres nearest to it. Whoever is nearer to a corner than the cell's own centre is a neighbour that was missing, so that cell is cut
again; when no corner finds anyone new, each is the centre of an empty circle and the cells are right. Each round is a join in the plane and work on
single cells. Coordinates are whole numbers of a fine grid, so cuts are exact and all cells around a corner name it alike.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators.plane import nearest_in_plane
from mapweave.runtime import materialize, release

_CORNERS = "id long, place int, other long, key string, x double, y double"


def cut(own: tuple[int, int], others: list[tuple[int, int, int]], box: tuple[int, int, int, int]) -> list[tuple[int | None, tuple[int, int, int]]]:
    """[(neighbour beyond the edge, its end)] around a cell, counter-clockwise; None beyond an edge of the box.

    others are (id, x, y). An end is (x, y, w) for the point (x / w, y / w) relative to own. Bisectors that only touch a corner cut nothing.
    """
    x0, y0, x1, y1 = box[0] - own[0], box[1] - own[1], box[2] - own[0], box[3] - own[1]
    # lines a * x + b * y <= c with who is beyond them, and the corner in which each ends
    cell = [((0, -1, -y0), None, (x1, y0, 1)), ((1, 0, x1), None, (x1, y1, 1)), ((0, 1, y1), None, (x0, y1, 1)), ((-1, 0, -x0), None, (x0, y0, 1))]
    for who, ox, oy in sorted(others, key=lambda o: ((o[1] - own[0]) ** 2 + (o[2] - own[1]) ** 2, o[0])):
        dx, dy = ox - own[0], oy - own[1]
        line = (2 * dx, 2 * dy, dx * dx + dy * dy)
        beyond = [line[0] * x + line[1] * y > line[2] * w for _, _, (x, y, w) in cell]
        if not any(beyond):
            continue
        size, kept = len(cell), []
        for i in range(size):
            edge, name, end = cell[i]
            begins, ends = beyond[i - 1], beyond[i]
            if not begins and not ends:
                kept.append(cell[i])
            elif begins and not ends:  # the cell comes back in along this edge
                kept.append((line, who, _meet(line, edge)))
                kept.append((edge, name, end))
            elif ends and not begins:
                kept.append((edge, name, _meet(edge, line)))
        cell = _without_points(kept)
    return [(name, end) for _, name, end in cell]


def _meet(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    w = a[0] * b[1] - b[0] * a[1]
    x, y = a[2] * b[1] - b[2] * a[1], a[0] * b[2] - b[0] * a[2]
    g = gcd(x, y, w) * (1 if w > 0 else -1)
    return x // g, y // g, w // g


def _without_points(cell: list) -> list:
    """Edges whose two ends are one point are none."""
    return [e for i, e in enumerate(cell) if e[2] != cell[i - 1][2]]


def _cells(asked: DataFrame, sites: DataFrame, known: DataFrame, grain: float, box: tuple[int, int, int, int]) -> DataFrame:
    """(id, place, other, key, x, y): the edges of the cells of asked, some of the sites, with their ends, from known (id, other)."""
    there = sites.select(F.col("id").alias("other"), F.col("ix").alias("ox"), F.col("iy").alias("oy"))
    lists = known.join(there, "other").groupBy("id").agg(F.collect_list(F.struct("other", "ox", "oy")).alias("others"))
    rows = asked.select("id", "ix", "iy").join(lists, "id", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for who, ix, iy, others in zip(pdf.id, pdf.ix, pdf.iy, pdf.others, strict=True):
                own = (int(ix), int(iy))
                near = [] if others is None else [(int(o["other"]), int(o["ox"]), int(o["oy"])) for o in others]
                for place, (name, (x, y, w)) in enumerate(cut(own, near, box)):
                    px, py = Fraction(own[0] * w + x, w), Fraction(own[1] * w + y, w)
                    out.append((who, place, name, f"{px} {py}", float(px) * grain, float(py) * grain))
            own_id, place, other, key, x, y = zip(*out, strict=True) if out else [()] * 6
            kinds = {"id": (own_id, "int64"), "place": (place, "int32"), "other": (other, "Int64"), "key": (key, "object"), "x": (x, "float64"), "y": (y, "float64")}
            yield pd.DataFrame({name: pd.array(list(values), dtype=kind) for name, (values, kind) in kinds.items()})

    return rows.mapInPandas(run, _CORNERS)


def voronoi_graph(points: DataFrame, margin: float = 10.0, grain: float = 2.0**-20, first: int = 8, max_rounds: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(centres, corners, edges) of points (id, x, y, country), within the box of all points grown by margin.

    centres (id, x, y, country, is_border): points at one place of the grid of `grain` are one centre, that of the lowest id; it is at a border when a
    neighbour has another country. corners (corner, x, y): corner is its exact place as text. edges (a, b, v, w, is_border): centres a < b on both sides, corners v
    and w at the ends, a to the left on the way from v to w. Points without a place are left out. A cell's
    neighbours are gathered in one row; few points have many, as there are six on average.
    """
    at = lambda c: F.round(F.col(c) / grain).cast("long")
    real = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)").select("id", at("x").alias("ix"), at("y").alias("iy"), "country")
    sites = real.groupBy("ix", "iy").agg(F.min(F.struct("id", "country")).alias("s")).select("s.id", "ix", "iy", "s.country")
    sites = materialize(sites.withColumn("x", F.col("ix") * grain).withColumn("y", F.col("iy") * grain), "sites")
    low_x, low_y, high_x, high_y = sites.agg(F.min("ix"), F.min("iy"), F.max("ix"), F.max("iy")).first()
    more = int(margin / grain)
    box = (0, 0, 0, 0) if low_x is None else (low_x - more, low_y - more, high_x + more, high_y + more)
    place = sites.select("id", "x", "y")
    both = lambda pairs: pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    known = materialize(both(nearest_in_plane(place, first).select("id", "other")), "known")
    cells = materialize(_cells(sites, sites, known, grain, box), "cells")
    asking = cells
    for _ in range(max_rounds):
        corners = materialize(asking.groupBy("key").agg(F.first("x").alias("x"), F.first("y").alias("y")).withColumn("id", F.monotonically_increasing_id()), "asking")
        found = nearest_in_plane(place, 4, corners.select("id", "x", "y")).select("id", "other")
        told = asking.select("key", F.col("id").alias("own")).join(corners.select("key", F.col("id").alias("asked")), "key").join(found.withColumnRenamed("id", "asked"), "asked")
        new = materialize(both(told.filter("own <> other").select(F.col("own").alias("id"), "other")).join(known, ["id", "other"], "left_anti"), "new")
        release(corners)
        if new.isEmpty():
            break
        touched = new.select("id").distinct()
        before, known = known, materialize(known.unionByName(new), "known")
        again = _cells(sites.join(touched, "id", "left_semi"), sites, known.join(touched, "id", "left_semi"), grain, box)
        old, cells = cells, materialize(cells.join(touched, "id", "left_anti").unionByName(again), "cells")
        moved = cells.join(touched, "id", "left_semi")
        asking = moved.join(old.select("id", "key"), ["id", "key"], "left_anti")  # corners that were there have asked
        asking = materialize(asking, "moved")
        release(before, new)
    else:
        raise RuntimeError(f"cells did not settle in {max_rounds} rounds")
    release(known)
    ends = cells.select("id", "place", F.col("key").alias("w"))
    size = cells.groupBy("id").agg(F.count("*").alias("n"))
    starts = cells.join(size, "id").select("id", F.pmod(F.col("place") + 1, F.col("n").cast("int")).alias("place"), F.col("key").alias("v"))
    sides = cells.filter("id < other").select("id", "place", "other").join(ends, ["id", "place"]).join(starts, ["id", "place"])
    land = sites.select("id", "country")
    edges = sides.join(land, "id").join(land.select(F.col("id").alias("other"), F.col("country").alias("theirs")), "other")
    edges = materialize(edges.select(F.col("id").alias("a"), F.col("other").alias("b"), "v", "w", (~F.col("country").eqNullSafe(F.col("theirs"))).alias("is_border")), "edges")
    at_border = edges.filter("is_border").select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("is_border", F.lit(True))
    centres = sites.select("id", "x", "y", "country").join(at_border, "id", "left").withColumn("is_border", F.coalesce("is_border", F.lit(False)))
    used = edges.select(F.explode(F.array("v", "w")).alias("key")).distinct()
    corners = cells.groupBy("key").agg(F.first("x").alias("x"), F.first("y").alias("y")).join(used, "key", "left_semi").withColumnRenamed("key", "corner")
    return centres, corners, edges


def relief(centres: DataFrame, edges: DataFrame, water: int, low: float = 0.01, high: float = 1.0, seed: int = 6, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(corner, elevation) and (id, elevation): heights that grow with the way from the borders.

    Corners on borders, between countries or with the water, are at 0. A step to an adjacent corner rises by `low`, and where both are on land by
    high + a number below 1 more, drawn by a hash of the edge, alike both ways; a corner has the least height over all ways from a border, infinity
    where none leads to it. A corner is in the water when all centres around it are. A centre has the mean of its corners. Each round
    only corners that sank in the round before go on to their neighbours; rounds are as many as edges on the longest best way.
    """
    wet = centres.select("id", F.coalesce(F.col("country") == water, F.lit(False)).alias("wet"))
    sides = edges.join(wet.withColumnsRenamed({"id": "a", "wet": "wet_a"}), "a").join(wet.withColumnsRenamed({"id": "b", "wet": "wet_b"}), "b")
    dry = sides.filter("not wet_a or not wet_b").select(F.explode(F.array("v", "w")).alias("corner")).distinct()
    on_land = lambda c: dry.select(F.col("corner").alias(c), F.lit(True).alias(f"dry_{c}"))
    drawn = F.pmod(F.xxhash64(F.least("v", "w"), F.greatest("v", "w"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rise = F.when(F.col("dry_v").isNotNull() & F.col("dry_w").isNotNull(), low + high + drawn).otherwise(low)
    ways = edges.select("v", "w").distinct().join(on_land("v"), "v", "left").join(on_land("w"), "w", "left").select("v", "w", rise.alias("rise"))
    # Rounds go by numbers: the exact places are long texts.
    numbers = materialize(edges.select(F.explode(F.array("v", "w")).alias("corner")).distinct().withColumn("n", F.monotonically_increasing_id()), "numbers")
    by_number = lambda c: numbers.select(F.col("corner").alias(c), F.col("n").alias(f"n_{c}"))
    ways = ways.join(by_number("v"), "v").join(by_number("w"), "w").select(F.col("n_v").alias("v"), F.col("n_w").alias("w"), "rise")
    ways = materialize(ways, "roads")
    ways, roads = materialize(ways.unionByName(ways.select(F.col("w").alias("v"), F.col("v").alias("w"), "rise")), "ways"), ways
    release(roads)
    start = edges.filter("is_border").select(F.explode(F.array("v", "w")).alias("corner")).distinct()
    heights = materialize(start.join(numbers, "corner").select(F.col("n").alias("corner"), F.lit(0.0).alias("elevation")), "heights")
    front = heights
    for round_ in range(max_rounds):
        reached = front.withColumnRenamed("corner", "v").join(ways, "v").groupBy(F.col("w").alias("corner")).agg(F.min(F.col("elevation") + F.col("rise")).alias("reached"))
        sunk = reached.join(heights, "corner", "left").filter("elevation is null or reached < elevation").select("corner", F.col("reached").alias("elevation"))
        passed, front = front, materialize(sunk, "front", collect=False)
        if front.isEmpty():
            break
        before, heights = heights, materialize(heights.join(front, "corner", "left_anti").unionByName(front), "heights", collect=round_ % 8 == 7)
        release(before, passed)
    else:
        raise RuntimeError(f"heights did not settle in {max_rounds} rounds")
    corners = numbers.join(heights.withColumnRenamed("corner", "n"), "n", "left").drop("n")
    corners = corners.withColumn("elevation", F.coalesce("elevation", F.lit(float("inf"))))
    touches = edges.select(F.explode(F.array("a", "b")).alias("id"), F.array("v", "w").alias("c")).select("id", F.explode("c").alias("corner")).distinct()
    means = touches.join(corners, "corner").groupBy("id").agg(F.avg("elevation").alias("elevation"))
    return corners, means

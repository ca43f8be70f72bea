"""Map geometry (G1-G11): boxes, water, regions on a raster, elevation and outlines.

The plane is cut into square cells and each cell belongs to the country of its nearest site. So borders are cell edges,
regions are connected cells, and outlines are closed by construction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.operators.graph import connected_components
from mapweave.operators.plane import nearest_in_plane
from mapweave.runtime import materialize, release


def bounding_box(points: DataFrame, margin: float = 30.0) -> DataFrame:
    """One row: the box of all points, `margin` wider on each side (G1)."""
    return points.agg((F.min("x") - margin).alias("x0"), (F.max("x") + margin).alias("x1"), (F.min("y") - margin).alias("y0"), (F.max("y") + margin).alias("y1"))


def water_rings(box: DataFrame, rings: int = 5, step: float = 1.0, apart: float = 10.0) -> DataFrame:
    """(ring, x, y): points every `step` along square rings around a box, ring r lying r * apart outside."""
    ring = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(rings - 1))).alias("ring"))
    out = F.col("ring") * apart
    grown = ring.select("ring", (F.col("x0") - out).alias("x0"), (F.col("x1") + out).alias("x1"), (F.col("y0") - out).alias("y0"), (F.col("y1") + out).alias("y1"))
    along = lambda a, b: F.explode(F.sequence(F.lit(0), F.floor((F.col(b) - F.col(a)) / step).cast("int"))).alias("i")
    flat = grown.select("*", along("x0", "x1"))
    tall = grown.select("*", along("y0", "y1"))
    sides = [flat.select("ring", (F.col("x0") + F.col("i") * step).alias("x"), F.col(y).alias("y")) for y in ("y0", "y1")]
    sides += [tall.select("ring", F.col(x).alias("x"), (F.col("y0") + F.col("i") * step).alias("y")) for x in ("x0", "x1")]
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3]).distinct()


def random_water(points: DataFrame, box: DataFrame, share: float = 0.2, shape: float = 0.8, seed: int = 5) -> DataFrame:
    """(x, y): a share as many points as there are, at Beta(shape, shape) places along both sides of the box, alike on every run.

    A place is drawn by Johnk's method: of 24 pairs of hashed numbers the first that is accepted counts.
    """
    u = lambda axis, i, side: (F.pmod(F.xxhash64("n", F.lit(axis), i, F.lit(side), F.lit(seed)), F.lit(1 << 40)) + 1) / float(1 << 40)

    def draw(axis: str) -> Column:
        pair = lambda i: F.struct(F.pow(u(axis, i, 0), 1 / shape).alias("a"), F.pow(u(axis, i, 1), 1 / shape).alias("b"))
        good = F.filter(F.transform(F.sequence(F.lit(1), F.lit(24)), pair), lambda p: p["a"] + p["b"] <= 1)
        return F.coalesce(F.get(F.transform(good, lambda p: p["a"] / (p["a"] + p["b"])), F.lit(0)), F.lit(0.5))

    counted = points.agg(F.floor(F.count("*") * share).cast("long").alias("n")).filter("n > 0")
    rows = counted.crossJoin(F.broadcast(box)).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n"))))  # one row each
    along = lambda a, b, axis: F.col(a) + (F.col(b) - F.col(a)) * draw(axis)
    return rows.select(along("x0", "x1", "x").alias("x"), along("y0", "y1", "y").alias("y"))


def with_water(points: DataFrame, box: DataFrame, water: int, share: float = 0.2, rings: int = 5) -> DataFrame:
    """points (x, y, country) with the box's rings and random places as a country of its own number."""
    own = points.select("x", "y", "country")
    sea = water_rings(box, rings).select("x", "y").unionByName(random_water(points, box, share))
    return own.unionByName(sea.withColumn("country", F.lit(water).cast(own.schema["country"].dataType)))


def heat_weights(tau: float, rest: float = 1e-9) -> list[float]:
    """exp(-tau) tau**i / i! from i = 0, for as many terms as leave less than `rest` of their sum of 1."""
    if not 0 <= tau < math.inf:
        raise ValueError(f"tau must be finite and not negative: {tau}")
    weights = [math.exp(-tau)]
    # Past tau each term is less than `ratio` of the one before, which bounds what is left.
    while (ratio := tau / len(weights)) >= 1 or weights[-1] * ratio / (1 - ratio) >= rest:
        i = len(weights)
        weights.append(math.exp(i * math.log(tau) - tau - math.lgamma(i + 1)))
    return weights


def denoised(points: DataFrame, edges: DataFrame, tau: float = 10.0, rest: float = 1e-9) -> DataFrame:
    """Points (id, x, y, country) whose diffused country signal is strongest in their own country.

    edges (u, v, weight) have distances, which become affinities exp(-(d / mean d)**2). One-hot signals go through the heat kernel
    exp(-tau * L / m) of the graph's Laplacian L, m being the bound max(d_u + d_v) of its largest eigenvalue: the sum of
    exp(-tau) tau**i / i! * (1 - L / m)**i. A term is a join on the edges; there are as many as leave less than `rest` of the weight, whatever tau is.
    """
    mean = edges.agg(F.avg("weight").alias("mean"))
    near = edges.filter("u <> v").crossJoin(F.broadcast(mean)).withColumn("w", F.when(F.col("mean") > 0, F.exp(-F.pow(F.col("weight") / F.col("mean"), 2))).otherwise(1.0))  # one row
    both = materialize(near.select("u", "v", "w").unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")), "neighbours")
    degree = both.groupBy("u").agg(F.sum("w").alias("d"))
    other = degree.select(F.col("u").alias("v"), F.col("d").alias("e"))
    most = both.join(degree, "u").join(other, "v").agg(F.max(F.col("d") + F.col("e"))).first()[0] or 1.0
    around = materialize(points.select(F.col("id").alias("u")).join(degree, "u", "left").select("u", (1 - F.coalesce("d", F.lit(0.0)) / most).alias("stay")), "degrees")
    terms = [points.select(F.col("id").alias("u"), F.col("country").alias("c"), F.lit(1.0).alias("s"))]
    weights = heat_weights(tau, rest)
    for _ in weights[1:]:
        moved = both.join(terms[-1], "u").select(F.col("v").alias("u"), "c", (F.col("s") * F.col("w") / most).alias("s"))
        kept = terms[-1].join(around, "u").select("u", "c", (F.col("s") * F.col("stay")).alias("s"))
        terms.append(materialize(moved.unionByName(kept).groupBy("u", "c").agg(F.sum("s").alias("s")).filter("s > 0"), "term", collect=False))
    heat = None
    for weight, term in zip(weights, terms, strict=True):
        weighed = term.withColumn("s", F.col("s") * weight)
        heat = weighed if heat is None else heat.unionByName(weighed)
    heat = materialize(heat.groupBy("u", "c").agg(F.sum("s").alias("s")), "heat")
    release(*terms, both, around)
    best = heat.groupBy("u").agg(F.max_by("c", F.struct(F.round("s", 12), -F.col("c"))).alias("best"))
    return points.join(best, points["id"] == best["u"]).filter("best = country").drop("u", "best")


def raster(points: DataFrame, size: float) -> DataFrame:
    """(cx, cy, country): every cell with a point, by the majority of its points (ties: the lowest country)."""
    cell = points.select(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"), "country")
    counts = cell.groupBy("cx", "cy", "country").agg(F.count("*").alias("n"))
    return counts.groupBy("cx", "cy").agg(F.max_by("country", F.struct("n", -F.col("country"))).alias("country"))


def _cell_id(x: Column, y: Column) -> Column:
    return (x + (1 << 30)) * (1 << 31) + y + (1 << 30)


def voronoi_cells(points: DataFrame, size: float, box: DataFrame) -> DataFrame:
    """(cx, cy, country): every cell of the box (one row: x0, x1, y0, y1) with the country of the nearest cell that holds points (ties: the lowest country)."""
    sites = raster(points, size).withColumn("id", _cell_id(F.col("cx"), F.col("cy")))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    cells = box.select("y0", "y1", span("x0", "x1").alias("cx")).repartition("cx").select("cx", span("y0", "y1").alias("cy"))
    cells = cells.withColumn("id", _cell_id(F.col("cx"), F.col("cy")))
    near = nearest_in_plane(sites.select("id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("country").alias("tie")), 1, cells.select("id", F.col("cx").alias("x"), F.col("cy").alias("y")))
    placed = near.select("id", "other").join(sites.select(F.col("id").alias("other"), "country"), "other").select("id", "country")
    return cells.join(placed, "id").select("cx", "cy", "country")


def regions(cells: DataFrame) -> DataFrame:
    """(cx, cy, country, region): connected cells of one country, by sides; the region is its smallest cell's number."""
    named = materialize(cells.select("cx", "cy", "country", _cell_id(F.col("cx"), F.col("cy")).alias("cell")), "named")
    there = named.select(F.col("cell").alias("next"), F.col("country").alias("theirs"))
    sides = named.select("cell", "country", F.explode(F.array(_cell_id(F.col("cx") + 1, F.col("cy")), _cell_id(F.col("cx"), F.col("cy") + 1))).alias("next"))
    edges = sides.join(there, "next").filter("country = theirs").select("cell", "next")
    found = connected_components(edges, "cell", "next")
    return named.join(found.withColumnRenamed("node", "cell"), "cell", "left").select("cx", "cy", "country", F.coalesce("component", "cell").alias("region"))


def borders(region_cells: DataFrame, size: float) -> DataFrame:
    """(region, country, x1, y1, x2, y2): cell edges between a region and what isn't part of it, the region to the left."""
    here = region_cells.select("cx", "cy", "region", "country")
    side = lambda i, j, a, b: F.struct(*(F.lit(v).alias(n) for n, v in zip(("i", "j", "ax", "ay", "bx", "by"), (i, j, *a, *b), strict=True)))
    sides = F.array(side(0, -1, (0, 0), (1, 0)), side(1, 0, (1, 0), (1, 1)), side(0, 1, (1, 1), (0, 1)), side(-1, 0, (0, 1), (0, 0)))
    edges = here.select("*", F.explode(sides).alias("s")).withColumn("nx", F.col("cx") + F.col("s.i")).withColumn("ny", F.col("cy") + F.col("s.j"))
    there = here.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("region").alias("theirs"))
    open_ = edges.join(there, ["nx", "ny"], "left").filter(F.col("theirs").isNull() | (F.col("theirs") != F.col("region")))
    at = lambda c, s: ((F.col(c) + F.col(f"s.{s}")) * size)
    return open_.select("region", "country", at("cx", "ax").alias("x1"), at("cy", "ay").alias("y1"), at("cx", "bx").alias("x2"), at("cy", "by").alias("y2"))


def ring_edges(border_edges: DataFrame) -> DataFrame:
    """(region, country, low, place, x1, y1, x2, y2): each border edge with its ring, named by the ring's least edge, and its place from there.

    The edge that goes on from an edge's end is the one that turns most to the left, so that at a corner that a region touches twice the
    ring stays in the same cell. Rings are found by pointer doubling: in each round an edge learns the least edge among twice as many as before, and how
    far it is, until no edge learns anything. No region or ring has to fit in a task, and rounds are the logarithm of the longest ring.
    """
    corners = F.struct("x1", "y1", "x2", "y2")
    edges = materialize(border_edges.select("region", "country", "x1", "y1", "x2", "y2").withColumn("edge", F.monotonically_increasing_id()), "edges")
    after = edges.select("region", F.col("edge").alias("to"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"))
    ax, ay, bx, by = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x3") - F.col("x2"), F.col("y3") - F.col("y2")
    turn = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    onward = edges.join(after, ["region", "x2", "y2"]).groupBy("edge").agg(F.max_by("to", turn).alias("to"))
    state = materialize(edges.join(onward, "edge").select("edge", "to", corners.alias("low"), F.lit(0).cast("long").alias("far"), F.lit(True).alias("learnt")), "pointers")
    reach = 1
    while not state.filter("learnt").isEmpty():
        there = state.select(F.col("edge").alias("to"), F.col("to").alias("next"), F.col("low").alias("their_low"), F.col("far").alias("their_far"))
        less = F.col("their_low") < F.col("low")
        told = state.join(there, "to").select(
            "edge", F.col("next").alias("to"), F.least("low", "their_low").alias("low"), F.when(less, F.col("their_far") + reach).otherwise(F.col("far")).alias("far"), less.alias("learnt")
        )
        before, state = state, materialize(told, "pointers", collect=False)
        release(before)
        reach *= 2
    rings = edges.join(state.select("edge", "low", "far"), "edge")
    sizes = rings.groupBy("region", "low").agg(F.count("*").alias("n"))
    return rings.join(sizes, ["region", "low"]).select("region", "country", "low", F.pmod(F.col("n") - F.col("far"), F.col("n")).alias("place"), "x1", "y1", "x2", "y2")


def outlines(border_edges: DataFrame) -> DataFrame:
    """(region, country, ring, hole, points): closed rings along each region's border, holes running the other way.

    Points come in order from ring_edges(); a hole is a ring of negative area. A row of the result holds one ring.
    """
    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "x1", "y1")))
    rings = ring_edges(border_edges).groupBy("region", "country", "low").agg(area.alias("area"), ordered.alias("p"))
    points = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda e: F.struct(e["x1"].alias("x"), e["y1"].alias("y")))
    number = F.row_number().over(Window.partitionBy("region").orderBy("low")) - 1  # rings, not edges
    return rings.select("region", "country", number.alias("ring"), (F.col("area") < 0).alias("hole"), points.alias("points"))


def multipolygons(rings: DataFrame) -> DataFrame:
    """(country, polygons): for each region of a country its rings, the outline first and then its holes."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring", "points"))), lambda r: r["points"])
    per_region = rings.groupBy("country", "region").agg(ordered.alias("rings"))
    return per_region.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("region", "rings"))).alias("polygons"))


def elevation(cells: DataFrame, step: float = 0.1) -> DataFrame:
    """(cx, cy, country, height): steps from the nearest cell outside, raised by `step` each.

    A breadth-first relaxation: cells next to the outside are at one step, each round sets the neighbours of the last,
    until there are none. All land has an outside somewhere, so no cell is left.
    """
    land = materialize(cells.select("cx", "cy", "country"), "land")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    near = lambda t: t.select("cx", "cy", around.alias("s")).select((F.col("cx") + F.col("s.i")).alias("nx"), (F.col("cy") + F.col("s.j")).alias("ny"), "cx", "cy")
    shore = near(land).join(land.select(F.col("cx").alias("nx"), F.col("cy").alias("ny")), ["nx", "ny"], "left_anti").select("cx", "cy").distinct()
    #: A cell two rounds back can't be reached again, so a round only looks at the last two.
    rounds = [materialize(shore.withColumn("level", F.lit(1)), "level")]
    while not rounds[-1].isEmpty():
        last = rounds[-1].unionByName(rounds[-2]) if len(rounds) > 1 else rounds[-1]
        new = near(rounds[-1]).select(F.col("nx").alias("cx"), F.col("ny").alias("cy")).distinct().join(land, ["cx", "cy"], "left_semi").join(last, ["cx", "cy"], "left_anti")
        rounds.append(materialize(new.withColumn("level", F.lit(len(rounds) + 1)), "level"))
    levels = land.sparkSession.createDataFrame([], rounds[0].schema)
    for at in range(0, len(rounds), 50):  # unions of many tables make slow plans
        part = rounds[at]
        for table in rounds[at + 1 : at + 50]:
            part = part.unionByName(table)
        levels = materialize(levels.unionByName(part), "levels")
    release(*rounds)
    return land.join(levels, ["cx", "cy"]).select("cx", "cy", "country", (F.col("level") * step).alias("height"))


def clockwise(points: DataFrame, group: str, cx: str, cy: str) -> DataFrame:
    """(group, points): a group's points by falling angle around (cx, cy)."""
    angle = -F.atan2(F.col("y") - F.col(cy), F.col("x") - F.col(cx))
    ordered = F.array_sort(F.collect_list(F.struct(angle.alias("a"), "x", "y")))
    return points.groupBy(group).agg(F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))


def palette(height: Column, country: Column, countries: int) -> Column:
    """A colour hsl(hue, saturation, lightness): a hue per country, lighter with height."""
    return F.format_string("hsl(%d, 60%%, %d%%)", (country * 360 / countries).cast("int"), F.least(F.lit(85), (35 + height * 50).cast("int")))


def noisy(edges: DataFrame, amount: float, seed: int = 7, rounds: int = 4) -> DataFrame:
    """Border edges halved `rounds` times at middles that are moved by up to `amount` of an edge's length, alike from both sides.

    A middle is moved across its edge by a hash of the edge's ends in a fixed order, so that neighbours keep their common border.
    """
    end = lambda s, i: F.struct(s[f"x{i}"].alias("x"), s[f"y{i}"].alias("y"))

    def halves(s: Column) -> Column:
        a, b = end(s, 1), end(s, 2)
        forward = a < b
        u = F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) * 2 - 1
        across = F.when(forward, u).otherwise(-u) * amount
        # written so that both sides add the same numbers in the same order
        mx = (F.least(s["x1"], s["x2"]) + F.greatest(s["x1"], s["x2"])) / 2 - (s["y2"] - s["y1"]) * across
        my = (F.least(s["y1"], s["y2"]) + F.greatest(s["y1"], s["y2"])) / 2 + (s["x2"] - s["x1"]) * across
        part = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
        return F.array(part(s["x1"], s["y1"], mx, my), part(mx, my, s["x2"], s["y2"]))

    parts = F.array(F.struct("x1", "y1", "x2", "y2"))
    for _ in range(rounds):
        parts = F.flatten(F.transform(parts, halves))
    return edges.select("region", "country", F.inline(parts))

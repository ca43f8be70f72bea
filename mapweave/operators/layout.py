"""Layouts of vectors in the plane (K13, K14): a neighbour embedding by joins.

Near vectors attract each other along the edges of their neighbour graph, all others are pushed apart through a few partners that are drawn
anew, by a hash, in every round. A round adds up along the edges (operators/edges.py), which aren't shuffled again, and joins the partners, so no
point is ever gathered with all others. Steps fall from round to round, alike on every run, until the points hardly move. Curves: 1 / (1 + a d**(2 b)), as in uniform manifold
approximation; a = b = 1 is the heavy-tailed curve of t-distributed embeddings, which operators/tsne.py fits by their own divergence.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators.cluster import pca_layout
from mapweave.operators.edges import BLOCK, blocked, packed, told
from mapweave.operators.labels import dense_ids
from mapweave.operators.neighbours import nearest_graph
from mapweave.runtime import materialize, release


def curve(spread: float, min_dist: float) -> tuple[float, float]:
    """a and b of the curve that is nearest, by least squares, to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    wanted = np.where(d <= min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b = spread ** (-2.0), 1.0
    for _ in range(200):  # Gauss-Newton in (ln a, b), with halved steps where the error grows
        got = 1 / (1 + a * d ** (2 * b))
        slope = -(got**2) * a * d ** (2 * b)
        jacobian = np.column_stack([slope, slope * 2 * np.log(d)])
        step = np.linalg.lstsq(jacobian, wanted - got, rcond=None)[0]
        error = ((wanted - got) ** 2).sum()
        for _ in range(30):
            x, y = a * np.exp(step[0]), b + step[1]
            if y > 0 and ((wanted - 1 / (1 + x * d ** (2 * y))) ** 2).sum() <= error:
                break
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        a, b = x, y
    return float(a), float(b)


def fuzzy_edges(neighbours: DataFrame, k: int) -> DataFrame:
    """(u, v, weight), u < v, of (id, other, distance): memberships exp(-(d - nearest) / s) that sum to log2(k) for each point, joined as a + b - a b."""

    def run(batches):
        for pdf in batches:
            out = []
            for u, others, far in zip(pdf.id, pdf.others, pdf.distances, strict=True):
                d = np.array(far) - min(far)
                low, high = 0.0, 1.0
                while np.exp(-d / high).sum() < np.log2(k) and high < 1e12:
                    high *= 2
                for _ in range(50):
                    s = (low + high) / 2
                    low, high = (s, high) if np.exp(-d / max(s, 1e-300)).sum() < np.log2(k) else (low, s)
                out += [(u, v, w) for v, w in zip(others, np.exp(-d / max(high, 1e-12)), strict=True)]
            yield pd.DataFrame(out, columns=["u", "v", "weight"])

    per = neighbours.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("n"))  # k each
    one_way = per.select("id", F.col("n.other").alias("others"), F.col("n.distance").alias("distances")).mapInPandas(run, "u long, v long, weight double")
    ends = one_way.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return ends.agg((F.sum("weight") - F.when(F.count("*") > 1, F.max("weight") * F.min("weight")).otherwise(0.0)).alias("weight"))


def _pulls(a: float, b: float, w: np.ndarray, xu: np.ndarray, yu: np.ndarray, xv: np.ndarray, yv: np.ndarray) -> tuple[np.ndarray, ...]:
    """What each edge adds to the step of u, at most 4 along an axis."""
    dx, dy = xu - xv, yu - yv
    d = dx * dx + dy * dy
    apart = np.where(d > 0, d, 1.0)
    pull = np.where(d > 0, -2.0 * a * b * apart ** (b - 1) / (1 + a * apart**b), 0.0) * w
    return tuple(np.clip(pull * c, -4.0, 4.0) for c in (dx, dy))


def neighbour_layout(
    rows: DataFrame,
    k: int = 15,
    still: float = 0.01,
    max_rounds: int = 300,
    spread: float = 20.0,
    min_dist: float = 0.1,
    partners: int = 5,
    pace: float = 1.0,
    groups: DataFrame | None = None,
    group_weight: float = 0.5,
    ab: tuple[float, float] | None = None,
    seed: int = 4,
) -> DataFrame:
    """(article_id, x, y) of (article_id, vector): a neighbour embedding by cosine distance.

    It starts from the plane of the largest variances; steps are `pace` times the summed forces at first and fall by 7 % a round. It is at rest
    when points move by less than `still` of their mean distance from the middle, on average; that max_rounds don't bring it there is an error.
    groups (article_id, country) weakens edges between countries to exp(-5 * group_weight / (1 - group_weight)) of their weight. Neighbours
    are those of operators/neighbours.py, so that all work follows the rows.
    """
    a, b = ab or curve(1.0, min_dist / spread)  # in units of spread, which the result is scaled by
    own = materialize(rows.select("article_id", "vector").filter("vector is not null"), "vectors")
    edges = fuzzy_edges(nearest_graph(own.select(F.col("article_id").alias("id"), "vector"), k, "cosine"), k)
    if groups is not None:
        g = groups.select("article_id", "country")
        edges = edges.join(g.withColumnsRenamed({"article_id": "u", "country": "cu"}), "u", "left").join(g.withColumnsRenamed({"article_id": "v", "country": "cv"}), "v", "left")
        apart = float(np.exp(-5 * group_weight / max(1 - group_weight, 1e-9)))
        edges = edges.select("u", "v", (F.col("weight") * F.when(F.coalesce(F.col("cu") != F.col("cv"), F.lit(False)), apart).otherwise(1.0)).alias("weight"))
    edges = materialize(edges, "edges")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")).withColumnRenamed("weight", "w")
    start = pca_layout(own)
    size = start.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))).first()[0] or 1.0
    numbers = dense_ids(own.select(F.col("article_id").alias("id")), "id", "id").withColumnRenamed("label_id", "n")
    state = start.select(F.col("article_id").alias("id"), (F.col("x") / size * 10).alias("x"), (F.col("y") / size * 10).alias("y")).join(numbers, "id")
    state = materialize(state, "layout")
    count = state.count()
    blocks = max(1, ceil(count / BLOCK))
    points = blocked(state.select("id", "x", "y"), ["x", "y"], blocks)
    packs = packed(both, points, blocks)
    clip = lambda c: F.least(F.lit(4.0), F.greatest(F.lit(-4.0), c))
    far = lambda: (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    for i in range(max_rounds):
        drawn = F.explode(F.sequence(F.lit(1), F.lit(partners))).alias("j")
        asked = state.select("id", "x", "y", "n", drawn).withColumn("m", F.pmod(F.xxhash64("n", "j", F.lit(i), F.lit(seed)), F.lit(max(count, 1)))).filter("m <> n")
        other = state.select(F.col("n").alias("m"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        push = F.lit(2.0 * b) / ((0.001 + F.col("d")) * (1 + a * F.pow("d", b)))
        pulled = told(packs, points, blocks, lambda *ends: _pulls(a, b, *ends), ["dx", "dy"]).join(points.select("block", "ids"), "block")
        pulled = pulled.select("ids", F.explode("told").alias("t")).select(F.explode(F.arrays_zip("ids", "t.dx", "t.dy")).alias("p"))
        moved = pulled.select(F.col("p.ids").alias("u"), F.col("p.dx").alias("dx"), F.col("p.dy").alias("dy")).unionByName(
            asked.join(other, "m").withColumn("d", far()).select(F.col("id").alias("u"), *(clip(push * (F.col(c) - F.col(f"o{c}"))).alias(f"d{c}") for c in "xy"))
        )
        step = moved.groupBy(F.col("u").alias("id")).agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
        rate = pace * 0.93**i
        dx, dy = (F.coalesce(f"d{c}", F.lit(0.0)) * rate for c in "xy")
        added = state.join(step, "id", "left").select("id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "n", F.sqrt(dx * dx + dy * dy).alias("moved"))
        before, state = state, materialize(added, "layout", collect=False)
        last, points = points, blocked(state.select("id", "x", "y"), ["x", "y"], blocks)
        release(before, last)
        moved, radius = state.agg(F.coalesce(F.avg("moved"), F.lit(0.0)), F.coalesce(F.avg(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), F.lit(1.0))).first()
        if moved <= still * radius:
            break
    else:
        raise RuntimeError(f"the layout did not come to rest in {max_rounds} rounds")
    release(edges, packs, points)
    return state.select(F.col("id").alias("article_id"), (F.col("x") * spread).alias("x"), (F.col("y") * spread).alias("y"))

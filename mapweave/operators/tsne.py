"""t-distributed neighbour embedding (K14) as rounds of sums over blocks of points.

Each row's affinities to its nearest others are normal with a width, found by bisection, that gives them the wanted perplexity. A round moves every
point down the gradient of the divergence: pulls are sums along the affinities (operators/edges.py), which aren't shuffled again; pushes come from a quadtree over the points, whose cells
(numbers of points and their means, at most about 4**depth at the finest level) are summed on Spark and travel to all tasks, where a cell stands for its points
as soon as it looks small from a point. The normaliser is that of the round before. Rounds end when the divergence stands still.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators import edges
from mapweave.operators.cluster import pca_layout
from mapweave.operators.neighbours import nearest_graph
from mapweave.runtime import materialize, release


def widths(squares: np.ndarray, perplexity: float) -> np.ndarray:
    """Affinities that sum to 1 from one row's squared distances: exp(-b * d), with the entropy ln(perplexity)."""
    d = squares - squares.min()
    if len(d) <= perplexity:  # all alike is the most even that so few can be
        return np.full(len(d), 1 / len(d))
    low, high, b = 0.0, np.inf, 1.0
    for _ in range(200):
        w = np.exp(-d * b)
        total = w.sum()
        entropy = np.log(total) + b * (d * w).sum() / total
        if abs(entropy - np.log(perplexity)) < 1e-10:
            break
        low, high = (b, high) if entropy > np.log(perplexity) else (low, b)
        b = 2 * b if np.isinf(high) else (low + high) / 2
    return w / total


def affinities(neighbours: DataFrame, perplexity: float) -> DataFrame:
    """(u, v, p), both ways: the mean of both rows' affinities, which sum to 1 over all, from (id, other, distance)."""

    def run(batches):
        for pdf in batches:
            out = [(u, v, p) for u, others, far in zip(pdf.id, pdf.others, pdf.distances, strict=True) for v, p in zip(others, widths(np.array(far) ** 2, perplexity), strict=True)]
            yield pd.DataFrame(out, columns=["u", "v", "p"])

    per = neighbours.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("n"))  # as many as were asked for
    one_way = per.select("id", F.col("n.other").alias("others"), F.col("n.distance").alias("distances")).mapInPandas(run, "u long, v long, p double")
    one_way = materialize(one_way, "one_way", collect=False)
    both = materialize(one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"), "p")).groupBy("u", "v").agg(F.sum("p").alias("p")), "both", collect=False)
    release(one_way)
    total = both.agg(F.sum("p").alias("total"))
    return both.crossJoin(F.broadcast(total)).select("u", "v", (F.col("p") / F.col("total")).alias("p"))  # one row


class Quadtree:
    """Occupied cells of a grid of side h, and the cells of twice the side above them, level by level."""

    def __init__(self, ix: np.ndarray, iy: np.ndarray, n: np.ndarray, sx: np.ndarray, sy: np.ndarray, h: float, levels: int) -> None:
        self.h = h
        self.levels = []  # finest first: side, keys, count, means, and for all but the finest the ranges of children
        keys = self.key(ix, iy)
        order = np.argsort(keys)
        keys, n, sx, sy = keys[order], n[order].astype(float), sx[order], sy[order]
        self.levels.append((h, keys, n, sx, sy, None, None))
        for level in range(1, levels):
            up = self.key((keys >> 32) >> 1, (keys & 0xFFFFFFFF) >> 1, offset=0)
            by_parent = np.argsort(up, kind="stable")
            parents, starts = np.unique(up[by_parent], return_index=True)
            total = lambda x, b=by_parent, s=starts: np.add.reduceat(x[b], s)
            n, sx, sy = total(n), total(sx), total(sy)
            self.levels.append((h * 2**level, parents, n, sx, sy, by_parent, np.append(starts, len(by_parent))))
            keys = parents

    @staticmethod
    def key(ix: np.ndarray, iy: np.ndarray, offset: int = 1 << 30) -> np.ndarray:
        return ((ix.astype(np.int64) + offset) << 32) | (iy.astype(np.int64) + offset)

    def push(self, points: np.ndarray, theta: float) -> np.ndarray:
        """A row (sum of q*q*(y - other), its other coordinate, sum of q) for each point, q = 1 / (1 + distance**2), without the point itself."""
        out = np.zeros((len(points), 3))
        finest = self.levels[0]
        own = np.searchsorted(finest[1], self.key(np.floor(points[:, 0] / self.h), np.floor(points[:, 1] / self.h)))
        top = len(self.levels) - 1
        point, cell = np.repeat(np.arange(len(points)), len(self.levels[top][1])), np.tile(np.arange(len(self.levels[top][1])), len(points))
        for level in range(top, -1, -1):
            side, _, n, sx, sy, children, bounds = self.levels[level]
            count, x, y = n[cell], sx[cell], sy[cell]
            if not level:  # a point isn't pushed by itself
                self_ = cell == own[point]
                count, x, y = count - self_, x - self_ * points[point, 0], y - self_ * points[point, 1]
                point, count, x, y = (a[count > 0] for a in (point, count, x, y))
            dx, dy = points[point, 0] - x / count, points[point, 1] - y / count
            d = dx * dx + dy * dy
            enough = side * side < theta * theta * d if level else np.ones(len(d), bool)
            q = 1 / (1 + d[enough])
            weight = count[enough] * q
            for i, v in enumerate((weight * q * dx[enough], weight * q * dy[enough], weight)):
                out[:, i] += np.bincount(point[enough], v, len(points))
            if level:
                point, cell = point[~enough], cell[~enough]
                sizes = bounds[cell + 1] - bounds[cell]
                first = np.repeat(bounds[cell] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
                cell, point = children[first + np.arange(sizes.sum())], np.repeat(point, sizes)
        return out


_STATE = ["x", "y", "vx", "vy", "gx", "gy", "z", "kl"]
_BLOCKS = "block long, ids array<long>, " + ", ".join(f"{c} array<double>" for c in _STATE)


def _tree(state: DataFrame, reach: float, depth: int) -> tuple[Quadtree, float, float, float]:
    """(tree, normaliser and divergence of the state, farthest coordinate)."""
    h = 2.2 * max(reach, 1e-9) / 2**depth
    names = ["ix", "iy", "n", "sx", "sy", "z", "kl", "far"]

    def run(batches):
        for batch in batches:
            for x, y, z, kl in zip(*batch.columns, strict=True):
                x, y, z, kl = (c.values.to_numpy() for c in (x, y, z, kl))
                cells, own = np.unique(np.column_stack([np.floor(x / h), np.floor(y / h)]).astype(np.int64), axis=0, return_inverse=True)
                own, far = own.ravel(), np.zeros(len(cells))
                np.maximum.at(far, own, np.maximum(np.abs(x), np.abs(y)))
                sums = [np.bincount(own, w, len(cells)) for w in (x, y, z, kl)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cells[:, 0], cells[:, 1], np.bincount(own), *sums, far)], names)

    parts = state.select("x", "y", "z", "kl").mapInArrow(run, "ix long, iy long, n long, sx double, sy double, z double, kl double, far double")
    cells = parts.groupBy("ix", "iy").agg(*(F.sum(c).alias(c) for c in names[2:7]), F.max("far").alias("far"))
    t = {c: v.to_numpy() for c, v in zip(cells.columns, cells.toArrow().columns, strict=True)}  # about 4**depth rows at most
    z = t["z"].sum()
    return Quadtree(t["ix"], t["iy"], t["n"], t["sx"], t["sy"], h, depth + 2), z, t["kl"].sum() + (np.log(z) if z > 0 else 0.0), t["far"].max()


def _push(tree: Quadtree, x: np.ndarray, y: np.ndarray, theta: float) -> np.ndarray:
    points = np.column_stack([x, y])
    return np.vstack([np.zeros((0, 3)), *(tree.push(points[at : at + 1024], theta) for at in range(0, len(points), 1024))])


def _pull(p: np.ndarray, xu: np.ndarray, yu: np.ndarray, xv: np.ndarray, yv: np.ndarray) -> tuple[np.ndarray, ...]:
    dx, dy = xu - xv, yu - yv
    d = dx * dx + dy * dy
    near = p / (1 + d)
    return near * dx, near * dy, p * np.log(p * (1 + d), out=np.zeros_like(p), where=p > 0)


def _moved(state: DataFrame, pulled: DataFrame, blocks: int, tree: Quadtree, z: float, theta: float, exaggeration: float, momentum: float, pace: float) -> DataFrame:
    """state after a step; its z and kl are those before it."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                own = {c: batch.column(i + 2)[row].values.to_numpy() for i, c in enumerate(_STATE)}
                push, parts = _push(tree, own["x"], own["y"], theta), batch.column(len(_STATE) + 2)[row]
                after = {"z": push[:, 2], "kl": edges.total(parts, "kl", len(push))}
                for i, c in enumerate("xy"):
                    g = 4 * (exaggeration * edges.total(parts, f"a{c}", len(push)) - push[:, i] / max(z, 1e-300))
                    after[f"g{c}"] = np.maximum(0.01, np.where(np.sign(g) == np.sign(own[f"v{c}"]), own[f"g{c}"] * 0.8, own[f"g{c}"] + 0.2))
                    after[f"v{c}"] = own[f"v{c}"] * momentum - g * after[f"g{c}"] * pace
                    after[c] = own[c] + after[f"v{c}"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, 1) for i in range(2)), *(pa.array([after[c]], pa.list_(pa.float64())) for c in _STATE)], ["block", "ids", *_STATE])

    joined = state.join(pulled, "block", "left").select("block", "ids", *_STATE, "told")
    return joined.repartition(blocks, "block").mapInArrow(run, _BLOCKS)  # as many tasks as blocks


def layout(
    rows: DataFrame,
    perplexity: float = 30.0,
    exaggeration: float = 4.0,
    exaggerated: int = 20,
    still: float = 0.003,
    max_rounds: int = 1000,
    theta: float = 0.5,
    depth: int = 8,
    neighbours: DataFrame | None = None,
) -> DataFrame:
    """(article_id, x, y, divergence) of (article_id, vector), by cosine distance; divergence is that of the whole layout.

    It starts from the plane of the largest variances. Steps are a quarter of the number of rows, with gains and momentum; in the first `exaggerated` rounds
    affinities count `exaggeration` times. It is at rest when ten rounds bring less than `still` of the divergence; that max_rounds don't bring it there is an
    error. neighbours (id, other, distance) replace the graph of the 3 * perplexity nearest. Rows without a vector are left out.
    """
    own = materialize(rows.select(F.col("article_id").cast("long").alias("article_id"), "vector").filter("vector is not null"), "vectors")
    n = own.count()
    if n < 3:
        return own.select("article_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("divergence"))
    perplexity = min(perplexity, (n - 1) / 3)
    near = nearest_graph(own.select(F.col("article_id").alias("id"), "vector"), min(n - 1, int(3 * perplexity)), "cosine") if neighbours is None else neighbours
    near = affinities(near.select("id", "other", "distance"), perplexity)
    start = pca_layout(own)
    size = start.agg(F.stddev("x")).first()[0] or 1.0
    blocks, zero = ceil(n / edges.BLOCK), F.lit(0.0)
    first = start.select(F.col("article_id").alias("id"), (F.col("x") / size).alias("x"), (F.col("y") / size).alias("y"), *(zero.alias(c) for c in ("vx", "vy")), *(F.lit(1.0).alias(c) for c in ("gx", "gy")), zero.alias("z"), zero.alias("kl"))
    state = edges.blocked(first, _STATE, blocks)
    packs = edges.packed(near.select("u", "v", F.col("p").alias("w")), state, blocks)
    reach = state.agg(F.max(F.greatest(*(F.array_max(F.transform(c, F.abs)) for c in "xy")))).first()[0]
    tree, _, _, reach = _tree(state, reach, depth)

    def weighed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_push(tree, x.values.to_numpy(), y.values.to_numpy(), theta)[:, 2].sum() for x, y in zip(*batch.columns, strict=True)], pa.float64())], ["z"])

    z = state.select("x", "y").mapInArrow(weighed, "z double").agg(F.sum("z")).first()[0]
    divergences: list[float] = []
    for step in range(max_rounds):
        early = step < exaggerated
        pulled = edges.told(packs, state, blocks, _pull, ["ax", "ay", "kl"])
        moved = _moved(state, pulled, blocks, tree, z, theta, exaggeration if early else 1.0, 0.5 if early else 0.8, n / 4)
        before, state = state, materialize(moved, "layout", collect=False)
        release(before)
        tree, z, divergence, reach = _tree(state, reach, depth)  # z and divergence are those of the state before the step
        divergences.append(divergence)
        if step >= exaggerated + 10 and divergences[-11] - divergence < still * abs(divergences[-11]):
            break
    else:
        raise RuntimeError(f"the layout did not come to rest in {max_rounds} rounds")
    release(packs, own)
    points = state.select(F.explode(F.arrays_zip("ids", "x", "y")).alias("p"))
    return points.select(F.col("p.ids").alias("article_id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.lit(float(divergence)).alias("divergence"))

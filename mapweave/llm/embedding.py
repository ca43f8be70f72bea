"""Operator 2, embedding near-dedup: tiles of vectors along their principal axes, compared block by block.

Unit vectors are turned to the principal axes of the whole table (an orthogonal change of axes keeps every cosine).
Two unit vectors of cosine c differ by sqrt(2 - 2c) at most along any axis, so vectors are tiled by their leading
coordinates and a tile only meets its neighbours. Within a pair of blocks, leading products are accumulated
first; the rest of a product is at most the product of the norms of the two suffixes, and a pair
whose bound stays below the threshold is not looked at again. The rest is decided on the original vectors in
double precision.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators.graph import connected_components
from mapweave.operators.pairwise import met
from mapweave.runtime import materialize

#: Rounding that the bound allows for; the exact test on the original vectors follows.
SLACK = 1e-9


def _usable(batch: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for vectors that can't be compared."""
    lengths = np.diff(batch.offsets.to_numpy())
    if not batch.null_count and not batch.values.null_count and len(lengths) and lengths[0] > 0 and (lengths == lengths[0]).all():
        flat = batch.flatten().to_numpy().reshape(len(batch), -1)
        top = np.abs(flat).max(axis=1)
        if np.isfinite(top).all() and (top > 0).all():
            flat = flat / top[:, None]
            return list(flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None])
    found: list[np.ndarray | None] = []
    for value in batch.to_pylist():
        if not value or None in value:
            found.append(None)
            continue
        v = np.asarray(value, np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            found.append(None)
            continue
        v = v / top
        found.append(v / np.sqrt(np.einsum("i,i->", v, v)))
    return found


def _units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dims, unit) with the unit vector's bytes; both null where a vector can't be compared."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                units = _usable(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([None if u is None else len(u) for u in units], pa.int32()),
                        pa.array([None if u is None else u.tobytes() for u in units], pa.binary()),
                    ],
                    ["id", "dims", "unit"],
                )

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "id long, dims int, unit binary")


def _axes(units: DataFrame) -> np.ndarray:
    """Principal axes (rows) of all unit vectors about the origin, shorter ones filled with zeros.

    Each task sums its own second moments; what meets is one matrix per task.
    """
    most = units.agg(F.max("dims")).first()[0]
    if most is None:
        return np.zeros((0, 0))

    def run(batches):
        total = np.zeros((most, most))
        for batch in batches:
            for size in set(batch.column(0).to_pylist()):
                rows = [u for u in batch.column(1).to_pylist() if len(u) == 8 * size]
                own = np.frombuffer(b"".join(rows), np.float64).reshape(-1, size)
                total[:size, :size] += own.T @ own
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(most * most), pa.int64()), pa.array(total.ravel())], ["place", "value"]
        )

    parts = units.select("dims", "unit").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    table = parts.toArrow()
    moments = np.zeros(most * most)
    moments[table["place"].to_numpy()] = table["value"].to_numpy()
    return np.linalg.eigh(moments.reshape(most, most))[1].T[::-1].copy()


def _tiled(units: DataFrame, axes: np.ndarray, width: float, tile_axes: int) -> DataFrame:
    """(id, unit, cell): cell holds the number of dimensions and the leading coordinates in steps of width."""
    lead = axes[:tile_axes]

    def run(batches):
        for batch in batches:
            cells = []
            for unit in batch.column(1).to_pylist():
                u = np.frombuffer(unit, np.float64)
                cells.append([len(u), *np.floor(lead[:, : len(u)] @ u / width).astype(int).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int32()))], ["id", "unit", "cell"])

    return units.select("id", "unit").mapInArrow(run, "id long, unit binary, cell array<int>")


class _Block:
    def __init__(self, ids: np.ndarray, units: list[bytes], weights: np.ndarray, axes: np.ndarray, steps: tuple[int, ...]) -> None:
        self.ids, self.weights = ids, weights
        self.units = np.frombuffer(b"".join(units), np.float64).reshape(len(ids), -1)
        turned = self.units @ axes[:, : self.units.shape[1]].T
        left = np.sqrt(np.maximum(np.cumsum(turned[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
        #: For each step, the leading coordinates and the norm of the suffix as one more coordinate.
        self.steps = [np.c_[turned[:, :s], left[:, s] if s < turned.shape[1] else np.zeros(len(ids))] for s in steps]


def _links(a: _Block, b: _Block, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of rows whose cosine is at least `least`."""
    found_i, found_j = [], []
    for at in range(0, len(a.ids), 512):
        rows = slice(at, at + 512)
        i, j = np.nonzero(a.steps[0][rows] @ b.steps[0].T >= least - SLACK)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for step_a, step_b in zip(a.steps[1:], b.steps[1:], strict=True):
            if len(i) > 0.05 * 512 * len(b.ids):
                break  # dense: one product of the whole strip decides
            stay = np.einsum("ij,ij->i", step_a[i], step_b[j]) >= least - SLACK
            i, j = i[stay], j[stay]
        if not len(i):
            continue
        if len(i) > 0.05 * 512 * len(b.ids):
            stay = (a.units[rows] @ b.units.T)[i - at, j] >= least
        else:
            stay = np.einsum("ij,ij->i", a.units[i], b.units[j]) >= least
        found_i.append(i[stay])
        found_j.append(j[stay])
    if not found_i:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same rows as all links (i, j) do, fewer than n."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _compare(pairs: DataFrame, axes: np.ndarray, least: float, steps: tuple[int, ...]) -> DataFrame:
    """(id, n, other): for each row of a block pair its links there (n), and links (id, other) that span them."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                values = [batch.column(c)[row].as_py() for c in range(7)]
                same = values[0]
                a = _Block(np.array(values[1]), values[2], np.array(values[3]), axes, steps)
                b = a if same else _Block(np.array(values[4]), values[5], np.array(values[6]), axes, steps)
                i, j = _links(a, b, same, least)
                n_a = np.bincount(i, b.weights[j], len(a.ids))
                n_b = np.bincount(j, a.weights[i], len(b.ids))
                shift = 0 if same else len(a.ids)
                tree = _forest(len(a.ids) + (0 if same else len(b.ids)), i, j + shift)
                x, y = np.array([t[0] for t in tree], int), np.array([t[1] for t in tree], int) - shift
                has_a, has_b = np.flatnonzero(n_a), np.flatnonzero(n_b)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([a.ids[has_a], b.ids[has_b], a.ids[x]]), pa.int64()),
                        pa.array(np.concatenate([n_a[has_a], n_b[has_b], np.zeros(len(x))]).astype(np.int64)),
                        pa.array(np.concatenate([np.full(len(has_a) + len(has_b), -1), b.ids[y]]), pa.int64(), mask=np.r_[np.ones(len(has_a) + len(has_b), bool), np.zeros(len(y), bool)]),
                    ],
                    ["id", "n", "other"],
                )

    return pairs.mapInArrow(run, "id long, n long, other long")


def _block_pairs(blocks: DataFrame, tile_axes: int, most_blocks: int) -> DataFrame:
    """(same, ids_a, units_a, weights_a, ids_b, units_b, weights_b) for each pair of blocks whose cells touch, a block with itself too.

    Up to most_blocks blocks are met where they are read, so no vector is shuffled for a pair and disk follows the rows, not their pairs; in
    more blocks a cell has few rows and few blocks around it, and pairs are joined by their cells.
    """
    sides = [blocks.select(*(F.col(c).alias(f"{c}_{x}") for c in ("cell", "part", "ids", "units", "weights"))) for x in "ab"]
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("part_a") == F.col("part_b"))
    if blocks.count() <= most_blocks:
        touch = F.get("cell_a", F.lit(0)) == F.get("cell_b", F.lit(0))
        for i in range(1, tile_axes + 1):
            touch = touch & (F.abs(F.get("cell_a", F.lit(i)) - F.get("cell_b", F.lit(i))) <= 1)
        once = (F.col("cell_a") < F.col("cell_b")) | ((F.col("cell_a") == F.col("cell_b")) & (F.col("part_a") <= F.col("part_b")))
        full = met(*sides, touch & once)
    else:
        shifts = [s for s in product((-1, 0, 1), repeat=tile_axes) if s >= (0,) * len(s)]
        near = F.array(*(F.array(F.lit(0), *(F.lit(x) for x in s)) for s in shifts))
        places = blocks.select("cell", "part")
        reach = places.select("cell", "part", F.explode(near).alias("shift")).select(
            F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.zip_with("cell", "shift", lambda x, y: x + y).alias("cell_b")
        )
        pairs = reach.join(places.select(F.col("cell").alias("cell_b"), F.col("part").alias("part_b")), "cell_b").filter(
            (F.col("cell_a") != F.col("cell_b")) | (F.col("part_a") <= F.col("part_b"))
        )
        full = pairs.join(sides[0], ["cell_a", "part_a"]).join(sides[1], ["cell_b", "part_b"])
    return full.select(same.alias("same"), "ids_a", "units_a", "weights_a", "ids_b", "units_b", "weights_b")


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.95,
    block_rows: int = 2048,
    tile_axes: int = 4,
    steps: tuple[int, ...] = (16, 32),
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    most_blocks: int = 8192,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: links are pairs of rows with cosine >= least.

    component_id is the smallest id reachable by links. Vectors that are null, empty or zero or hold
    a null or non-finite component link with nothing, nor do vectors of different lengths. Equal vectors are one class
    and are compared once; each of them counts the others as links. Every row counts, also rows that repeat an
    id; a row with a null id is counted by others and has itself as component (null). Extra columns are ignored.
    """
    spark = vectors.sparkSession
    units = materialize(_units(vectors, id_col, vec_col), "units")
    axes = _axes(units.filter("unit is not null"))
    #: A class is named by its own number: ids can repeat or be null.
    classes = units.filter("unit is not null").groupBy("unit").agg(F.count("*").alias("weight"), F.min("id").alias("lowest"))
    classes = materialize(classes.withColumn("class", F.xxhash64("unit")), "classes")
    if not axes.size:
        return _answer(units, classes, spark.createDataFrame([], "id long, n long, other long"), id_col)
    width = float(np.sqrt(2 - 2 * least)) + SLACK
    tiled = _tiled(classes.select(F.col("class").alias("id"), "unit"), axes, width, min(tile_axes, len(axes)))
    tiled = materialize(tiled.join(classes.select(F.col("class").alias("id"), "weight"), "id"), "tiled")
    counts = tiled.groupBy("cell").agg(F.count("*").alias("rows"))
    parts = counts.withColumn("parts", F.ceil(F.col("rows") / block_rows)).select("cell", "parts")
    #: A block holds about block_rows vectors at most, however many a tile has.
    blocks = (
        tiled.join(parts, "cell")
        .withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), "parts").cast("int"))
        .groupBy("cell", "part")
        .agg(F.collect_list(F.struct("id", "unit", "weight")).alias("rows"))
        .select(
            "cell",
            "part",
            F.col("rows.id").alias("ids"),
            F.col("rows.unit").alias("units"),
            F.col("rows.weight").alias("weights"),
        )
    )
    blocks = materialize(blocks, "blocks")
    rows = _block_pairs(blocks, min(tile_axes, len(axes)), most_blocks)
    links = materialize(_compare(rows, axes, least, steps), "links")
    return _answer(units, classes, links, id_col)


def _answer(units: DataFrame, classes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    counts = links.groupBy(F.col("id").alias("class")).agg(F.sum("n").alias("n"))
    components = connected_components(links.filter("other is not null"), "id", "other")
    found = classes.join(components.withColumnRenamed("node", "class"), "class", "left").join(counts, "class", "left")
    found = found.withColumn("component", F.coalesce("component", "class"))
    lowest = found.groupBy("component").agg(F.min("lowest").alias("component_id"))
    places = found.join(lowest, "component").select("unit", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    component = F.coalesce("component_id", "id")
    return units.join(places, "unit", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )

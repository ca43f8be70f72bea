"""Operator 13, centroid clustering by Ball k-means, in whole numbers.

A cluster is a ball: its centroid, and a radius that reaches all its members. A centroid farther from it than two radii can't be the nearest one
of any member; the others are its neighbours. A member at distance r from its centroid lies in the stable core when no neighbour is
within 2 r of that centroid; else it lies in the annulus of the neighbours that are, and is held against just these. Distances are
squares of whole numbers, so every comparison, ties included, is exact.

A round is one pass that assigns vectors where they lie and one aggregation by cluster, whose sums, counts and farthest members
give the next centroids and balls. What the driver holds is k centroids, whatever the number of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.runtime import materialize, release

#: Whole components lie within this bound, so that squared distances of up to 512 of them are longs.
MOST = 1 << 26


@dataclass
class Balls:
    """k centroids, and for each the neighbours in ascending distance with 4 * r * r at which they begin to matter."""

    centroids: np.ndarray
    neighbours: list[np.ndarray]
    apart: list[np.ndarray]

    @classmethod
    def of(cls, centroids: list[list[int]], radii: list[int | None]) -> Balls:
        """radii: whole numbers that no member's distance exceeds; None where nothing is known of the members."""
        k = len(centroids)
        near, apart = [], []
        for i in range(k):
            d = sorted((sum((a - b) ** 2 for a, b in zip(centroids[i], centroids[j], strict=True)), j) for j in range(k) if j != i)
            d = [x for x in d if radii[i] is None or x[0] <= 4 * radii[i] ** 2]
            near.append(np.array([j for _, j in d], np.int64))
            apart.append(np.array([x for x, _ in d], np.int64))
        return cls(np.array(centroids, np.int64).reshape(k, -1), near, apart)

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest centroid, squared distance, distances computed) of the rows of x, whose clusters so far are own."""
        square = lambda rows, c: ((rows - c) ** 2).sum(axis=1)
        found, best, work = own.copy(), np.zeros(len(x), np.int64), len(x)
        for i in np.unique(own):
            member = np.flatnonzero(own == i)
            best[member] = d = square(x[member], self.centroids[i])
            # the j-th neighbour matters for members with 4 * r * r of at least its distance: annuli are prefixes of the neighbours
            begins = np.sort(d)
            order = np.argsort(d, kind="stable")
            for j, far in zip(self.neighbours[i], self.apart[i], strict=True):
                inside = member[order[np.searchsorted(begins, -(-far // 4)) :]]
                if not len(inside):
                    break
                other = square(x[inside], self.centroids[j])
                work += len(inside)
                nearer = (other < best[inside]) | ((other == best[inside]) & (j < found[inside]))
                found[inside[nearer]], best[inside[nearer]] = j, other[nearer]
        return found, best, work


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, vector): vectors of `dims` finite components, each x as floor(scale * x)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).filter((F.size("v") == dims) & F.forall("v", lambda x: F.coalesce(finite(x), F.lit(False))))
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x))
    beyond = F.exists("v", lambda x: F.abs(F.lit(float(scale)) * x) > MOST)
    return kept.select("vec_id", F.when(beyond, F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}"))).otherwise(whole).cast("array<int>").alias("vector"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _assigned(rows: DataFrame, balls: Balls) -> DataFrame:
    """rows (vec_id, vector, cluster) with the nearest cluster and the squared distance."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found, best, _ = balls.assign(_matrix(part.column(1)), part.column(2).to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found.astype(np.int32)), pa.array(best)], ["vec_id", "vector", "cluster", "distance"])

    return rows.select("vec_id", "vector", "cluster").mapInArrow(run, "vec_id long, vector array<int>, cluster int, distance long")


def _moved(state: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], list[int | None]]:
    """Next centroids and radii: floors of means; an old radius and the centroid's step bound the new radius. Empty clusters stay, with radius 0."""
    dims = len(centroids[0])
    sums = [F.sum(F.get("vector", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dims)]
    new, radii = [list(c) for c in centroids], [0] * len(centroids)
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect():  # at most k rows
        i = row["cluster"]
        new[i] = [row[f"s{j}"] // row["n"] for j in range(dims)]
        step = sum((a - b) ** 2 for a, b in zip(new[i], centroids[i], strict=True))
        radii[i] = isqrt(row["far"]) + 1 + isqrt(step) + 1
    return new, radii


def seeds(whole: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k ids whose SHA-256 of `seed:id` come first; ids that repeat by their vectors, null ids last."""
    key: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.select("vector", key.alias("key")).orderBy(F.asc_nulls_last("key"), "vector").limit(k)
    return [list(r["vector"]) for r in first.collect()]  # k rows


def cluster(
    rows: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    seed: int = 1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector of rows.

    Left out are vectors that are null, have another number of components than `dims`, or hold null or non-finite ones. Vectors become
    whole numbers, floor(scale * x); components beyond MOST are an error, as exact distances would not fit. Of equally near centroids the one of
    the smaller number counts. Fewer than k vectors make fewer centroids; without vectors the result is empty. Repeated ids are vectors
    of their own; rows with a null id take part and come back with it, and are start vectors only where there are too few others. Extra columns,
    also ones named like the results, are ignored.
    """
    whole = materialize(whole_vectors(rows, id_col, vector_col, dims, scale), "whole")
    centroids = seeds(whole, k, seed) or [[0] * dims]  # any centroid will do where there are no vectors
    state = whole.withColumn("cluster", F.lit(0))
    radii: list[int | None] = [None] * len(centroids)
    for left in range(rounds, -1, -1):
        before, state = state, materialize(_assigned(state, Balls.of(centroids, radii)), "assigned")
        release(before)
        if left:
            centroids, radii = _moved(state, centroids)
    release(whole)
    spark = rows.sparkSession
    digests = [(i, sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    inertia = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    per = F.broadcast(inertia.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(total)))  # k rows, and one
    return state.join(per, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

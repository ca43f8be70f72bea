"""Exact quantiles by histograms that narrow (F8, A13), so that no task holds the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.runtime import materialize, release


def quantiles(rows: DataFrame, value: str, p: float, *groups: str, bins: int = 256, max_rounds: int = 64) -> DataFrame:
    """(*groups, quantile): the interpolated quantile of value in each group, of all rows where no groups are named.

    Two ranks are looked for, those on either side of (n - 1) * p. A round counts the values between a rank's bounds in `bins` even bins, and the
    least and largest value of the rank's bin are the next bounds, until they are one value: at most one pass over rows for each
    factor of about `bins` in the number of places that values can have. What is sent is a row for each bin, group and task. Values that are null
    or NaN don't count; groups without others are left out; null is a group of its own.
    """
    keys = [f"__g{i}" for i in range(len(groups))]
    own = rows.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    own = materialize(own, "values")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] or [F.lit(True)]
    at = (F.col("n") - 1) * F.lit(float(p))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(at).alias("rank")))
    ends = own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).filter("n > 0")
    looked = materialize(ends.select(*keys, "low", "high", (at - F.floor(at)).alias("part"), F.inline(sides)), "ranks")
    for _ in range(max_rounds):
        if looked.filter("low < high").isEmpty():
            break
        open_ = looked.filter("low < high").alias("a")
        inside = own.alias("b").join(open_, [*same("a", "b"), F.col("b.v").between(F.col("a.low"), F.col("a.high"))])
        place = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins))
        counted = inside.select(*(F.col(f"a.{k}").alias(k) for k in keys), "side", "rank", "part", place.alias("bin"), "v")
        counted = counted.groupBy(*keys, "side", "rank", "part", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "side").orderBy("bin"))  # at most `bins` rows
        held = counted.withColumn("before", upto - F.col("n")).filter("rank >= before and rank < before + n")
        narrowed = held.select(*keys, "low", "high", "part", "side", (F.col("rank") - F.col("before")).alias("rank"))
        before, looked = looked, materialize(looked.filter("not low < high").unionByName(narrowed), "ranks", collect=False)
        release(before)
    else:
        raise RuntimeError(f"quantiles did not settle in {max_rounds} rounds")
    one = lambda side: F.max(F.when(F.col("side") == side, F.col("low")))
    found = looked.groupBy(*keys).agg(((1 - F.max("part")) * one(0) + F.max("part") * one(1)).alias("quantile"))
    return found.withColumnsRenamed(dict(zip(keys, groups, strict=True)))

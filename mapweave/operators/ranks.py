"""Places inside groups that may hold any share of all rows: rows are sorted in even ranges, and places move by the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.runtime import materialize


def numbered(rows: DataFrame, group: str, order: list[Column], name: str = "place", weight: Column | None = None) -> DataFrame:
    """rows with their place in the group by `order`, from 1; with weights (whole numbers) the sum of the weights of the rows before, plus 1.

    Rows go to as many ranges of (group, *order) as there are tasks, about equal in size, so a group that is too large for one range spreads over
    several. Places are counted inside a range and moved by what earlier ranges hold of the same group: one row for each range and group that it
    holds. order must tell the rows of a group apart; rows that are equal in all of it have to lie in one range to get places of their own,
    which Spark's ranges see to. A null group is a group.
    """
    own, at = f"__{name}_group", f"__{name}_range"
    weight = F.lit(1) if weight is None else weight
    keyed = rows.withColumn(own, F.col(group)).withColumn(f"__{name}_w", weight.cast("long"))
    ranged = keyed.repartitionByRange(own, *order).withColumn(at, F.spark_partition_id())
    ranged = materialize(ranged, "ranges", collect=False)
    sizes = ranged.groupBy(own, at).agg(F.sum(f"__{name}_w").alias(f"__{name}_n"))
    # Ranges are as many as tasks, and most of them hold parts of one or a few groups.
    before = sizes.select(F.col(own).alias(f"__{name}_g"), F.col(at).alias(f"__{name}_r"), (F.sum(f"__{name}_n").over(Window.partitionBy(own).orderBy(at)) - F.col(f"__{name}_n")).alias(f"__{name}_before"))
    inside = Window.partitionBy(own, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranged.withColumn(name, F.sum(f"__{name}_w").over(inside) - F.col(f"__{name}_w") + 1)
    joined = counted.join(before, F.col(own).eqNullSafe(F.col(f"__{name}_g")) & (F.col(at) == F.col(f"__{name}_r")))
    return joined.withColumn(name, F.col(name) + F.col(f"__{name}_before")).drop(own, at, f"__{name}_w", f"__{name}_g", f"__{name}_r", f"__{name}_before")


def best(rows: DataFrame, group: str, n: int, *order: Column, parts: int = 1024) -> DataFrame:
    """The first n rows of each group by `order`, with their place. A group is first cut to n rows in each of `parts` parts.

    No task sorts more than a part of a group, or parts * n rows of what is left of it.
    """
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    first = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    cut = rows.withColumn("__part", part).withColumn("__p", first).filter(F.col("__p") <= n).drop("__part", "__p")
    return cut.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)

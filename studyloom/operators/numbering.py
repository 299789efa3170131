"""Row numbers and short windows over groups of any size.

A window over a group runs in one task; a group that holds a third of all rows would fill it. Here
rows are range-partitioned by group and order, numbered where they stand, and shifted by how many
rows of the group earlier partitions hold. With numbers known, windows of a few preceding rows are
taken over fixed stretches of each group, each with a copy of the rows just before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.operators.linear_scan import secondary_sort
from studyloom.staging import stage

#: Rows of one group that a window of :func:`over_preceding` sorts at once.
STRETCH = 50_000


def number_rows(df: DataFrame, group: str, order: list[str], name: str = "seq") -> DataFrame:
    """``df`` with ``name``, the 1-based number of each row within ``group`` (null is a group), in ascending ``order``.

    Nulls come first, as ascending order has them. ``order`` should be total, else ties are numbered in any order.
    """
    place, part = "place_", "part_"
    placed = secondary_sort(df, group, *order).withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33))
    placed = stage(placed, "numbered")
    sizes = placed.groupBy(group, part).agg(F.min(place).alias("first_"), F.count("*").alias("rows_"))
    # A group has at most one row a partition here.
    before = F.coalesce(F.sum("rows_").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(F.col(group).alias("group_"), F.col(part).alias("p_"), (before - F.col("first_") + 1).alias("shift_"))
    joined = placed.join(shifts, F.col(group).eqNullSafe(F.col("group_")) & (F.col(part) == F.col("p_")))
    return joined.withColumn(name, F.col(place) + F.col("shift_")).drop(place, part, "group_", "p_", "shift_")


def over_preceding(df: DataFrame, group: str, number: str, back: int, value: Callable[[Window], Column], name: str, stretch: int = STRETCH) -> DataFrame:
    """``df`` with ``name = value(w)``, where ``w`` holds the ``back`` preceding rows of the group by ``number`` (1, 2, ...)."""
    own = F.floor((F.col(number) - 1) / stretch)
    offset = (F.col(number) - 1) % stretch
    also = F.when(offset >= stretch - back, F.array(own, own + 1)).otherwise(F.array(own))
    copied = df.withColumn("own_", own).withColumn("stretch_", F.explode(also))
    window = Window.partitionBy(group, "stretch_").orderBy(number).rowsBetween(-back, -1)
    return copied.withColumn(name, value(window)).where(F.col("own_") == F.col("stretch_")).drop("own_", "stretch_")

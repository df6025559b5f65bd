"""Backward as-of join: each left row takes the last right row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """``left`` plus ``columns`` of the as-of row of ``right``.

    The lookup runs on distinct (keys, time) pairs, so a key shared by many left rows is looked up once per
    date and its frame is bounded by the calendar. A struct is carried forward instead of the values, so a NULL in
    the matched row stays NULL. The result returns to the rows by an equi-join whose side Spark measures itself.
    """
    keys = list(keys)
    spots = left.select(*keys, time).distinct()
    asked = spots.select(*keys, time, F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_row"))
    known = right.select(*keys, time, F.lit(0).alias("_side"), F.struct(*columns).alias("_row"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = w.orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        asked.unionByName(known)
        .withColumn("_hit", F.last("_row", ignorenulls=True).over(w))
        .filter(F.col("_side") == 1)
        .select(*keys, time, *[F.col("_hit").getField(c).alias(c) for c in columns])
    )
    return left.join(found, [*keys, time], "left")

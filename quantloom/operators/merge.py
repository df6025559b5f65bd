"""Union, keep-last and upsert operators.

All of them reduce with ``max_by`` over a struct, so duplicates are combined on the map side and a key that
repeats a billion times never reaches one task as rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import col


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the greatest under ``order``."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])


def merge_history(existing: DataFrame | None, new: DataFrame | None, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Keep-last merge of stored bars with an increment: the increment wins on equal keys."""
    if existing is None and new is None:
        raise ValueError("nothing to merge")
    if existing is None or new is None:
        only = existing if new is None else new
        return keep_last(only.withColumn("_side", F.lit(0)), keys, ["_side", _row_order(only, keys)]).drop("_side")
    both = existing.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, ["_side", _row_order(existing, keys)]).drop("_side")


def _row_order(df: DataFrame, keys: Sequence[str]) -> Column:
    """Deterministic choice between repeats inside one side."""
    return F.struct(*[F.col(c) for c in df.columns if c not in keys])


def upsert(existing: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write per key wins by version, the change on equal versions."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [version, "_side"]).drop("_side")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Newest row per key."""
    return keep_last(df, keys, order)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames by column name, missing columns NULL (G1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

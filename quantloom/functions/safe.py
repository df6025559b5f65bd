"""Null-safe scalar expressions: a zero divisor or a bad cast gives NULL instead of an error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def to_number(c: Column | str) -> Column:
    """Numeric coercion: anything unparsable, NaN or infinite is NULL."""
    return finite(col(c).try_cast("double"))


def clip(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """Clip that keeps NULL as NULL (``greatest`` alone would skip it)."""
    c = col(c)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def log_loss(p: Column | str, y: Column | str) -> Column:
    p, y = col(p), col(y)
    return -F.log(p) * y - F.log(F.lit(1.0) - p) * (F.lit(1.0) - y)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate Pearson correlation that is NULL, not an error, when one side is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    # a constant column can leave rounding dust in the deviation, so compare with its own scale
    flat = (sx <= F.lit(1e-14) * F.max(F.when(both, F.abs(x)))) | (sy <= F.lit(1e-14) * F.max(F.when(both, F.abs(y))))
    return F.when(~flat, div(F.covar_pop(F.when(both, x), F.when(both, y)), sx * sy))


def rounded(df: DataFrame, digits: int = 6, skip: Iterable[str] = ()) -> DataFrame:
    """Round every floating column; used where results are compared or shown."""
    skip = set(skip)
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )

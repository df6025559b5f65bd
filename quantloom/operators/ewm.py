"""Exponentially weighted mean, recursive form (E4): y0 = x0, y = (1-a)*y' + a*x."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _block_length(alphas: Sequence[float]) -> int:
    """Longest block short enough for the fastest decay and still long enough for the slowest to fade out."""
    limit = min(int(250 / -math.log10(1.0 - a)) for a in alphas)
    if limit * -math.log10(1.0 - min(alphas)) < 30:
        raise ValueError("decays too far apart for one pass; add the columns in separate calls")
    return limit


def ewm_mean(df: DataFrame, specs: dict[str, tuple[str, float]], by: Sequence[str] = ("ticker",), order: str = "date") -> DataFrame:
    """Add one column per spec: output -> (source, alpha), all specs in the same windows.

    Unrolled, y_i = q^i * sum(w_k * x_k * q^-k) with q = 1-a: a prefix sum that stays in a window. q^-k would
    overflow on long histories, so rows are cut into blocks short enough for q^-k < 1e250; what
    an earlier block adds is its last value times q^(i+1), and two blocks back it is below 1e-30.
    """
    length = _block_length([a for _, a in specs.values()])
    whole = Window.partitionBy(*by).orderBy(order)
    block = Window.partitionBy(*by, "_b").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    previous = Window.partitionBy(*by).orderBy("_b").rangeBetween(-1, -1)
    j = F.col("_j")
    place = j % length
    power = lambda q, k: F.pow(F.lit(q), k)
    out = df.withColumn("_j", F.row_number().over(whole) - 1).withColumn("_b", F.floor(j / F.lit(length)))
    prefix = {
        f"_s_{name}": F.sum(F.when(j == 0, F.lit(1.0)).otherwise(F.lit(a)) * F.col(x) * power(1.0 - a, -place)).over(block) * power(1.0 - a, place)
        for name, (x, a) in specs.items()
    }
    out = out.withColumns(prefix)
    out = out.withColumns({f"_c_{name}": F.max_by(f"_s_{name}", "_j").over(previous) for name in specs})
    value = lambda name, a: F.col(f"_s_{name}") + F.coalesce(F.col(f"_c_{name}") * power(1.0 - a, place + 1), F.lit(0.0))
    out = out.withColumns({name: value(name, a) for name, (_, a) in specs.items()})
    return out.drop("_j", "_b", *prefix, *[f"_c_{name}" for name in specs])


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1)

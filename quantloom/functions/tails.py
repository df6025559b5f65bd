"""Upper tails of the normal and Student-t laws for one-row-per-test result tables.

Spark has neither ``erfc`` nor a t distribution, so these are Arrow UDFs; they only ever see
rows of finished statistics, never panel rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def normal_sf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2.0)))


def _t_two_sided(t: float, dof: float, steps: int = 4000) -> float:
    """P(|T| > |t|) = 1 - 2*integral_0^|t| of the density; Simpson in theta = atan(t/sqrt(dof))."""
    top = math.atan(abs(t) / math.sqrt(dof))
    log_c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(math.pi)
    width = top / steps
    total = 0.0
    for i in range(steps + 1):
        weight = 1 if i in (0, steps) else (4 if i % 2 else 2)
        total += weight * math.cos(i * width) ** (dof - 1)
    return max(0.0, 1.0 - 2.0 * math.exp(log_c) * total * width / 3)


@F.pandas_udf(T.DoubleType())
def student_t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    values = [
        None if pd.isna(a) or pd.isna(b) or b <= 0 else _t_two_sided(float(a), float(b)) for a, b in zip(t, dof, strict=True)
    ]
    return pd.Series(values, dtype="float64")

"""Labels (K1-K6). Shifts never cross a ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import to_number
from quantloom.operators.ordering import MAX_GROUP_ROWS, average_ranks
from quantloom.operators.technical import by_date


def next_return(df: DataFrame, returns: str = "returns") -> DataFrame:
    """forward_return and its sign as target; the last row of a ticker is dropped (K1)."""
    out = df.withColumn("forward_return", F.lead(returns, 1).over(by_date())).filter(F.col("forward_return").isNotNull())
    return out.withColumn("target", (F.col("forward_return") > 0).cast("int"))


def forward_sum(df: DataFrame, horizon: int = 5, returns: str = "returns", name: str = "fwd_return") -> DataFrame:
    """Sum of the next ``horizon`` returns; rows without a full horizon dropped (K3)."""
    frame = by_date().rowsBetween(1, horizon)
    total = F.when(F.count(returns).over(frame) == horizon, F.sum(returns).over(frame))
    return df.withColumn(name, total).filter(F.col(name).isNotNull())


def forward_sum_target(df: DataFrame, horizon: int = 5, threshold: float = 0.01, returns: str = "returns") -> DataFrame:
    """1 when the forward sum exceeds the threshold, 0 when it is unknown; the last ``horizon`` rows are dropped (K2)."""
    frame, name = by_date().rowsBetween(1, horizon), f"fwd_{horizon}d"
    out = df.select(
        "*",
        F.when(F.count(returns).over(frame) == horizon, F.sum(returns).over(frame)).alias(name),
        F.count(F.lit(1)).over(frame).alias("_ahead"),
    )
    out = out.filter(F.col("_ahead") == horizon).drop("_ahead")
    return out.withColumn(f"target_up_{horizon}d", F.coalesce(F.col(name) > threshold, F.lit(False)).cast("int"))


def top_share_target(df: DataFrame, column: str = "fwd_return", share: float = 0.25, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """1 for the best ``share`` of each date by percentile rank (K4)."""
    ranked = average_ranks(df, ["date"], {column: "_pct"}, max_group_rows, pct=True)
    return ranked.withColumn("target", (F.col("_pct") > 1 - share).cast("int")).drop("_pct")


def horizon_label(df: DataFrame, horizon: int, returns: str = "returns") -> DataFrame:
    """Sign of the return ``horizon`` rows ahead (K5)."""
    out = df.withColumn("future_return", F.lead(returns, horizon).over(by_date())).filter(F.col("future_return").isNotNull())
    return out.withColumn("target", (F.col("future_return") > 0).cast("int"))


def meta_label(df: DataFrame, returns: str = "ret_1d", probability: str = "proba_primary", threshold: float = 0.5) -> DataFrame:
    """1 when the primary direction call is right; a missing value counts as down (K6)."""
    truth = F.coalesce(to_number(returns) > 0, F.lit(False))
    call = F.coalesce(to_number(probability) >= threshold, F.lit(False))
    return df.withColumn("meta_label", (truth == call).cast("int"))

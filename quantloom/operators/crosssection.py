"""Per-date selections and orderings.

Selections with a fixed k keep k rows per date in every input partition before the shuffle (Spark's window group
limit), so a date with a third of all rows costs its task only k rows per partition. Selections with a share need each row's
position and use ``with_position``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.ordering import MAX_GROUP_ROWS, with_position


def top_k(df: DataFrame, by: Sequence[str], k: int, score: str = "score", tie: str = "ticker", bottom: bool = False) -> DataFrame:
    """Best (or worst) k rows of each group; ties by ``tie`` (F2)."""
    order = [F.col(score).asc(), F.col(tie).desc()] if bottom else [F.col(score).desc(), F.col(tie).asc()]
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max(1, k)).drop("_k")


def global_top_k(df: DataFrame, k: int, score: str = "score", tie: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Best k rows of all (F1); k rows per partition reach the final merge."""
    return df.orderBy(F.col(score).desc(), *[F.col(t).asc() for t in tie]).limit(k)


def positions(df: DataFrame, by: Sequence[str] = ("date",), score: str = "score", tie: str = "ticker", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Position by descending score (``pos``) and cross-section size (``n``)."""
    return with_position(df, by, [F.col(score).desc(), F.col(tie).asc()], "pos", "n", max_group_rows)


def share_up(q: float) -> Column:
    """Rows of a share, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q))).cast("long")


def share_down(q: float) -> Column:
    """Rows of a share, rounded down, at least one and short of all."""
    k = F.greatest(F.lit(1), F.floor(F.lit(q) * F.col("n"))).cast("long")
    return F.when(F.col("n") > 1, F.least(k, F.col("n") - 1)).otherwise(F.lit(1))


def selected_flag(df: DataFrame, k: int, by: Sequence[str] = ("date",), max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """1.0 for rows in the top k of their date, else 0.0."""
    return positions(df, by, max_group_rows=max_group_rows).withColumn("selected", (F.col("pos") <= max(1, k)).cast("double")).drop("pos", "n")


def holdings_turnover(holdings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each date's holdings that were not held on the previous date; 1.0 on the first.

    ``holdings`` is (by..., date, ticker). Holdings move to the next date of the axis and meet the current ones in an equi-join.
    """
    by = list(by)
    dates = holdings.select(*by, "date").distinct()
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    dates = dates.withColumn("_next", F.lead("date", 1).over(w.orderBy("date")))
    moved = holdings.select(*by, "date", "ticker").join(dates, [*by, "date"]).select(*by, F.col("_next").alias("date"), "ticker", F.lit(1).alias("_kept"))
    sizes = holdings.select(*by, "date", "ticker").join(moved, [*by, "date", "ticker"], "left").groupBy(*by, "date")
    return sizes.agg((1 - F.coalesce(F.sum("_kept"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("turnover"))


def newest_first(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """Newest ``limit`` rows first, at least one (F8). Page sizes are the caller's."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(max(1, limit))

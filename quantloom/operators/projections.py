"""Projections, filters and null handling (B*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import clip, col, finite
from quantloom.functions.vocabulary import FUNDAMENTAL, PERIOD_ROWS, SENTIMENT, SIGNAL_FLOOR, SIGNAL_LEVELS, TECHNICAL
from quantloom.operators.ordering import MAX_GROUP_ROWS, exact_quantiles


def between_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive date range, either side open (B1); reaches the scan as a pushed filter."""
    if start:
        df = df.filter(F.col("date") >= F.to_date(F.lit(start)))
    if end:
        df = df.filter(F.col("date") <= F.to_date(F.lit(end)))
    return df


def last_rows(df: DataFrame, period: str) -> DataFrame:
    """Last rows of every ticker by period preset, one year when the preset is unknown (B2)."""
    n = PERIOD_ROWS.get(period, PERIOD_ROWS["1y"])
    if n is None:
        return df
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def ordered_columns(df: DataFrame) -> DataFrame:
    """Key, technical, fundamental, sentiment, then the rest."""
    lead = [c for c in ["ticker", "date", *TECHNICAL, *FUNDAMENTAL, *SENTIMENT] if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def with_absent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null columns for an absent slice."""
    return df.select("*", *[F.lit(None).cast("double").alias(c) for c in columns if c not in df.columns])


def clip_to_quantiles(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Clip each feature to its quantile band (B19). The bounds are one row, joined without a shuffle of ``df``."""
    limits = exact_quantiles(df, columns, {"low": low, "high": high}, max_group_rows=max_group_rows)
    found = {row["feature"]: row for row in limits.collect()}  # one row per feature
    return df.select(
        *[clip(c, found[c]["low"], found[c]["high"]).alias(c) if c in columns and c in found else F.col(c) for c in df.columns]
    )


def learn_medians(df: DataFrame, columns: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS) -> dict[str, float]:
    """Exact medians of the training rows."""
    rows = exact_quantiles(df, columns, {"median": 0.5}, max_group_rows=max_group_rows).collect()  # one row per feature
    return {row["feature"]: row["median"] for row in rows}


def impute(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in values else F.col(c) for c in df.columns])


def signal(p: Column) -> Column:
    """Probability to trading signal."""
    out = F.when(p >= SIGNAL_LEVELS[0][0], SIGNAL_LEVELS[0][1])
    for level, name in SIGNAL_LEVELS[1:]:
        out = out.when(p >= level, name)
    return F.when(p.isNotNull(), out.otherwise(SIGNAL_FLOOR))


def confidence(p: Column) -> Column:
    """Distance from a coin flip, 0..1."""
    return F.abs(p - 0.5) * 2


def predicted_class(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def ticker_key(c: Column | str) -> Column:
    return F.upper(F.trim(col(c)))


def finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[finite(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def forecast_probability(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Clip to [0,1]; a column holding only 0 and 1 is thresholded instead.

    Whether the column is binary is one aggregate over it, read back as one boolean.
    """
    p = clip(column, 0.0, 1.0)
    binary = df.select(F.bool_and(F.round(p, 6).isin(0.0, 1.0)).alias("b")).first()["b"]
    return df.withColumn("forecast_proba", (p >= threshold).cast("double") if binary else p)


def serialised_bars(bars: DataFrame) -> DataFrame:
    """Bars as JSON records with ISO dates and finite numbers."""
    fields = [F.date_format("date", "yyyy-MM-dd").alias("date")]
    fields += [finite(c).alias(c) for c in ("open", "high", "low", "close")]
    fields.append(F.coalesce(F.col("volume"), F.lit(0)).cast("long").alias("volume"))
    return bars.select("ticker", "date", F.to_json(F.struct(*fields)).alias("record"))


def quote_or_close(quotes: DataFrame, bars: DataFrame) -> DataFrame:
    """Live price, else the last stored close with its date and source."""
    last = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("_close"), F.max("date").alias("_date"))
    joined = last.join(quotes.select("ticker", "price"), "ticker", "full")
    live = F.col("price").isNotNull()
    return joined.select(
        "ticker",
        F.coalesce("price", "_close").alias("price"),
        F.when(~live, F.col("_date")).alias("as_of"),
        F.when(live, "live").when(F.col("_close").isNotNull(), "stored").otherwise("none").alias("price_source"),
    )

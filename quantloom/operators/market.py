"""Macro and sector context features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import div
from quantloom.functions.vocabulary import MACRO
from quantloom.operators.asof import asof_backward
from quantloom.operators.technical import by_date, rolling, wilder_rsi

SYMBOLS = ["SPY", "QQQ", "TLT", "GLD", "VIX"]


def clean_symbol(c: Column) -> Column:
    """Index and futures marks become underscores."""
    return F.regexp_replace(c, r"[\^=]", "_")


def macro_panel(series: DataFrame, symbols: list[str] = SYMBOLS) -> DataFrame:
    """Long (symbol, date, close) to one row per date; fixed symbol list, so one aggregate and no discovery pass."""
    tidy = series.filter(F.col("close").isNotNull()).select("date", clean_symbol(F.col("symbol")).alias("symbol"), "close")
    return tidy.groupBy("date").pivot("symbol", symbols).agg(F.first("close"))


def macro_features(panel: DataFrame) -> DataFrame:
    """Nine features on the macro date axis: one row per date, so a single ordered partition is bounded.

    Gaps are padded before a percentage change, as the changes are defined on padded series.
    """
    axis = Window.partitionBy(F.lit(0)).orderBy("date")
    so_far = axis.rowsBetween(Window.unboundedPreceding, 0)
    five = axis.rowsBetween(-4, 0)
    padded = panel.select("*", *[F.last(s, ignorenulls=True).over(so_far).alias(f"_{s}") for s in SYMBOLS])
    moved = padded.select("*", *[(div(f"_{s}", F.lag(f"_{s}", 1).over(axis)) - 1).alias(f"_r{s}") for s in SYMBOLS])
    return moved.select(
        "date",
        F.col("_rSPY").alias("spy_return"),
        F.when(F.count("_rSPY").over(five) >= 5, F.stddev_samp("_rSPY").over(five)).alias("spy_vol_5d"),
        F.col("VIX").alias("vix_level"),
        F.col("_rVIX").alias("vix_change"),
        F.col("_rQQQ").alias("qqq_return"),
        F.col("_rTLT").alias("tlt_return"),
        F.col("_rGLD").alias("gld_return"),
        (F.col("_rSPY") - F.col("_rQQQ")).alias("spy_qqq_spread"),
        (F.col("VIX") / (F.abs("_rSPY") + F.lit(1e-6))).alias("vix_spy_ratio"),
    )


def attach_macro(panel: DataFrame, features: DataFrame) -> DataFrame:
    """As-of macro features on every (ticker, date) row."""
    return asof_backward(panel, features, [], "date", MACRO)


def sector_lookup(tickers: DataFrame, sector_map: DataFrame, available: DataFrame, fallback: str = "SPY") -> DataFrame:
    """Ticker to sector symbol; unknown or unavailable symbols fall back.

    Availability is settled on the ticker dimension, so the rows meet it once, on ticker, and never shuffle on the few symbols.
    """
    known = available.select(F.col("symbol").alias("sector_symbol")).distinct()
    usable = sector_map.select("ticker", "sector_symbol").join(known, "sector_symbol", "left_semi")
    return tickers.join(usable, "ticker", "left").withColumn("sector_symbol", F.coalesce("sector_symbol", F.lit(fallback)))


def sector_features(panel: DataFrame, sector_map: DataFrame, series: DataFrame) -> DataFrame:
    """Sector returns, volatility, RSI and relative returns, all computed after alignment to the ticker's dates.

    ``panel`` holds (ticker, date, returns).
    """
    closes = series.filter(F.col("close").isNotNull()).select(F.col("symbol").alias("sector_symbol"), "date", F.col("close").alias("_sec"))
    rows = sector_lookup(panel, sector_map, series)
    out = asof_backward(rows, closes, ["sector_symbol"], "date", ["_sec"])
    out = out.withColumn("sector_ret1d", div("_sec", F.lag("_sec", 1).over(by_date())) - 1)
    out = out.withColumn("_ret5", div("_sec", F.lag("_sec", 5).over(by_date())) - 1)
    out = out.select(
        "*",
        rolling(F.col("sector_ret1d"), F.stddev_samp, 5, 5).alias("sector_vol5d"),
        (F.col("returns") - F.col("sector_ret1d")).alias("ret1d_vs_sector"),
        (rolling(F.col("returns"), F.sum, 5, 5) - F.col("_ret5")).alias("ret5d_vs_sector"),
    )
    return wilder_rsi(out, "_sec", "sector_rsi").drop("_sec", "_ret5")

"""Per-ticker window features (E1-E15). All share one hash exchange on ticker and one sort by date.

The frames hold the bars of one ticker. (ticker, date) is unique after the merge step, so a frame is bounded by
the trading calendar (about 250 rows a year) however many tickers the universe has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import div
from quantloom.operators.ewm import ewm_mean, span_alpha


def by_date():
    """Rows of a ticker in date order."""
    return Window.partitionBy("ticker").orderBy("date")


def trailing(n: int):
    return by_date().rowsBetween(-(n - 1), 0)


def rolling(value: Column, agg, n: int, min_rows: int = 1) -> Column:
    """``agg`` of the last n rows, NULL until ``min_rows`` non-null values were seen."""
    out = agg(value).over(trailing(n))
    return out if min_rows <= 1 else F.when(F.count(value).over(trailing(n)) >= min_rows, out)


def change(c: str, k: int = 1) -> Column:
    return div(F.col(c), F.lag(c, k).over(by_date())) - 1


def rsi_simple(delta: Column, n: int = 14) -> Column:
    """RSI on plain rolling means; NULL when the window has no loss."""
    gain = F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))
    loss = F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))
    up, down = F.avg(gain).over(trailing(n)), F.avg(loss).over(trailing(n))
    return F.lit(100.0) - F.lit(100.0) / (1 + div(up, F.nullif(down, F.lit(0.0))))


def base_indicators(bars: DataFrame) -> DataFrame:
    """returns, volatility, rsi, sma_*, Bollinger bands, momentum."""
    close = F.col("close")
    step = bars.withColumn("returns", change("close")).withColumn("_delta", close - F.lag("close", 1).over(by_date()))
    return (
        step.select(
            "*",
            F.stddev_samp("returns").over(trailing(20)).alias("volatility"),
            rsi_simple(F.col("_delta")).alias("rsi"),
            *[F.avg("close").over(trailing(n)).alias(f"sma_{n}") for n in (20, 50, 200)],
            F.stddev_samp("close").over(trailing(20)).alias("_sd"),
            (close - F.lag("close", 10).over(by_date())).alias("momentum"),
        )
        .withColumn("bb_upper", F.col("sma_20") + 2 * F.col("_sd"))
        .withColumn("bb_lower", F.col("sma_20") - 2 * F.col("_sd"))
        .withColumn("bb_width", div(F.col("bb_upper") - F.col("bb_lower"), F.nullif(F.col("sma_20"), F.lit(0.0))))
        .drop("_delta", "_sd")
    )


def macd(df: DataFrame) -> DataFrame:
    """macd = ema12 - ema26, its 9-span signal and histogram."""
    out = ewm_mean(df, {"_fast": ("close", span_alpha(12)), "_slow": ("close", span_alpha(26))})
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    out = ewm_mean(out, {"macd_signal": ("macd", span_alpha(9))})
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def lag_features(df: DataFrame) -> DataFrame:
    """Lags of returns, volatility and rsi; volume change and lag."""
    lag = lambda c, k: F.lag(c, k).over(by_date())
    return df.select(
        "*",
        *[lag("returns", k).alias(f"returns_lag{k}") for k in (1, 2, 3, 5)],
        lag("volatility", 5).alias("volatility_lag5"),
        lag("rsi", 3).alias("rsi_lag3"),
        change("volume").alias("volume_change"),
        lag("volume", 1).alias("volume_lag1"),
    )


def technical(bars: DataFrame) -> DataFrame:
    """The technical slice: 13 indicators and 8 lags."""
    return lag_features(macd(base_indicators(bars)))


def price_patterns(df: DataFrame) -> DataFrame:
    """Multi-horizon returns, 52-week distances, relative volume, OBV change, %B."""
    close, volume = F.col("close"), F.col("volume").cast("double")
    have_bands = {"bb_upper", "bb_lower"} <= set(df.columns)
    mid, sd = F.avg("close").over(trailing(20)), F.stddev_samp("close").over(trailing(20))
    out = df.withColumn("_dir", F.coalesce(F.signum(close - F.lag("close", 1).over(by_date())), F.lit(0.0)))
    out = out.withColumn("_obv", F.sum(F.col("_dir") * volume).over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_obv5", F.avg("_obv").over(trailing(5)))
    if not have_bands:
        out = out.withColumn("bb_upper", mid + 2 * sd).withColumn("bb_lower", mid - 2 * sd)
    out = out.select(
        "*",
        *[change("close", k).alias(f"returns_{k}d") for k in (3, 10, 20)],
        (div(close, rolling(close, F.max, 252, 20)) - 1).alias("dist_52w_high"),
        (div(close, rolling(close, F.min, 252, 20)) - 1).alias("dist_52w_low"),
        div(volume, F.nullif(F.avg(volume).over(trailing(20)), F.lit(0.0))).alias("volume_ratio"),
        change("_obv5", 5).alias("obv_change"),
        div(close - F.col("bb_lower"), F.nullif(F.col("bb_upper") - F.col("bb_lower"), F.lit(0.0))).alias("bb_pct"),
    ).drop("_dir", "_obv", "_obv5")
    return out if have_bands else out.drop("bb_upper", "bb_lower")


def rolling_mean(df: DataFrame, source: str, n: int, name: str, min_rows: int | None = None) -> DataFrame:
    """Rolling mean that needs a full window unless told otherwise."""
    return df.withColumn(name, rolling(F.col(source), F.avg, n, n if min_rows is None else min_rows))


def wilder_rsi(df: DataFrame, source: str, name: str, n: int = 14) -> DataFrame:
    """RSI with Wilder smoothing: alpha 1/n on gains and losses, NULL for the first n-1 rows, 100 without losses."""
    delta = F.col(source) - F.lag(source, 1).over(by_date())
    out = df.withColumn("_d", F.coalesce(delta, F.lit(0.0)))
    out = out.withColumn("_up", F.greatest("_d", F.lit(0.0))).withColumn("_down", F.greatest(-F.col("_d"), F.lit(0.0)))
    out = ewm_mean(out, {"_eu": ("_up", 1.0 / n), "_ed": ("_down", 1.0 / n)})
    value = F.when(F.col("_ed") == 0, F.lit(100.0)).otherwise(F.lit(100.0) - F.lit(100.0) / (1 + div("_eu", "_ed")))
    out = out.withColumn(name, F.when(F.row_number().over(by_date()) >= n, value))
    return out.drop("_d", "_up", "_down", "_eu", "_ed")


def every_kth(df: DataFrame, k: int, by: list[str], order: str) -> DataFrame:
    """Rows 0, k, 2k, ... of an ordered daily curve."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") - 1) % k == 0).drop("_n")


def latest_indicators(features: DataFrame, columns: list[str]) -> DataFrame:
    """Last row of every ticker; a hash aggregate, no sort."""
    picked = features.groupBy("ticker").agg(F.max_by(F.struct("date", *columns), "date").alias("_row"))
    return picked.select("ticker", "_row.*")

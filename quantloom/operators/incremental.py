"""Change propagation: what an increment changes in stored bars, and the features from there on.

Per ticker the first changed day is found. Rolling features need the bars of the longest window before it and no more; exponential means go on from
stored state rows (one every ``STATE_EVERY`` bars, and the last), so a ticker with decades of bars costs a few hundred rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.vocabulary import FUNDAMENTAL
from quantloom.operators.ewm import ewm_mean, span_alpha
from quantloom.operators.merge import keep_last
from quantloom.operators.technical import base_indicators, by_date, lag_features

LOOKBACK = 199  # bars before a row that its longest window (200) reaches; lags of shorter windows reach less far
STATE_EVERY = 64
STATE = ["ema_fast", "ema_slow", "macd_signal"]


def first_changes(stored: DataFrame | None, increment: DataFrame, keys: Sequence[str] = ("ticker",), date: str = "date") -> DataFrame:
    """(ticker, first): first day on which the increment adds a row or differs from the stored one; tickers without a change are absent.

    Within the increment the last of repeated rows counts, as in the merge. NULL equals NULL.
    """
    keys = list(keys)
    values = [c for c in increment.columns if c not in (*keys, date)]
    new = keep_last(increment, [*keys, date], [F.struct(*values)] if values else [F.lit(0)])
    if stored is None:
        changed = new
    else:
        known = [c for c in values if c in stored.columns]
        old = stored.select(*keys, date, F.struct(*[F.col(c) for c in known]).alias("_old"), F.lit(True).alias("_have"))
        # a struct of the same columns, cast to the stored types: a merge would keep those
        fresh = F.struct(*[F.col(c).cast(stored.schema[c].dataType).alias(c) for c in known])
        changed = new.join(old, [*keys, date], "left").filter(F.col("_have").isNull() | ~fresh.eqNullSafe(F.col("_old")))
    return changed.groupBy(*keys).agg(F.min(date).alias("first"))


def _tail(bars: DataFrame, first: DataFrame, anchors: DataFrame) -> DataFrame:
    """Bars from the first changed day on, ``LOOKBACK`` bars before it, and those since the state row they start from."""
    marked = bars.join(first, "ticker").join(anchors, "ticker", "left")
    newest = Window.partitionBy("ticker", "_before").orderBy(F.col("date").desc())
    marked = marked.withColumn("_before", F.col("date") < F.col("first")).withColumn("_n", F.row_number().over(newest))
    return marked.filter(~F.col("_before") | (F.col("_n") <= LOOKBACK) | F.col("_anchor").isNull() | (F.col("date") >= F.col("_anchor"))).drop("_before", "_n")


def technical_from(bars: DataFrame, first: DataFrame, state: DataFrame | None) -> DataFrame:
    """Technical rows from each ticker's first changed day on, from the bars and stored state of the tickers in ``first``.

    Besides the features they have the exponential means, the number of the bar and ``state_row``, which marks the rows that ``split_state`` stores as state.
    A ticker without a state row before its first changed day is computed from its first bar. Rows equal those of a whole rebuild but for
    rounding in the last digits of the exponential means.
    """
    if state is None:
        anchors = first.select("ticker", F.lit(None).cast("date").alias("_anchor"), F.lit(0).cast("long").alias("_bars"), *[F.lit(None).cast("double").alias(f"_{c}") for c in STATE]).limit(0)
    else:
        before = state.join(first, "ticker").filter(F.col("date") < F.col("first"))
        anchors = keep_last(before.select("ticker", "date", "bars", *STATE), ["ticker"], ["date"])
        anchors = anchors.select("ticker", F.col("date").alias("_anchor"), F.col("bars").alias("_bars"), *[F.col(c).alias(f"_{c}") for c in STATE])
    rows = base_indicators(_tail(bars, first, anchors))
    # from the state row on; there the stored means stand for the close, which is how the recursion goes on
    start = F.col("date") == F.col("_anchor")
    rows = rows.withColumn("_on", F.col("_anchor").isNull() | (F.col("date") >= F.col("_anchor")))
    seeded = lambda c, own: F.when(start, F.col(f"_{own}")).otherwise(F.col(c))
    rows = rows.withColumn("_f", seeded("close", "ema_fast")).withColumn("_s", seeded("close", "ema_slow"))
    rows = ewm_mean(rows, {"ema_fast": ("_f", span_alpha(12)), "ema_slow": ("_s", span_alpha(26))}, by=("ticker", "_on"))
    rows = rows.withColumn("macd", F.col("ema_fast") - F.col("ema_slow")).withColumn("_m", seeded("macd", "macd_signal"))
    rows = ewm_mean(rows, {"macd_signal": ("_m", span_alpha(9))}, by=("ticker", "_on")).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    place = F.row_number().over(Window.partitionBy("ticker", "_on").orderBy("date")) + F.coalesce("_bars", F.lit(0)) - F.when(F.col("_anchor").isNull(), 0).otherwise(1)
    last = F.max("date").over(Window.partitionBy("ticker"))
    rows = lag_features(rows).select("*", place.cast("long").alias("bars"), last.alias("_last"))
    rows = rows.filter(F.col("date") >= F.col("first")).withColumn("state_row", (F.col("bars") % STATE_EVERY == 0) | (F.col("date") == F.col("_last")))
    return rows.drop("first", "_anchor", "_bars", *[f"_{c}" for c in STATE], "_on", "_f", "_s", "_m", "_last")


def split_state(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(technical slice, state slice) of the rows of ``technical_from``."""
    own = [c for c in STATE if c != "macd_signal"]
    return rows.drop(*own, "bars", "state_row"), rows.filter("state_row").select("ticker", "date", "bars", *STATE)


def fundamental_changes(dates: DataFrame, stored: DataFrame | None, ratios: DataFrame, first: DataFrame) -> DataFrame:
    """Rows (ticker, date, ratios) to replace or add in the fundamental slice.

    ``dates`` are all stored days of the tickers concerned. A ticker with a snapshot gets its ratios on all its days, as a snapshot is undated, but only if one of them
    differs from what is stored; ratios that the snapshot lacks keep their stored value. A ticker without a snapshot carries its latest stored ratios to its new days.
    """
    if stored is None:
        return dates.select("ticker", "date").join(ratios, "ticker", "left").select("ticker", "date", *FUNDAMENTAL)
    newest = keep_last(stored.select("ticker", "date", *FUNDAMENTAL), ["ticker"], ["date"]).drop("date")
    newest = newest.select("ticker", *[F.col(c).alias(f"_{c}") for c in FUNDAMENTAL], F.lit(True).alias("_stored"))
    now = ratios.select("ticker", *FUNDAMENTAL).join(newest, "ticker", "full")
    differs = F.col("_stored").isNull()
    for c in FUNDAMENTAL:
        differs = differs | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")))
    now = now.select("ticker", *[F.coalesce(c, f"_{c}").alias(c) for c in FUNDAMENTAL], differs.alias("_differs"))
    rows = dates.select("ticker", "date").join(now, "ticker", "left").join(first, "ticker", "left")
    return rows.filter(F.col("_differs") | (F.col("date") >= F.col("first"))).select("ticker", "date", *FUNDAMENTAL)


def sentiment_days(dates: DataFrame, first: DataFrame, articles: DataFrame, window: int) -> DataFrame:
    """(ticker, date): days of ``dates`` that are new or whose news window holds one of the ``articles`` (ticker, day)."""
    reached = articles.select("ticker", F.explode(F.sequence("day", F.date_add("day", window - 1))).alias("date")).distinct().withColumn("_news", F.lit(True))
    rows = dates.select("ticker", "date").join(first, "ticker", "left").join(reached, ["ticker", "date"], "left")
    return rows.filter(F.col("_news") | (F.col("date") >= F.col("first"))).select("ticker", "date")

"""Bars, sentiment, merge, deduplication and live indicators on streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantloom.operators.ewm import span_alpha
from quantloom.sources.store import SliceStore


def daily_bars(ticks: DataFrame, delay: str = "1 day") -> DataFrame:
    """Ticks (ts, ticker, value, event_id) to daily OHLCV bars by tumbling event-time windows.

    State is one row per ticker and open day; the watermark closes days.
    """
    order = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "ticker")
    bars = bars.agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return bars.select("ticker", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume")


def rolling_sentiment(scored: DataFrame, window_days: int = 3, delay: str = "1 day") -> DataFrame:
    """Scored articles (ts, ticker, score, label) to sliding-window sentiment, dated by the window's last day."""
    grouped = scored.withWatermark("ts", delay).groupBy(F.window("ts", f"{window_days} days", "1 day").alias("w"), "ticker")
    out = grouped.agg(
        F.avg("score").alias("sentiment_score"),
        F.count(F.lit(1)).alias("news_count"),
        F.avg((F.col("label") == "positive").cast("double")).alias("positive_ratio"),
        F.avg((F.col("label") == "negative").cast("double")).alias("negative_ratio"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sentiment_std"),
    )
    return out.select("ticker", F.date_sub(F.to_date("w.end"), 1).alias("date"), "sentiment_score", "news_count", "positive_ratio", "negative_ratio", "sentiment_std")


def merge_into_store(bars: DataFrame, store: SliceStore, checkpoint: str, name: str = "bars"):
    """Keep-last merge of streamed bars into the stored slice, touched buckets only.

    A replayed micro-batch merges the same rows again and leaves the same table.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.merge(name, batch)

    return bars.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_and_on_time(ticks: DataFrame, newest: Any, delay: str) -> DataFrame:
    """Ticks at or after, and before, ``newest`` minus the delay: how many the watermark would drop."""
    late = F.col("ts") < F.lit(newest) - F.expr(f"INTERVAL {delay}")
    return ticks.groupBy(F.when(late, "late").otherwise("on_time").alias("arrival")).agg(F.count(F.lit(1)).alias("n"))


def drop_duplicate_articles(articles: DataFrame, delay: str = "3 days") -> DataFrame:
    """First article of each url inside the watermark (U4)."""
    return articles.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])


INDICATOR_SCHEMA = "ticker string, date date, last double, ema12 double, ema26 double, macd double, n long"
_STATE = "fast double, slow double, n long, upto long, days array<long>, closes array<double>"
RING = 64  # newest bars of a ticker that may still be corrected
SPANS = (12, 26)


def _means(before: list[float], n: int, closes: list[float]) -> list[float]:
    """Exponential means after ``closes``, going on from ``before``, the means of ``n`` earlier closes."""
    out = []
    for mean, span in zip(before, SPANS, strict=True):
        a = span_alpha(span)
        for k, x in enumerate(closes):
            mean = x if n + k == 0 else (1 - a) * mean + a * x
        out.append(mean)
    return out


def _advance(ring: int, expiry_ms: int, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    fast, slow, n, upto, days, closes = state.get if state.exists else (0.0, 0.0, 0, None, [], [])
    held = dict(zip(days, closes, strict=True))
    rows = pd.concat(list(batches))
    for day, close in zip(pd.to_datetime(rows["date"]).astype("datetime64[s]").astype("int64") // 86_400, rows["close"], strict=True):
        if close == close and (upto is None or day > upto):  # not older than what the ring has left behind
            held[int(day)] = float(close)
    order = sorted(held)
    gone, kept = order[: max(0, len(order) - ring)], order[max(0, len(order) - ring) :]
    if gone:
        fast, slow = _means([fast, slow], n, [held[d] for d in gone])
        n, upto = n + len(gone), gone[-1]
    state.update((fast, slow, n, upto, kept, [held[d] for d in kept]))
    if expiry_ms:
        state.setTimeoutDuration(expiry_ms)
    if kept:
        now = _means([fast, slow], n, [held[d] for d in kept])
        last = pd.Timestamp(kept[-1] * 86_400, unit="s").date()
        yield pd.DataFrame({"ticker": [key[0]], "date": [last], "last": [held[kept[-1]]], "ema12": [now[0]], "ema26": [now[1]], "macd": [now[0] - now[1]], "n": [n + len(kept)]})


def live_indicators(bars: DataFrame, ring: int = RING, expiry_days: int = 0) -> DataFrame:
    """Newest close, EMAs and MACD of every ticker in constant-size state, fed by daily bars, late and corrected ones included.

    The state is the ``ring`` newest bars and the means of all bars before them. A bar inside the ring replaces the one of its day, or takes its place among them, and the
    means are run again from the ring's start; a repeated bar changes nothing; an older bar than the ring holds comes too late. With ``expiry_days`` a
    ticker without bars for so many days (processing time) is forgotten; such a stream waits for its timers, so it runs until it is stopped, whatever its trigger. Of several rows of one day in a batch the last counts; NULL and NaN closes do not count.

    It takes bars, not ticks: a ticker adds one row a day, so what one task sees of it is bounded by the calendar.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expiry_days else GroupStateTimeout.NoTimeout
    return bars.groupBy("ticker").applyInPandasWithState(partial(_advance, ring, expiry_days * 86_400_000), INDICATOR_SCHEMA, _STATE, "update", timeout)

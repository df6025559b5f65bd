import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import fundamentals, labels, market, sentiment, technical
from quantloom.operators.asof import asof_backward
from quantloom.operators.ewm import ewm_mean, span_alpha
from quantloom.operators.panel import combined
from quantloom.operators.projections import signal
from quantloom.functions.vocabulary import FUNDAMENTAL, LAG, SENTIMENT, TECHNICAL
from quantloom.sources import tables


def test_technical_against_pandas(walk):
    df, pdf = walk
    got = technical.technical(df).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    assert set(TECHNICAL + LAG) <= set(got.columns) and len(got) == len(pdf)
    for ticker, part in pdf.groupby("ticker"):
        mine, close = got[got["ticker"] == ticker].reset_index(drop=True), part["close"].reset_index(drop=True)
        ret, delta = close.pct_change(), close.diff()
        up, down = delta.clip(lower=0).rolling(14, min_periods=1).mean(), (-delta).clip(lower=0).rolling(14, min_periods=1).mean()
        macd = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
        mid, sd = close.rolling(20, min_periods=1).mean(), close.rolling(20, min_periods=1).std()
        want = {
            "returns": ret,
            "volatility": ret.rolling(20, min_periods=1).std(),
            "rsi": 100 - 100 / (1 + up / down.replace(0, np.nan)),
            "macd": macd,
            "macd_signal": macd.ewm(span=9, adjust=False).mean(),
            "sma_200": close.rolling(200, min_periods=1).mean(),
            "bb_upper": mid + 2 * sd,
            "momentum": close - close.shift(10),
            "returns_lag3": ret.shift(3),
        }
        for name, series in want.items():
            assert np.allclose(mine[name].to_numpy(dtype=float), series.to_numpy(), rtol=1e-9, atol=1e-9, equal_nan=True), name


def test_ewm_over_many_blocks(spark):
    x = np.random.default_rng(1).normal(50, 5, 4000)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": np.arange(4000), "x": x}))
    with pytest.raises(ValueError, match="too far apart"):
        ewm_mean(df, {"fast": ("x", 0.9), "nine": ("x", span_alpha(9))})
    out = ewm_mean(ewm_mean(df, {"fast": ("x", 0.9)}), {"nine": ("x", span_alpha(9)), "twelve": ("x", span_alpha(12))}).orderBy("date").toPandas()
    assert np.allclose(out["twelve"], pd.Series(x).ewm(span=12, adjust=False).mean())
    assert np.allclose(out["fast"], pd.Series(x).ewm(alpha=0.9, adjust=False).mean())
    assert np.allclose(out["nine"], pd.Series(x).ewm(span=9, adjust=False).mean())


def test_zero_price_gives_null_not_error(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 6)]
    df = spark.createDataFrame([("A", d, c, c, c, c, v) for d, c, v in zip(days, [0.0, 1.0, 2.0, 0.0, 3.0], [0, 0, 5, 0, 1])], "ticker string, date date, open double, high double, low double, close double, volume long")
    out = technical.price_patterns(technical.technical(df)).orderBy("date").collect()
    assert out[1]["returns"] is None and out[4]["returns"] is None and out[2]["returns"] == 1.0
    assert out[2]["volume_change"] is None


def test_rsi_without_losses_is_null_and_wilder_is_100(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, d), float(d)) for d in range(1, 21)], "ticker string, date date, close double")
    plain = df.withColumn("delta", F.col("close") - F.lag("close", 1).over(technical.by_date()))
    assert all(r["rsi"] is None for r in plain.withColumn("rsi", technical.rsi_simple(F.col("delta"))).collect())
    wilder = technical.wilder_rsi(df, "close", "rsi").orderBy("date").collect()
    assert [r["rsi"] for r in wilder[:13]] == [None] * 13 and wilder[13]["rsi"] == 100.0


def test_asof_keeps_null_of_the_matched_row(spark):
    left = spark.createDataFrame([("A", dt.date(2024, 1, d)) for d in (1, 3, 5, 9)], "k string, date date")
    right = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0), ("A", dt.date(2024, 1, 4), None), ("A", dt.date(2024, 1, 9), 3.0)], "k string, date date, v double")
    got = {r["date"].day: r["v"] for r in asof_backward(left, right, ["k"], "date", ["v"]).collect()}
    assert got == {1: None, 3: 1.0, 5: None, 9: 3.0}


def test_macro_changes_are_padded(spark):
    rows = [("SPY", 1, 10.0), ("SPY", 3, 20.0), ("QQQ", 2, 5.0), ("VIX", 1, 15.0)]
    series = spark.createDataFrame([(s, dt.date(2024, 1, d), c) for s, d, c in rows], "symbol string, date date, close double")
    out = {r["date"].day: r for r in market.macro_features(market.macro_panel(series)).collect()}
    assert out[2]["spy_return"] == 0.0 and out[3]["spy_return"] == 1.0
    assert out[2]["vix_level"] is None and out[1]["vix_level"] == 15.0


def test_sentiment_window_against_brute_force(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(int(i)) for i in rng.integers(0, 12, 60)]
    art = pd.DataFrame({"ticker": "A", "day": days, "score": rng.normal(0, 0.4, 60)})
    art["label"] = np.where(art["score"] > 0.1, "positive", np.where(art["score"] < -0.1, "negative", "neutral"))
    dates = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(0, 30, 2)]
    got = sentiment.rolling_features(spark.createDataFrame(art), spark.createDataFrame([("A", d) for d in dates], "ticker string, date date")).toPandas().set_index("date")
    for d in dates:
        hit = art[(art["day"] > d - dt.timedelta(3)) & (art["day"] <= d)]
        row = got.loc[d]
        assert row["news_count"] == len(hit)
        assert abs(row["sentiment_score"] - (hit["score"].mean() if len(hit) else 0)) < 1e-12
        assert abs(row["sentiment_std"] - (hit["score"].std() if len(hit) > 1 else 0)) < 1e-9
        assert abs(row["positive_ratio"] - ((hit["label"] == "positive").mean() if len(hit) else 0)) < 1e-12


def test_no_news_is_zero(spark):
    empty = spark.createDataFrame([], "ticker string, day date, score double, label string")
    out = sentiment.rolling_features(empty, spark.createDataFrame([("A", dt.date(2024, 1, d)) for d in (1, 2, 3)], "ticker string, date date")).collect()
    assert len(out) == 3 and all(r["news_count"] == 0 and r["sentiment_std"] == 0.0 for r in out)


def test_article_filters_and_full_text(spark):
    rows = [("t", "b" * 9000, "2024-01-02T10:00:00Z"), ("", "  ", "2024-01-02"), ("x", None, "not a date"), ("only title", None, "2024-01-03")]
    out = sentiment.usable_articles(spark.createDataFrame(rows, "title string, content string, published_at string")).orderBy("day").collect()
    assert [len(r["text"]) for r in out] == [9003, 10]
    assert out[0]["day"] == dt.date(2024, 1, 2)


def test_number_parse_and_alias_chain(spark):
    raw = ["$1,234.5", " 12% ", "None", "-", "N/A", "", "abc", "NaN", "1e400", None]
    out = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string").orderBy("i").select(fundamentals.parse_number("v")).collect()]
    assert out == [1234.5, 12.0] + [None] * 8
    one = spark.createDataFrame([("A", "", "7", "1.5")], "ticker string, PERatio string, PE string, ROE string")
    assert fundamentals.ratios(one).first()["pe_ratio"] == 7.0


def test_combined_order_and_missing_slice(spark, walk):
    out = combined(technical.base_indicators(walk[0]), None, None)
    lead = [c for c in ["ticker", "date", *TECHNICAL, *FUNDAMENTAL, *SENTIMENT] if c in out.columns]
    assert out.columns[: len(lead)] == lead and out.count() == walk[0].count()


def test_signal_boundaries(spark):
    p = [0.75, 0.70, 0.60, 0.55, 0.50, 0.45, 0.30, None]
    out = [r[1] for r in spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double").select("i", signal(F.col("p"))).orderBy("i").collect()]
    assert out == ["Strong Buy", "Strong Buy", "Buy", "Buy", "Hold", "Hold", "Sell", None]


def test_labels_stay_inside_a_ticker(walk):
    base = technical.base_indicators(walk[0]).select("ticker", "date", "returns")
    assert labels.next_return(base).count() == 260 + 90 - 2
    up = labels.forward_sum_target(base).groupBy("ticker").count().collect()
    assert {r["ticker"]: r["count"] for r in up} == {"AAA": 255, "BBB": 85}


def test_meta_label_nulls_count_as_down(spark):
    rows = [(0.1, 0.6), (-0.1, 0.6), (None, 0.4), (0.1, None)]
    out = [r["meta_label"] for r in labels.meta_label(spark.createDataFrame(rows, "ret_1d double, proba_primary double")).collect()]
    assert out == [1, 0, 1, 0]


def test_first_and_last_price_under_the_whole_order(spark):
    """Ties in the first key are settled by the next ones, NULL keys come first, NULL groups stay."""
    d = dt.date(2024, 1, 1)
    rows = [("A", d, 1.0, 5, 2), ("A", d, 2.0, 5, 1), ("A", d, 3.0, 9, 1), ("A", d, 4.0, 9, 2), ("A", d, 9.0, 7, 1), ("B", d, 1.0, None, 3), ("B", d, 2.0, None, 2), ("B", d, 3.0, 1, 1),
            (None, None, 8.0, None, None)]
    df = spark.createDataFrame(rows, "ticker string, date date, px double, a long, b int")
    bars = tables._ohlcv(df, ["a", "b"], F.count(F.lit(1)))
    got = {r["ticker"]: (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in bars.collect()}
    assert got == {"A": (2.0, 9.0, 1.0, 4.0, 5), "B": (2.0, 3.0, 1.0, 3.0, 3), None: (8.0, 8.0, 8.0, 8.0, 1)}

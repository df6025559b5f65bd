"""Domain views derived from the star-schema tables, so every operator has bars, macro series, news and runs to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars per brand; (ticker, date) is unique by construction."""
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    priced = line.join(part, line.l_partkey == part.p_partkey).select(
        "ticker",
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_quantity",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )
    return _ohlcv(priced, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.sum("l_quantity").cast("long"))


def _ohlcv(priced: DataFrame, order: list[str], volume) -> DataFrame:
    """Bars of priced rows; open and close are the prices of the first and last row under ``order``, NULL first.

    A struct has no fixed width, so aggregates over one sort every row of a task first. The first column of ``order`` alone is aggregated in a hash table;
    only the rows at its two ends are compared on all columns.
    """
    first = order[0]
    whole = F.count(first) == F.count(F.lit(1))
    days = priced.groupBy("ticker", "date").agg(
        F.when(whole, F.min(first)).alias("_lo"), F.max(first).alias("_hi"), F.max("px").alias("high"), F.min("px").alias("low"), volume.alias("volume")
    )
    ends = days.select(F.col("ticker").alias("_ticker"), F.col("date").alias("_date"), "_lo", "_hi")
    same_day = lambda df: F.col("ticker").eqNullSafe(df["_ticker"]) & F.col("date").eqNullSafe(df["_date"])
    near = priced.join(ends, same_day(ends)).filter(F.col(first).eqNullSafe(F.col("_lo")) | F.col(first).eqNullSafe(F.col("_hi")))
    k = F.struct(*order)
    sides = near.groupBy("_ticker", "_date").agg(F.min_by("px", k).alias("open"), F.max_by("px", k).alias("close"))
    return days.join(sides, same_day(sides)).select("ticker", "date", "open", "high", "low", "close", "volume")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "events")
        .filter(F.col("value") > 0)
        .select(
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("U"), (F.col("user_id") % 10).cast("string")).alias("ticker"),
            "value",
            "event_id",
        )
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = ticks(spark, sf_dir).select(
        "ticker", F.col("ts").cast("date").alias("date"), F.col("value").alias("px"), "ts", "event_id"
    )
    return _ohlcv(priced, ["ts", "event_id"], F.count(F.lit(1)))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "SPY")
        .when(F.col("o_orderpriority") == "2-HIGH", "QQQ")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "TLT")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "GLD")
        .otherwise("VIX")
    )
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(symbol.alias("symbol"), F.col("o_orderdate").cast("date").alias("date")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("close")
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("U"), (doc % 10).cast("string")).alias("ticker"),
        "doc_id",
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("content"),
        "source",
        F.concat(F.lit("https://n/"), doc.cast("string")).alias("url"),
        F.concat(
            F.lit("2024-01-"), F.lpad((doc % 30 + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad((doc % 24).cast("string"), 2, "0"), F.lit(":00:00Z")
        ).alias("published_at"),
    )


def market_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same articles under the tickers of the bars, published on days that the bars cover."""
    doc = F.col("doc_id")
    day = F.date_add(F.lit("1995-01-02").cast("date"), (doc * 7 % 2499).cast("int"))
    return news(spark, sf_dir).select(
        F.concat(F.lit("Brand#"), (doc % 25 + 1).cast("string")).alias("ticker"), "doc_id", "title", "content", "source", "url",
        F.concat(day.cast("string"), F.lit("T12:00:00Z")).alias("published_at"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    text = lambda c: c.cast("string")
    brand = F.col("p_brand")
    return part.groupBy(brand.alias("ticker")).agg(
        F.when(F.substring(F.first("p_brand"), 7, 1) == "1", "-").otherwise(text(F.round(F.avg("p_retailprice") / 50, 2))).alias("PERatio"),
        F.concat(text(F.round(F.avg("p_size"), 2)), F.lit("%")).alias("EPS"),
        text(F.round(F.count(F.lit(1)) / F.lit(1000.0), 3)).alias("QuarterlyRevenueGrowthYOY"),
        F.when(F.substring(F.first("p_brand"), 8, 1) == "3", "None").otherwise(text(F.round(F.max("p_size") / F.lit(100.0), 3))).alias("ReturnOnEquityTTM"),
        F.concat(F.lit("$"), text(F.round(F.min("p_retailprice"), 2))).alias("DebtToEquityRatio"),
    )


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.substring("p_brand", 7, 1)
    symbol = F.when(code == "1", "QQQ").when(code == "2", "TLT").when(code == "3", "GLD").when(code == "4", "XLU")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), symbol.alias("sector_symbol")).distinct()


def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        key.cast("string").alias("run_id"),
        F.concat(F.lit("model_"), F.substring(F.lit("abcdef"), (F.col("o_custkey") % 6 + 1).cast("int"), F.lit(1))).alias("model_id"),
        F.when(F.col("o_orderstatus") == "P", "completed").when(F.col("o_orderstatus") == "F", "failed").otherwise("running").alias("status"),
        F.col("o_orderdate").cast("date").alias("created_at"),
        F.round(F.lit(0.5) + (key % 400) / F.lit(1000.0), 6).alias("roc_auc"),
        F.round(F.lit(0.3) + (key % 300) / F.lit(1000.0), 6).alias("f1"),
        F.round(F.lit(0.2) + (key % 90) / F.lit(1000.0), 6).alias("brier"),
    )


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("run_id"),
        F.when(kind == "click", "queued").when(kind == "view", "running").when(kind == "purchase", "completed").otherwise("failed").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
        F.when(kind == "error", "failed: max delivery attempts reached").when(kind == "signup", "boom").alias("error"),
        F.col("ts").cast("timestamp").alias("updated_at"),
    )

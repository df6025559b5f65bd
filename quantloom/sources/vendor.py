"""Payloads and files of data vendors to normal rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import finite

BAR_FIELDS = ("open", "high", "low", "close", "volume")


def _find_columns(columns: list[str], ticker: str | None) -> dict[str, str]:
    """Which source column holds date and each bar field; names only, no data is read."""
    lower = {c.lower(): c for c in columns}
    found = {"date": lower.get("date") or lower.get("datetime") or next((c for c in columns if c.lower().startswith("date") or c.endswith(".Date")), None)}
    for field in BAR_FIELDS:
        found[field] = lower.get(field)
        if found[field] is None and ticker:
            mark = re.compile(rf"^[^.]*{re.escape(ticker.upper())}[^.]*(\..*)?\.{field.upper()}$")
            found[field] = next((c for c in columns if mark.match(c.upper())), None)
    missing = [k for k, v in found.items() if v is None]
    if missing:
        raise ValueError(f"cannot map OHLCV columns; missing={missing}")
    return found


def normalize_bars(df: DataFrame, ticker: str | None = None) -> DataFrame:
    """Any bar frame to (ticker,) date, open, high, low, close, volume: bad numbers NULL, incomplete rows dropped, volume 0 when unknown."""
    found = _find_columns(df.columns, ticker)
    q = lambda c: F.col(f"`{c}`")
    number = lambda c: finite(q(c).try_cast("double"))
    keep = [q(c).alias("ticker") for c in df.columns if c.lower() == "ticker"]
    if ticker and not keep:
        keep = [F.lit(ticker.strip().upper()).alias("ticker")]
    stamp = F.to_date(q(found["date"]).try_cast("timestamp"))
    out = df.select(*keep, stamp.alias("date"), *[number(found[f]).alias(f) for f in BAR_FIELDS])
    out = out.dropna(subset=["date", "open", "high", "low", "close"])
    return out.withColumn("volume", F.coalesce(F.col("volume").cast("long"), F.lit(0).cast("long")))


def import_csv(spark: SparkSession, path: str, symbol_col: str | None = None, ticker: str | None = None) -> DataFrame:
    """CSV bars; one symbol when asked (an error if absent), otherwise every symbol of the file."""
    raw = spark.read.option("header", True).csv(path)
    if symbol_col and symbol_col in raw.columns:
        raw = raw.withColumn("ticker", F.upper(F.col(symbol_col)))
        if ticker:
            key = ticker.strip().upper()
            raw = raw.filter(F.col("ticker") == key)
            if raw.isEmpty():
                raise ValueError(f"no rows for symbol {key!r} in column {symbol_col!r}")
    return normalize_bars(raw, ticker)


def parse_daily_series(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Date-to-fields map of a daily-series payload to bars."""
    series = F.from_json(F.col(column), "map<string,map<string,string>>")
    out = payloads.select("ticker", F.explode(series).alias("day", "f"))
    field = lambda k: F.try_element_at("f", F.lit(k))
    return out.select(
        "ticker",
        F.to_date("day").alias("date"),
        *[field(f"{i}. {name}").try_cast("double").alias(name) for i, name in enumerate(BAR_FIELDS[:4], 1)],
        field("5. volume").try_cast("double").cast("long").alias("volume"),
    )


def parse_quote(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Quote payload to one flat row, blanks and bad numbers NULL, percent sign removed (A10)."""
    quote = F.try_element_at(F.from_json(F.col(column), "map<string,map<string,string>>"), F.lit("Global Quote"))
    out = payloads.withColumn("q", quote).filter(F.size("q") > 0)
    text = lambda k: F.try_element_at("q", F.lit(k))
    number = lambda k: finite(F.nullif(text(k), F.lit("")).try_cast("double"))
    return out.select(
        F.coalesce(text("01. symbol"), F.col("ticker")).alias("symbol"),
        number("02. open").alias("open"),
        number("03. high").alias("high"),
        number("04. low").alias("low"),
        number("05. price").alias("price"),
        number("06. volume").cast("long").alias("volume"),
        text("07. latest trading day").alias("latest_trading_day"),
        number("08. previous close").alias("previous_close"),
        number("09. change").alias("change"),
        F.nullif(F.trim(F.replace(text("10. change percent"), F.lit("%"), F.lit(""))), F.lit("")).alias("change_percent"),
    )


# shapes of the three news payloads
_FEED = "array<struct<headline:string,source:string,url:string,datetime:double,summary:string>>"
_ARTICLES = "struct<articles:array<struct<title:string,source:struct<name:string>,url:string,publishedAt:string,description:string>>>"
_CONTENT = "array<struct<content:struct<title:string,summary:string,provider:struct<displayName:string>,canonicalUrl:struct<url:string>,pubDate:string>>>"


def parse_news(payloads: DataFrame, kind: str, column: str = "payload", max_chars: int | None = None) -> DataFrame:
    """Vendor news payloads of kind ``feed``, ``articles`` or ``content`` to flat article rows with their position."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    if kind == "feed":
        items, a = F.from_json(column, _FEED), F.col("a")
        iso = F.date_format(F.timestamp_seconds(a["datetime"]), "yyyy-MM-dd'T'HH:mm:ssXXX")
        parts = [blank(a["headline"]), unknown(a["source"]), blank(a["url"]), blank(F.replace(iso, F.lit("Z"), F.lit("+00:00"))), blank(a["summary"])]
    elif kind == "articles":
        items, a = F.from_json(column, _ARTICLES)["articles"], F.col("a")
        parts = [blank(a["title"]), unknown(a["source"]["name"]), blank(a["url"]), blank(a["publishedAt"]), blank(a["description"])]
    elif kind == "content":
        items, a = F.from_json(column, _CONTENT), F.col("a")["content"]
        parts = [blank(a["title"]), blank(a["provider"]["displayName"]), blank(a["canonicalUrl"]["url"]), blank(a["pubDate"]), blank(a["summary"])]
    else:
        raise ValueError(f"unknown news payload kind {kind!r}")
    rows = payloads.select(*[c for c in payloads.columns if c != column], F.posexplode(items).alias("position", "a"))
    body = F.substring(parts[4], 1, max_chars) if max_chars else parts[4]
    return rows.select(
        *[c for c in rows.columns if c != "a"],
        parts[0].alias("title"),
        parts[1].alias("source"),
        parts[2].alias("url"),
        parts[3].alias("published_at"),
        body.alias("content"),
    )


def first_per_ticker(articles: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """First ``limit`` articles of every ticker; each input partition keeps at most that many before the shuffle."""
    w = Window.partitionBy("ticker").orderBy(*order)
    return articles.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def universe_from_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """Ticker list from comma lists or a file with # comments: trimmed, upper case, distinct, sorted."""
    kept = lines.select(F.trim(F.col(column)).alias("line")).filter(~F.col("line").startswith("#"))
    words = kept.select(F.explode(F.split("line", ",")).alias("t")).select(F.upper(F.trim("t")).alias("ticker"))
    return words.filter(F.col("ticker") != "").distinct().orderBy("ticker")

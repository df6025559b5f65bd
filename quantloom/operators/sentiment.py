"""News text to daily sentiment features.

Articles are reduced to (ticker, day) partials before anything is joined, so a day with a third of all articles is
combined on the map side; only those partials fan out to the days of the window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.safe import div

# default word lists of the built-in scorer (fixed values)
POSITIVE_WORDS = ["beat", "gain", "growth", "improve", "profit", "rally", "record", "rise", "strong", "upgrade"]
NEGATIVE_WORDS = ["bankruptcy", "cut", "decline", "downgrade", "drop", "fall", "fraud", "lawsuit", "loss", "miss", "weak"]


def article_text(title: Column, body: Column, max_chars: int | None = None) -> Column:
    """Title and body joined by a full stop, either alone when the other is blank (H1)."""
    t, b = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(body, F.lit("")))
    text = F.when((t != "") & (b != ""), F.concat(t, F.lit(". "), b)).when(t != "", t).otherwise(b)
    return F.substring(text, 1, max_chars) if max_chars else text


def headline_text(title: Column, summary: Column, max_chars: int | None = None) -> Column:
    """Title and summary joined by a blank (H2)."""
    text = F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))
    return F.substring(text, 1, max_chars) if max_chars else text


def published_day(c: Column) -> Column:
    """UTC day of a published time, NULL when unparsable (H3)."""
    return F.to_date(F.try_to_timestamp(c))


def usable_articles(news: DataFrame) -> DataFrame:
    """Add day and text, dropping undated and blank articles."""
    return (
        news.withColumn("day", published_day(F.col("published_at")))
        .withColumn("text", article_text(F.col("title"), F.col("content")))
        .filter(F.col("day").isNotNull() & (F.trim("text") != ""))
    )


def lexicon_scores(articles: DataFrame, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> DataFrame:
    """Built-in scorer in native expressions over the whole text.

    Word counts become three shares with half a count of neutral mass; score = P(pos) - P(neg), label = the largest.
    """
    words = F.split(F.lower(F.col("text")), "[^a-z]+")
    count = lambda vocabulary: F.size(F.filter(words, lambda w: w.isin(*vocabulary))).cast("double")
    out = articles.withColumn("_p", count(positive)).withColumn("_n", count(negative))
    mass = F.col("_p") + F.col("_n") + F.lit(0.5)
    out = out.withColumn("positive", F.col("_p") / mass).withColumn("negative", F.col("_n") / mass)
    out = out.withColumn("score", F.col("positive") - F.col("negative"))
    label = F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative").otherwise("neutral")
    return out.withColumn("label", label).drop("_p", "_n")


Scorer = Callable[[pd.Series], pd.DataFrame]


def plugin_scores(articles: DataFrame, load: Callable[[], Scorer]) -> DataFrame:
    """Plug-in scorer (I1): ``load`` runs once per Python worker task, then scores Arrow batches of text.

    The scorer returns columns ``positive`` and ``negative`` in the order of its input.
    """
    added = [T.StructField(n, T.DoubleType()) for n in ("positive", "negative", "score")] + [T.StructField("label", T.StringType())]
    schema = T.StructType(articles.schema.fields + added)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            got = scorer(batch["text"])
            pos, neg = got["positive"].to_numpy(), got["negative"].to_numpy()
            neutral = 1.0 - pos - neg
            label = ["positive" if p > max(n, z) else "negative" if n > max(p, z) else "neutral" for p, n, z in zip(pos, neg, neutral, strict=True)]
            yield batch.assign(positive=pos, negative=neg, score=pos - neg, label=label)

    return articles.mapInPandas(score, schema)


def daily_partials(scored: DataFrame) -> DataFrame:
    """Mergeable (ticker, day) aggregates of article scores."""
    return scored.groupBy("ticker", "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("score").alias("s"),
        (F.coalesce(F.var_pop("score"), F.lit(0.0)) * F.count("score")).alias("m2"),
        F.sum((F.col("label") == "positive").cast("long")).alias("pos"),
        F.sum((F.col("label") == "negative").cast("long")).alias("neg"),
    )


def rolling_features(scored: DataFrame, dates: DataFrame, window: int = 3) -> DataFrame:
    """Calendar-window sentiment on each trading date, zeros without news."""
    window = max(1, int(window))
    spread = daily_partials(scored).select(
        "ticker", F.explode(F.sequence(F.col("day"), F.date_add(F.col("day"), window - 1))).alias("date"), "n", "s", "m2", "pos", "neg"
    )
    merged = spread.groupBy("ticker", "date").agg(
        F.sum("n").alias("news_count"),
        F.sum("s").alias("_s"),
        F.sum(F.col("m2") + F.col("s") * F.col("s") / F.col("n")).alias("_q"),
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
    )
    n = F.col("news_count")
    spread_sq = F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0))
    features = merged.select(
        "ticker",
        "date",
        (F.col("_s") / n).alias("sentiment_score"),
        n,
        (F.col("_pos") / n).alias("positive_ratio"),
        (F.col("_neg") / n).alias("negative_ratio"),
        F.when(n > 1, F.sqrt(div(spread_sq, n - 1))).otherwise(F.lit(0.0)).alias("sentiment_std"),
    )
    return (
        dates.select("ticker", "date")
        .distinct()
        .join(features, ["ticker", "date"], "left")
        .fillna(0, ["sentiment_score", "news_count", "positive_ratio", "negative_ratio", "sentiment_std"])
    )


def static_by_ticker(scored: DataFrame) -> DataFrame:
    """One row per ticker; the ratios are mean probabilities here, not label shares."""
    return scored.groupBy("ticker").agg(
        F.avg("score").alias("sentiment_score"),
        F.count(F.lit(1)).alias("news_count"),
        F.avg("positive").alias("positive_ratio"),
        F.avg("negative").alias("negative_ratio"),
        F.stddev_samp("score").alias("sentiment_std"),
    )

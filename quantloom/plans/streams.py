"""Streaming queries, each run over the available files and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.safe import rounded
from quantloom.operators import sentiment
from quantloom.plans import features  # noqa: F401
from quantloom.plans.inputs import FIXTURE_NEGATIVE, FIXTURE_POSITIVE
from quantloom.plans.registry import query, r
from quantloom.session import scratch_path
from quantloom.sources import store, tables
from quantloom.streaming import jobs, sources


def _latest(stream, name, keys):
    schema = T.StructType(stream.schema.fields)
    return sources.latest_by_key(stream.sparkSession, sources.run_keyed(stream, name), keys, schema)


@query("stream_daily_bars", "U1", "select * from event_bars")
def stream_daily_bars(spark, sf_dir):
    return _latest(jobs.daily_bars(sources.ticks(spark, sf_dir)), "bars", ["ticker", "date"])


def _articles(spark, sf_dir):
    raw = sources.table_stream(spark, sf_dir, "documents.parquet", "doc_id bigint, text string, lang string, source string, n_chars bigint")
    doc = F.col("doc_id")
    published = F.concat(F.lit("2024-01-"), F.lpad((doc % 30 + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad((doc % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))
    return raw.select(
        F.concat(F.lit("U"), (doc % 10).cast("string")).alias("ticker"), "doc_id", F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("https://n/"), doc.cast("string")).alias("url"), published.alias("published_at"), F.try_to_timestamp(published).alias("ts"),
    )


@query("stream_rolling_sentiment", "U2", f"""select ticker, day+o as date, {r("avg(score)")} as sentiment_score, count(*) as news_count, {r("avg(cast(label='positive' as int))")} as positive_ratio,
    {r("avg(cast(label='negative' as int))")} as negative_ratio, {r("coalesce(stddev_samp(score),0)")} as sentiment_std from scored_news, (values (0),(1),(2)) t(o) group by 1,2""")
def stream_rolling_sentiment(spark, sf_dir):
    scored = sentiment.lexicon_scores(sentiment.usable_articles(_articles(spark, sf_dir)), FIXTURE_POSITIVE, FIXTURE_NEGATIVE)
    out = jobs.rolling_sentiment(scored.select("ts", "ticker", "score", "label"))
    return rounded(_latest(out, "sentiment", ["ticker", "date"]))


@query("stream_bar_merge", "U3", "select * from event_bars")
def stream_bar_merge(spark, sf_dir):
    target = store.SliceStore(spark, scratch_path(spark, "merge"), buckets=8)
    stale = tables.event_bars(spark, sf_dir).filter("date < '2024-01-10'").withColumn("close", F.lit(-1.0))
    target.save("bars", stale)
    jobs.merge_into_store(jobs.daily_bars(sources.ticks(spark, sf_dir)), target, scratch_path(spark, "merge-checkpoint")).awaitTermination()
    return target.load("bars")


@query("stream_late_count", "U3", "select case when ts < (select max(ts) from events)-interval 5 day then 'late' else 'on_time' end as arrival, count(*) as n from events where value>0 group by 1")
def stream_late_count(spark, sf_dir):
    ticks = tables.ticks(spark, sf_dir)
    newest = tables.read(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("m")).first()["m"]  # one value
    return jobs.late_and_on_time(ticks, newest, "5 days")


@query("stream_article_dedupe", "U4", "select doc_id, url from news")
def stream_article_dedupe(spark, sf_dir):
    twice = _articles(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    unique = jobs.drop_duplicate_articles(twice.select("ts", "url", "doc_id", "copy"))
    return spark.read.parquet(sources.run_keyed(unique, "articles", "append")).select("doc_id", "url")


_EMA = "list_reduce(list(close order by date), lambda acc, x: acc+{a!r}*(x-acc))"


@query("stream_live_indicators", "U5", f"""select ticker, max(date) as date, max_by(close,date) as last, {r(_EMA.format(a=2 / 13))} as ema12, {r(_EMA.format(a=2 / 27))} as ema26,
    {r(_EMA.format(a=2 / 13) + "-" + _EMA.format(a=2 / 27))} as macd, count(*) as n from event_bars group by 1""")
def stream_live_indicators(spark, sf_dir):
    """Two increments of bars through one checkpoint: the second run starts from the state of the first."""
    bars, folder, out = tables.event_bars(spark, sf_dir).select("ticker", "date", "close"), scratch_path(spark, "bar-files"), None
    for part in ("date < '2024-01-18'", "date >= '2024-01-12'"):  # the overlap arrives twice
        bars.filter(part).write.mode("append").parquet(folder)
        stream = jobs.live_indicators(sources.file_stream(spark, folder, "*.parquet", "ticker string, date date, close double", 1000))
        out = sources.run_keyed(stream, "live", out=out)
    schema = T.StructType(stream.schema.fields)
    return rounded(sources.latest_by_key(spark, out, ["ticker"], schema), 6, skip=["last"])

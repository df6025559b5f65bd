"""The slices after two refreshes, the second a partial one, beside a whole rebuild in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.safe import rounded
from quantloom.functions.vocabulary import FUNDAMENTAL, RATIO_KEYS, SENTIMENT
from quantloom.plans import workflows
from quantloom.plans.features import DIGITS, _list_ewm
from quantloom.plans.registry import query, r, view
from quantloom.session import scratch_path
from quantloom.sources import tables
from quantloom.sources.store import SliceStore

CUT, FIXED = "1998-01-01", "1997-06-01"  # bars known to the first refresh; days from which it had wrong closes
SEEN, AGAIN = "1997-08-01", "1997-07-20"  # news known to the first refresh; days from which the second sends news (again)
TECH = ["returns", "volatility", "rsi", "sma_20", "sma_200", "bb_width", "momentum", "macd", "macd_signal", "macd_hist", "returns_lag2", "volatility_lag5", "rsi_lag3", "volume_change"]

# wrong closes of the middle of the month are corrected later for tickers ending in 1 and 3, which alone get new bars
view("sent_bars", f"select * from bars where date < date '{CUT}' or ticker like '%1' or ticker like '%3'")
view("known_news", """select concat('Brand#', cast(1+doc_id%5 as varchar(2)), cast(1+(doc_id//5)%5 as varchar(2))) as ticker, doc_id, date '1997-01-01' + cast(doc_id*7%300 as int) as day,
  ((doc_id*13)%21-10)/10.0e0 as score from documents""")
view("fresh_steps", "select *, close/nullif(lag(close) over w,0)-1 as returns, close-lag(close) over w as delta from sent_bars window w as (partition by ticker order by date)")
view("fresh_rolling", """select *, 100-100/(1+g/nullif(l,0)) as rsi, 4*sd/nullif(sma_20,0) as bb_width from (select *, stddev_samp(returns) over w20 as volatility,
  avg(case when delta is null then null when delta>0 then delta else 0 end) over w14 as g, avg(case when delta is null then null when delta<0 then -delta else 0 end) over w14 as l,
  avg(close) over w20 as sma_20, avg(close) over w200 as sma_200, stddev_samp(close) over w20 as sd, close-lag(close,10) over w as momentum
  from fresh_steps window w as (partition by ticker order by date), w14 as (partition by ticker order by date rows between 13 preceding and current row),
  w20 as (partition by ticker order by date rows between 19 preceding and current row), w200 as (partition by ticker order by date rows between 199 preceding and current row)) t""")
view("fresh_a", f"select *, {_list_ewm('close', 2 / 13, 'fast')}, {_list_ewm('close', 2 / 27, 'slow')} from fresh_rolling")
view("fresh_b", f"select *, {_list_ewm('fast-slow', 0.2, 'macd_signal')} from fresh_a")
view("fresh_tech", """select *, fast-slow as macd, fast-slow-macd_signal as macd_hist, lag(returns,2) over w as returns_lag2, lag(volatility,5) over w as volatility_lag5, lag(rsi,3) over w as rsi_lag3,
  volume/nullif(lag(volume) over w,0)-1 as volume_change, lag(volume) over w as volume_lag1 from fresh_b window w as (partition by ticker order by date)""")
_number = lambda c: f"case when trim({c}) in ('','None','-','N/A') then null else try_cast(regexp_replace(trim({c}),'[%$,]','','g') as double) end"
_first = lambda name: _number('"' + RATIO_KEYS[name][0] + '"')
view("fresh_ratios", "select ticker, " + ", ".join(f"case when ticker like 'Brand#1%' then 7.5e0 when ticker not like '%2' then {_first(c)} end as eps" if c == "eps" else f"case when ticker not like '%2' then {_first(c)} end as {c}" for c in FUNDAMENTAL) + " from fundamentals")
view("fresh_news", """select b.ticker, b.date, avg(score) as sentiment_score, count(*) as news_count, avg(case when score>0 then 1.0 else 0 end) as positive_ratio,
  avg(case when score<0 then 1.0 else 0 end) as negative_ratio, coalesce(stddev_samp(score),0) as sentiment_std
  from sent_bars b join known_news n on n.ticker=b.ticker and n.day between b.date-2 and b.date group by 1,2""")


def two_refreshes(spark, sf_dir) -> SliceStore:
    """A store after a first refresh of all tickers and a second one of some."""
    bars, day = tables.bars(spark, sf_dir), F.col("date")
    late = F.col("ticker").rlike("[13]$")
    wrong = late & (day >= F.lit(FIXED).cast("date")) & (F.dayofmonth("date") == 15)
    before = bars.filter(day < F.lit(CUT).cast("date")).withColumn("close", F.when(wrong, F.col("close") * 1.01).otherwise(F.col("close")))
    after = bars.filter(late & (day >= F.lit(FIXED).cast("date")))
    ratios = tables.fundamentals(spark, sf_dir)
    blank = [F.lit(None).cast("string").alias(c) for c in ratios.columns if c not in ("ticker", "EPS")]
    score = F.expr("((doc_id*13)%21-10)/10.0D")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    news = docs.select(
        F.expr("concat('Brand#', 1+doc_id%5, 1+(doc_id div 5)%5)").alias("ticker"), F.expr("date_add(date '1997-01-01', cast(doc_id*7%300 as int))").alias("day"), "doc_id", score.alias("score"),
        F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral").alias("label"),
    )
    store = SliceStore(spark, scratch_path(spark, "refresh-slices"), buckets=16)
    universe = bars.select("ticker").distinct()
    workflows.refresh(store, universe, before, ratios.filter(~F.col("ticker").endswith("2")), news.filter(F.col("day") < F.lit(SEEN).cast("date")), "first")
    second = ratios.filter(F.col("ticker").startswith("Brand#1")).select("ticker", F.lit("7.5").alias("EPS"), *blank)
    workflows.refresh(store, universe, after, second, news.filter(F.col("day") >= F.lit(AGAIN).cast("date")), "second")
    return store


_out = lambda c: f"{r(c, DIGITS.get(c, 6))} as {c}"


@query(
    "refresh_slices",
    "T8 G2 A5 A14 A15",
    f"""select t.ticker, t.date, {", ".join(map(_out, TECH))}, close, volume_lag1, {", ".join(map(_out, FUNDAMENTAL))},
    {", ".join(f"coalesce(n.{c},0) as {c}" if c == "news_count" else f"{r(f'cast(coalesce(n.{c},0) as double)')} as {c}" for c in SENTIMENT)}
    from fresh_tech t left join fresh_ratios f on f.ticker=t.ticker left join fresh_news n on n.ticker=t.ticker and n.date=t.date""",
)
def refresh_slices(spark, sf_dir):
    rows = two_refreshes(spark, sf_dir).load("combined").select("ticker", "date", "close", *TECH, "volume_lag1", *FUNDAMENTAL, *SENTIMENT)
    special = {c: d for c, d in DIGITS.items() if c in rows.columns}
    out = rounded(rows, 6, skip=[*special, "close"])
    return out.withColumns({c: F.round(c, d) for c, d in special.items()})

"""Feature queries: window, as-of, range-join and text features, and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.safe import rounded
from quantloom.functions.vocabulary import FUNDAMENTAL, MACRO, SECTOR
from quantloom.operators import fundamentals, labels, market, sentiment, technical
from quantloom.operators.asof import asof_backward
from quantloom.operators.ordering import average_ranks
from quantloom.operators.projections import signal
from quantloom.plans import views  # noqa: F401
from quantloom.plans.inputs import FIXTURE_NEGATIVE, FIXTURE_POSITIVE, indicators, scored
from quantloom.plans.registry import query, r, view
from quantloom.sources import tables

INDICATORS = ["returns", "volatility", "rsi", "sma_20", "sma_50", "sma_200", "bb_upper", "bb_lower", "bb_width", "momentum"]


# columns whose values sit on 7-decimal ties or are too large for 6 decimals
DIGITS = {"momentum": 8, "vix_level": 6, "vix_spy_ratio": 1}


def _rounded_list(names, digits=6):
    return ", ".join(f"{r(n, DIGITS.get(n, digits))} as {n}" for n in names)


def _rounded(df, digits=6):
    special = [c for c in DIGITS if c in df.columns]
    out = rounded(df, digits, skip=special)
    return out.withColumns({c: F.round(c, DIGITS[c]) for c in special}) if special else out


@query("tech_indicators", "E1 E2 E3 E6 E7 E8 H9", f"select ticker, date, {_rounded_list(INDICATORS)} from tech")
def tech_indicators(spark, sf_dir):
    return _rounded(indicators(spark, sf_dir).select("ticker", "date", *INDICATORS))


@query(
    "latest_signal",
    "E26 B11",
    f"""select ticker, date, {_rounded_list(["close", *INDICATORS])}, case when rsi is null then null when {r("rsi/100")}>=0.7 then 'Strong Buy'
    when {r("rsi/100")}>=0.55 then 'Buy' when {r("rsi/100")}>=0.45 then 'Hold' else 'Sell' end as signal
    from (select *, row_number() over (partition by ticker order by date desc) as rn from tech) t where rn=1""",
)
def latest_signal(spark, sf_dir):
    last = technical.latest_indicators(indicators(spark, sf_dir), ["close", *INDICATORS])
    return _rounded(last.withColumn("signal", signal(F.round(F.col("rsi") / 100, 6))))


def _list_ewm(source, alpha, name):
    """Oracle form: fold an ordered list; 700 rows back weigh less than 1e-20."""
    return f"""list_reduce(list({source}) over (partition by ticker order by date rows between 699 preceding and current row),
        lambda acc, x: {1 - alpha!r}*acc + {alpha!r}*x) as {name}"""


view("ewm_a", f"select *, {_list_ewm('close', 2 / 13, 'fast')}, {_list_ewm('close', 2 / 27, 'slow')} from bars")
view("ewm_b", "select *, fast-slow as macd from ewm_a")
view("ewm_c", f"select *, {_list_ewm('macd', 0.2, 'macd_signal')} from ewm_b")


@query(
    "tech_macd",
    "E4 E5",
    f"select ticker, date, {r('macd')} as macd, {r('macd_signal')} as macd_signal, {r('macd-macd_signal')} as macd_hist from ewm_c",
)
def tech_macd(spark, sf_dir):
    return rounded(technical.macd(tables.bars(spark, sf_dir)).select("ticker", "date", "macd", "macd_signal", "macd_hist"))


@query(
    "tech_lags",
    "E9 E10",
    f"""select ticker, date, {r("lag(returns,1) over w")} as returns_lag1, {r("lag(returns,2) over w")} as returns_lag2,
    {r("lag(returns,3) over w")} as returns_lag3, {r("lag(returns,5) over w")} as returns_lag5, {r("lag(volatility,5) over w")} as volatility_lag5,
    {r("lag(rsi,3) over w")} as rsi_lag3, {r("volume/nullif(lag(volume) over w,0)-1")} as volume_change, lag(volume) over w as volume_lag1
    from tech window w as (partition by ticker order by date)""",
)
def tech_lags(spark, sf_dir):
    out = technical.lag_features(indicators(spark, sf_dir))
    return rounded(
        out.select(
            "ticker", "date", "returns_lag1", "returns_lag2", "returns_lag3", "returns_lag5", "volatility_lag5", "rsi_lag3", "volume_change", "volume_lag1"
        )
    )


@query(
    "price_patterns",
    "E11 E12 E13 E14 E15",
    f"""with o as (select *, sum(coalesce(sign(delta),0)*volume) over (partition by ticker order by date) as obv from tech),
    p as (select *, avg(obv) over (partition by ticker order by date rows between 4 preceding and current row) as obv5 from o)
    select ticker, date, {r("close/lag(close,3) over w-1")} as returns_3d, {r("close/lag(close,10) over w-1")} as returns_10d,
    {r("close/lag(close,20) over w-1")} as returns_20d,
    case when count(close) over y>=20 then {r("close/max(close) over y-1")} end as dist_52w_high,
    case when count(close) over y>=20 then {r("close/min(close) over y-1")} end as dist_52w_low,
    {r("volume/nullif(avg(volume) over m,0)")} as volume_ratio, {r("obv5/nullif(lag(obv5,5) over w,0)-1")} as obv_change,
    {r("(close-bb_lower)/nullif(bb_upper-bb_lower,0)")} as bb_pct
    from p window w as (partition by ticker order by date),
      y as (partition by ticker order by date rows between 251 preceding and current row),
      m as (partition by ticker order by date rows between 19 preceding and current row)""",
)
def price_patterns(spark, sf_dir):
    out = technical.price_patterns(indicators(spark, sf_dir))
    return rounded(
        out.select("ticker", "date", "returns_3d", "returns_10d", "returns_20d", "dist_52w_high", "dist_52w_low", "volume_ratio", "obv_change", "bb_pct")
    )


view(
    "macro_wide",
    """select date, max(close) filter (symbol='SPY') as spy, max(close) filter (symbol='QQQ') as qqq, max(close) filter (symbol='TLT') as tlt,
    max(close) filter (symbol='GLD') as gld, max(close) filter (symbol='VIX') as vix from macro group by date""",
)
view(
    "macro_pad",
    """select date, vix, last_value(spy ignore nulls) over w as pspy, last_value(qqq ignore nulls) over w as pqqq,
    last_value(tlt ignore nulls) over w as ptlt, last_value(gld ignore nulls) over w as pgld, last_value(vix ignore nulls) over w as pvix
    from macro_wide window w as (order by date rows between unbounded preceding and current row)""",
)
view(
    "macro_ret",
    """select date, vix, pspy/lag(pspy) over w-1 as rspy, pqqq/lag(pqqq) over w-1 as rqqq, ptlt/lag(ptlt) over w-1 as rtlt,
    pgld/lag(pgld) over w-1 as rgld, pvix/lag(pvix) over w-1 as rvix from macro_pad window w as (order by date)""",
)
view(
    "macro_feat",
    """select date, rspy as spy_return, case when count(rspy) over f>=5 then stddev_samp(rspy) over f end as spy_vol_5d, vix as vix_level,
    rvix as vix_change, rqqq as qqq_return, rtlt as tlt_return, rgld as gld_return, rspy-rqqq as spy_qqq_spread,
    vix/(abs(rspy)+1e-6) as vix_spy_ratio from macro_ret window f as (order by date rows between 4 preceding and current row)""",
)


@query("macro_panel", "A13", "select date, spy as \"SPY\", qqq as \"QQQ\", tlt as \"TLT\", gld as \"GLD\", vix as \"VIX\" from macro_wide")
def macro_panel(spark, sf_dir):
    return market.macro_panel(tables.macro(spark, sf_dir))


@query("macro_features", "E16", f"select date, {_rounded_list(MACRO, 4)} from macro_feat")
def macro_features(spark, sf_dir):
    return _rounded(market.macro_features(market.macro_panel(tables.macro(spark, sf_dir))), 4)


@query(
    "asof_macro",
    "C3",
    f"select b.ticker, b.date, {_rounded_list(MACRO, 4)} from bars b asof left join macro_feat m on b.date>=m.date",
)
def asof_macro(spark, sf_dir):
    panel = tables.bars(spark, sf_dir).select("ticker", "date")
    return _rounded(market.attach_macro(panel, market.macro_features(market.macro_panel(tables.macro(spark, sf_dir)))), 4)


view(
    "sector_rows",
    """select s.ticker, s.date, s.returns, case when k.symbol is null then 'SPY' else m.sector_symbol end as sector_symbol
    from steps s left join sector_map m using (ticker) left join (select distinct symbol from macro) k on k.symbol=m.sector_symbol""",
)
view(
    "sector_aligned",
    "select t.*, q.close as sec from sector_rows t asof left join macro q on t.sector_symbol=q.symbol and t.date>=q.date",
)


@query("sector_lookup", "C5", "select distinct ticker, sector_symbol from sector_rows")
def sector_lookup(spark, sf_dir):
    tickers = tables.bars(spark, sf_dir).select("ticker").distinct()
    return market.sector_lookup(tickers, tables.sector_map(spark, sf_dir), tables.macro(spark, sf_dir))


@query("asof_sector", "C4", "select ticker, date, sector_symbol, sec as sector_close from sector_aligned")
def asof_sector(spark, sf_dir):
    rows = market.sector_lookup(tables.bars(spark, sf_dir).select("ticker", "date"), tables.sector_map(spark, sf_dir), tables.macro(spark, sf_dir))
    closes = tables.macro(spark, sf_dir).select(F.col("symbol").alias("sector_symbol"), "date", F.col("close").alias("sector_close"))
    return asof_backward(rows, closes, ["sector_symbol"], "date", ["sector_close"])


@query(
    "sector_features",
    "E17 E18 E19",
    f"""with d as (select *, sec/nullif(lag(sec) over w,0)-1 as sector_ret1d, sec/nullif(lag(sec,5) over w,0)-1 as ret5,
        coalesce(greatest(sec-lag(sec) over w,0),0) as up, coalesce(greatest(lag(sec) over w-sec,0),0) as down, row_number() over w as n
        from sector_aligned window w as (partition by ticker order by date)),
    e as (select *, {_list_ewm("up", 1 / 14, "eu")}, {_list_ewm("down", 1 / 14, "ed")} from d)
    select ticker, date, {r("returns-sector_ret1d")} as ret1d_vs_sector,
      case when count(returns) over f>=5 then {r("sum(returns) over f-ret5")} end as ret5d_vs_sector, {r("sector_ret1d")} as sector_ret1d,
      case when count(sector_ret1d) over f>=5 then {r("stddev_samp(sector_ret1d) over f")} end as sector_vol5d,
      case when n>=14 then case when ed=0 then 100.0 else {r("100-100/(1+eu/ed)")} end end as sector_rsi
    from e window f as (partition by ticker order by date rows between 4 preceding and current row)""",
)
def sector_features(spark, sf_dir):
    panel = technical.base_indicators(tables.bars(spark, sf_dir)).select("ticker", "date", "returns")
    out = market.sector_features(panel, tables.sector_map(spark, sf_dir), tables.macro(spark, sf_dir))
    return rounded(out.select("ticker", "date", *SECTOR))


@query(
    "rolling_means",
    "E20",
    f"""select ticker, date, case when count(returns) over a>=20 then {r("avg(returns) over a")} end as returns_mean20,
    case when count(up) over b>=60 then {r("avg(up) over b")} end as target_mean60
    from (select *, cast(returns>0 as int) as up from steps) t
    window a as (partition by ticker order by date rows between 19 preceding and current row),
    b as (partition by ticker order by date rows between 59 preceding and current row)""",
)
def rolling_means(spark, sf_dir):
    steps = indicators(spark, sf_dir).withColumn("up", (F.col("returns") > 0).cast("int"))
    out = technical.rolling_mean(steps, "returns", 20, "returns_mean20")
    out = technical.rolling_mean(out, "up", 60, "target_mean60")
    return rounded(out.select("ticker", "date", "returns_mean20", "target_mean60"))


@query(
    "cross_section_ranks",
    "E21",
    ", ".join(
        [
            "select ticker, date",
            *[
                f"""case when {c} is not null then {r(f"(rank() over (partition by date order by {c} nulls last)+(count(*) over (partition by date,{c})-1)/2.0)/count({c}) over (partition by date)")} end as {c}_rank"""
                for c in ("r6", "v6", "m6")
            ],
        ]
    )
    + f" from (select *, {r('rsi')} as r6, {r('volatility')} as v6, {r('momentum', 8)} as m6 from tech) t",
)
def cross_section_ranks(spark, sf_dir):
    rows = indicators(spark, sf_dir).select(
        "ticker", "date", F.round("rsi", 6).alias("r6"), F.round("volatility", 6).alias("v6"), F.round("momentum", 8).alias("m6")
    )
    out = average_ranks(rows, ["date"], {c: f"{c}_rank" for c in ("r6", "v6", "m6")}, pct=True)
    return rounded(out.drop("r6", "v6", "m6"))


_WORDS = lambda words: ",".join(f"'{w}'" for w in words)
view(
    "scored_news",
    f"""select *, (p-n)/(p+n+0.5e0) as score, p/(p+n+0.5e0) as positive, n/(p+n+0.5e0) as negative,
    case when p>n then 'positive' when p<n then 'negative' else 'neutral' end as label
    from (select ticker, doc_id, cast(substring(published_at,1,10) as date) as day, text,
      cast(len(list_filter(words, lambda w: w in ({_WORDS(FIXTURE_POSITIVE)}))) as double) as p,
      cast(len(list_filter(words, lambda w: w in ({_WORDS(FIXTURE_NEGATIVE)}))) as double) as n
      from (select *, string_split_regex(lower(text),'[^a-z]+') as words from
        (select *, case when trim(title)<>'' and trim(content)<>'' then trim(title)||'. '||trim(content)
          when trim(title)<>'' then trim(title) else trim(content) end as text from news) a) b where trim(text)<>'') c""",
)


def scored_news(spark, sf_dir):
    return sentiment.lexicon_scores(sentiment.usable_articles(tables.news(spark, sf_dir)), FIXTURE_POSITIVE, FIXTURE_NEGATIVE)


@query(
    "article_text",
    "H1 H2 H3 I2",
    """select doc_id, md5(text) as text_md5, cast(length(text) as int) as text_chars, day,
    md5(trim(coalesce(title,'')||' '||coalesce(content,''))) as headline_md5 from
    (select *, cast(substring(published_at,1,10) as date) as day, case when trim(title)<>'' and trim(content)<>'' then trim(title)||'. '||trim(content)
          when trim(title)<>'' then trim(title) else trim(content) end as text from news) a where trim(text)<>''""",
)
def article_text(spark, sf_dir):
    out = sentiment.usable_articles(tables.news(spark, sf_dir))
    headline = sentiment.headline_text(F.col("title"), F.col("content"))
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("text_chars"), "day", F.md5(headline).alias("headline_md5"))


@query("article_scores", "I1", f"select doc_id, {r('positive')} as positive, {r('negative')} as negative, {r('score')} as score, label from scored_news")
def article_scores(spark, sf_dir):
    return rounded(scored_news(spark, sf_dir).select("doc_id", "positive", "negative", "score", "label"))


def _word_share_scorer():
    """Stand-in for a heavy model: the same shares computed by a Python callable on Arrow batches."""
    import re

    import pandas as pd

    def score(texts):
        rows = []
        for text in texts:
            words = re.split("[^a-z]+", text.lower())
            p = sum(w in FIXTURE_POSITIVE for w in words)
            n = sum(w in FIXTURE_NEGATIVE for w in words)
            rows.append((p / (p + n + 0.5), n / (p + n + 0.5)))
        return pd.DataFrame(rows, columns=["positive", "negative"])

    return score


@query("article_scores_plugin", "I1", f"select doc_id, {r('positive')} as positive, {r('negative')} as negative, {r('score')} as score from scored_news")
def article_scores_plugin(spark, sf_dir):
    articles = sentiment.usable_articles(tables.news(spark, sf_dir)).select("doc_id", "text")
    return rounded(sentiment.plugin_scores(articles, _word_share_scorer).select("doc_id", "positive", "negative", "score"))


@query(
    "sentiment_daily",
    "C9 I3 I4 I5",
    f"""with d as (select distinct ticker, date from event_bars)
    select d.ticker, d.date, {r("coalesce(avg(score),0)")} as sentiment_score, count(score) as news_count,
    {r("coalesce(avg(cast(label='positive' as int)),0)")} as positive_ratio, {r("coalesce(avg(cast(label='negative' as int)),0)")} as negative_ratio,
    {r("coalesce(stddev_samp(score),0)")} as sentiment_std
    from d left join scored_news s on s.ticker=d.ticker and s.day between d.date-2 and d.date group by 1,2""",
)
def sentiment_daily(spark, sf_dir):
    return rounded(sentiment.rolling_features(scored_news(spark, sf_dir), tables.event_bars(spark, sf_dir)))


@query(
    "sentiment_static",
    "D8 I6",
    f"""select ticker, {r("avg(score)")} as sentiment_score, count(*) as news_count, {r("avg(positive)")} as positive_ratio,
    {r("avg(negative)")} as negative_ratio, {r("stddev_samp(score)")} as sentiment_std from scored_news group by 1""",
)
def sentiment_static(spark, sf_dir):
    return rounded(sentiment.static_by_ticker(scored_news(spark, sf_dir)))


@query(
    "join_static_sentiment",
    "C7",
    f"""select b.ticker, b.date, s.news_count, {r("s.score")} as sentiment_score from event_bars b left join
    (select ticker, count(*) as news_count, avg(score) as score from scored_news where ticker<>'U3' group by 1) s on s.ticker=b.ticker""",
)
def join_static_sentiment(spark, sf_dir):
    static = sentiment.static_by_ticker(scored_news(spark, sf_dir).filter(F.col("ticker") != "U3"))
    rows = tables.event_bars(spark, sf_dir).select("ticker", "date")
    return rounded(rows.join(static.select("ticker", "news_count", "sentiment_score"), "ticker", "left"))


def _parsed(c):
    return f"case when trim({c}) in ('','None','-','N/A') then null else try_cast(regexp_replace(trim({c}),'[%$,]','','g') as double) end"


view(
    "ratios",
    f"""select ticker, {_parsed('"PERatio"')} as pe_ratio, {_parsed('"EPS"')} as eps, {_parsed('"QuarterlyRevenueGrowthYOY"')} as revenue_growth,
    {_parsed('"ReturnOnEquityTTM"')} as roe, {_parsed('"DebtToEquityRatio"')} as debt_to_equity from fundamentals""",
)


@query("fundamental_ratios", "J1 B9", "select * from ratios")
def fundamental_ratios(spark, sf_dir):
    return fundamentals.ratios(tables.fundamentals(spark, sf_dir))


@query(
    "fundamental_alias_keys",
    "B10 H13",
    """select ticker, try_cast(coalesce(nullif(a,''),nullif(b,'')) as double) as pe_ratio, try_cast(c as double) as roe from
    (select ticker, case when ticker like '%1' then '' else '7.5' end as a, '9.25' as b, "ReturnOnEquityTTM" as c from fundamentals) t""",
)
def fundamental_alias_keys(spark, sf_dir):
    raw = tables.fundamentals(spark, sf_dir)
    as_map = F.create_map(
        F.lit("PERatio"), F.when(F.col("ticker").endswith("1"), "").otherwise("7.5"), F.lit("PE"), F.lit("9.25"), F.lit("ROE"), F.col("ReturnOnEquityTTM")
    )
    return fundamentals.ratios(raw.withColumn("doc", as_map), "doc").select("ticker", "pe_ratio", "roe")


@query(
    "fundamental_daily",
    "J2 C6",
    "select b.ticker, b.date, pe_ratio, eps, revenue_growth, roe, debt_to_equity from bars b left join ratios r on r.ticker=b.ticker",
)
def fundamental_daily(spark, sf_dir):
    return fundamentals.daily_static(tables.bars(spark, sf_dir), fundamentals.ratios(tables.fundamentals(spark, sf_dir)))


view(
    "ratio_history",
    """select ticker, cast(x.d as date) as date, pe_ratio*x.f as pe_ratio, eps*x.f as eps, revenue_growth*x.f as revenue_growth, roe*x.f as roe,
    debt_to_equity*x.f as debt_to_equity from ratios, (values ('1994-06-30',1.0e0),('1996-12-31',2.0e0)) x(d,f)""",
)


@query(
    "fundamental_point_in_time",
    "J2",
    "select b.ticker, b.date, " + _rounded_list(FUNDAMENTAL) + " from bars b asof left join ratio_history h on h.ticker=b.ticker and b.date>=h.date",
)
def fundamental_point_in_time(spark, sf_dir):
    now = fundamentals.ratios(tables.fundamentals(spark, sf_dir))
    editions = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(f).alias("f")) for d, f in (("1994-06-30", 1.0), ("1996-12-31", 2.0))]))
    history = now.withColumn("_x", editions).select("ticker", F.col("_x.d").alias("fetched_at"), *[(F.col(c) * F.col("_x.f")).alias(c) for c in FUNDAMENTAL])
    return rounded(fundamentals.daily_point_in_time(tables.bars(spark, sf_dir), history))


@query(
    "label_next_return",
    "K1",
    f"""select * from (select ticker, date, {r("lead(returns) over w")} as forward_return, cast(lead(returns) over w>0 as int) as target
    from steps window w as (partition by ticker order by date)) t where forward_return is not null""",
)
def label_next_return(spark, sf_dir):
    return rounded(labels.next_return(indicators(spark, sf_dir).select("ticker", "date", "returns")).drop("returns"))


_FWD = """select ticker, date, sum(returns) over f as fwd, count(returns) over f as n, count(*) over f as ahead
    from steps window f as (partition by ticker order by date rows between 1 following and 5 following)"""


@query(
    "label_forward_sum_up",
    "K2",
    f"""select ticker, date, case when n=5 then {r("fwd")} end as fwd_5d, cast(coalesce(n=5 and fwd>0.01, false) as int) as target_up_5d
    from ({_FWD}) t where ahead=5""",
)
def label_forward_sum_up(spark, sf_dir):
    return rounded(labels.forward_sum_target(indicators(spark, sf_dir).select("ticker", "date", "returns")).drop("returns"))


@query("label_forward_sum", "K3", f"select ticker, date, {r('fwd')} as fwd_return from ({_FWD}) t where n=5")
def label_forward_sum(spark, sf_dir):
    return rounded(labels.forward_sum(indicators(spark, sf_dir).select("ticker", "date", "returns")).drop("returns"))


@query(
    "label_top_quarter",
    "K4",
    f"""select ticker, date, fwd_return, cast((rank() over (partition by date order by fwd_return)+(count(*) over (partition by date,fwd_return)-1)/2.0)
    /count(*) over (partition by date)>0.75 as int) as target from (select ticker, date, {r("fwd", 8)} as fwd_return from ({_FWD}) t where n=5) u""",
)
def label_top_quarter(spark, sf_dir):
    rows = labels.forward_sum(indicators(spark, sf_dir).select("ticker", "date", "returns")).drop("returns")
    return labels.top_share_target(rows.withColumn("fwd_return", F.round("fwd_return", 8)))


@query(
    "label_horizon",
    "K5",
    f"""select * from (select ticker, date, {r("lead(returns,3) over w")} as future_return, cast(lead(returns,3) over w>0 as int) as target
    from steps window w as (partition by ticker order by date)) t where future_return is not null""",
)
def label_horizon(spark, sf_dir):
    return rounded(labels.horizon_label(indicators(spark, sf_dir).select("ticker", "date", "returns"), 3).drop("returns"))


@query(
    "label_meta",
    "K6",
    "select ticker, date, cast((coalesce(ret_1d>0,false))=(score>=0.5) as int) as meta_label from scored",
)
def label_meta(spark, sf_dir):
    return labels.meta_label(scored(spark, sf_dir), "ret_1d", "score").select("ticker", "date", "meta_label")

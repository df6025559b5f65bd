"""Source, sink, projection, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.safe import clip, finite, rounded, sigmoid, to_number
from quantloom.functions.vocabulary import FUNDAMENTAL, SENTIMENT
from quantloom.operators import crosssection, fundamentals, merge, panel, projections, quality, runs, sentiment, technical
from quantloom.operators.ordering import exact_quantiles
from quantloom.plans import views  # noqa: F401
from quantloom.plans.features import scored_news
from quantloom.plans.inputs import indicators, scored
from quantloom.plans.registry import query, r, view
from quantloom.session import scratch_path
from quantloom.sources import store, tables, vendor

# --- stored tables -------------------------------------------------------------------------------------------


def saved(spark, sf_dir, name="bars", df=None):
    s = store.SliceStore(spark, scratch_path(spark, "store"), buckets=8)
    s.save(name, tables.event_bars(spark, sf_dir) if df is None else df)
    return s


@query("bars_write_read", "A1 A5", "select * from event_bars where ticker='U3'")
def bars_write_read(spark, sf_dir):
    return saved(spark, sf_dir).load("bars", " u3 ")


@query("bars_tickers", "A2", "select distinct upper(ticker) as ticker from event_bars")
def bars_tickers(spark, sf_dir):
    return saved(spark, sf_dir).tickers()


@query("fundamentals_json", "A3 A6", "select * from fundamentals")
def fundamentals_json(spark, sf_dir):
    path = scratch_path(spark, "fundamentals")
    raw = tables.fundamentals(spark, sf_dir)
    store.write_json_records(raw, path)
    return store.read_fundamentals(spark, path, [c for c in raw.columns if c != "ticker"])


@query("news_json", "A4 A6", "select ticker, source, url, published_at, md5(title) as title_md5, md5(content) as content_md5 from news")
def news_json(spark, sf_dir):
    path = scratch_path(spark, "news")
    store.write_json_records(tables.news(spark, sf_dir).drop("doc_id"), path)
    out = store.read_news(spark, path)
    return out.select("ticker", "source", "url", "published_at", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"))


@query("csv_import", "A7 A17", "select * from event_bars")
def csv_import(spark, sf_dir):
    path = scratch_path(spark, "csv")
    store.write_result(tables.event_bars(spark, sf_dir).withColumn("Symbol", F.lower("ticker")).drop("ticker"), path)
    return vendor.import_csv(spark, path, "Symbol").select("ticker", "date", "open", "high", "low", "close", "volume")


@query("bars_normalise", "A8 B8", """select ticker, date, open, high, low, close, case when day%3=0 then 0 else volume end as volume
    from (select *, extract(day from date) as day from event_bars) t where day%5<>0 and day%7<>0""")
def bars_normalise(spark, sf_dir):
    day = F.dayofmonth("date")
    text = lambda c: F.col(c).cast("string")
    messy = tables.event_bars(spark, sf_dir).select(
        "ticker",
        F.when(day % 7 == 0, "soon").otherwise(text("date")).alias("DateTime"),
        text("open").alias("U.Open"),
        text("high").alias("U.High"),
        text("low").alias("U.Low"),
        F.when(day % 5 == 0, "n/a").otherwise(text("close")).alias("U.Close"),
        F.when(day % 3 == 0, "").otherwise(text("volume")).alias("U.Volume"),
    )
    return vendor.normalize_bars(messy, "U")


@query("vendor_daily_series", "A9", "select * from event_bars")
def vendor_daily_series(spark, sf_dir):
    bars = tables.event_bars(spark, sf_dir)
    fields = F.create_map(*[x for i, f in enumerate(vendor.BAR_FIELDS, 1) for x in (F.lit(f"{i}. {f}"), F.col(f).cast("string"))])
    payloads = bars.groupBy("ticker").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), fields)))).alias("payload"))
    return vendor.parse_daily_series(payloads)


@query("vendor_quote", "A10", """select ticker as symbol, open, high, low, close as price, volume, cast(date as varchar) as latest_trading_day, cast(null as double) as previous_close,
    cast(null as double) as change, case when volume%2=0 then '1.5' end as change_percent from event_bars""")
def vendor_quote(spark, sf_dir):
    t = lambda c: F.col(c).cast("string")
    quote = F.create_map(
        F.lit("01. symbol"), F.col("ticker"), F.lit("02. open"), t("open"), F.lit("03. high"), t("high"), F.lit("04. low"), t("low"),
        F.lit("05. price"), t("close"), F.lit("06. volume"), t("volume"), F.lit("07. latest trading day"), t("date"),
        F.lit("08. previous close"), F.lit(""), F.lit("09. change"), F.lit("abc"),
        F.lit("10. change percent"), F.when(F.col("volume") % 2 == 0, " 1.5% ").otherwise(""),
    )
    payloads = tables.event_bars(spark, sf_dir).select("ticker", F.to_json(F.create_map(F.lit("Global Quote"), quote)).alias("payload"))
    return vendor.parse_quote(payloads)


_NEWS_OUT = "doc_id, md5(title) as title_md5, coalesce(nullif(source,''),'unknown') as source, url, md5(content) as content_md5"


def _news_out(df):
    return df.select("doc_id", F.md5("title").alias("title_md5"), "source", "url", F.md5("content").alias("content_md5"), "published_at")


@query("vendor_news_feed", "A11 H14", f"select {_NEWS_OUT}, cast(make_timestamp(cast(1700000000+doc_id as bigint)*1000000) as varchar)[1:10]||'T'||cast(make_timestamp(cast(1700000000+doc_id as bigint)*1000000) as varchar)[12:19]||'+00:00' as published_at from news")
def vendor_news_feed(spark, sf_dir):
    item = F.struct(
        F.col("title").alias("headline"), "source", "url", (F.col("doc_id") + 1_700_000_000).alias("datetime"), F.col("content").alias("summary")
    )
    payloads = tables.news(spark, sf_dir).select("ticker", "doc_id", F.to_json(F.array(item)).alias("payload"))
    return _news_out(vendor.parse_news(payloads, "feed"))


@query("vendor_news_articles", "A11", f"select {_NEWS_OUT}, published_at from news")
def vendor_news_articles(spark, sf_dir):
    item = F.struct(
        "title", F.struct(F.col("source").alias("name")).alias("source"), "url", F.col("published_at").alias("publishedAt"), F.col("content").alias("description")
    )
    payloads = tables.news(spark, sf_dir).select("ticker", "doc_id", F.to_json(F.struct(F.array(item).alias("articles"))).alias("payload"))
    return _news_out(vendor.parse_news(payloads, "articles"))


@query("vendor_news_content", "A11", "select doc_id, md5(title) as title_md5, source, url, md5(content) as content_md5, published_at from news")
def vendor_news_content(spark, sf_dir):
    content = F.struct(
        "title", F.col("content").alias("summary"), F.struct(F.col("source").alias("displayName")).alias("provider"),
        F.struct("url").alias("canonicalUrl"), F.col("published_at").alias("pubDate"),
    )
    payloads = tables.news(spark, sf_dir).select("ticker", "doc_id", F.to_json(F.array(F.struct(content.alias("content")))).alias("payload"))
    return _news_out(vendor.parse_news(payloads, "content"))


@query("news_first_per_ticker", "A11", "select ticker, doc_id from (select *, row_number() over (partition by ticker order by published_at desc, doc_id) as k from news) t where k<=20")
def news_first_per_ticker(spark, sf_dir):
    return vendor.first_per_ticker(tables.news(spark, sf_dir), 20, [F.col("published_at").desc(), F.col("doc_id")]).select("ticker", "doc_id")


@query("fundamentals_record", "A12", """select ticker, "PERatio" as pe_ratio, "EPS" as eps, "ReturnOnEquityTTM" as roe, '2024-01-31' as fetched_at, cast(null as varchar) as sector from fundamentals""")
def fundamentals_record(spark, sf_dir):
    raw = tables.fundamentals(spark, sf_dir).select(
        "ticker", F.col("PERatio").alias("trailingPE"), F.col("EPS").alias("trailingEps"), F.col("ReturnOnEquityTTM").alias("returnOnEquity"), F.lit("2024-01-31").alias("fetched_at")
    )
    return fundamentals.vendor_record(raw).select("ticker", "pe_ratio", "eps", "roe", "fetched_at", "sector")


def _store_with_slices(spark, sf_dir):
    bars = tables.event_bars(spark, sf_dir)
    s = saved(spark, sf_dir, "technical", technical.base_indicators(bars))
    s.save("sentiment", sentiment.rolling_features(scored_news(spark, sf_dir), bars))
    return s


@query("feature_store_panel", "A14 A15 B3 B4", f"""with e as (select *, close/nullif(lag(close) over w,0)-1 as returns from event_bars window w as (partition by ticker order by date))
    select e.ticker, e.date, {r("returns")} as returns, cast(null as double) as pe_ratio, count(s.score) as news_count from e
    left join scored_news s on s.ticker=e.ticker and s.day between e.date-2 and e.date group by all""")
def feature_store_panel(spark, sf_dir):
    out = _store_with_slices(spark, sf_dir).load("combined")
    return rounded(out.select("ticker", "date", "returns", "pe_ratio", "news_count"))


@query("feature_store_exists", "A14", "select * from (values ('technical',true),('fundamental',false),('sentiment',true),('combined',true)) t(slice,present) where exists (select 1 from events)")
def feature_store_exists(spark, sf_dir):
    s = _store_with_slices(spark, sf_dir)
    rows = [(n, s.exists(n)) for n in ("technical", "fundamental", "sentiment", "combined")]
    return spark.createDataFrame(rows, "slice string, present boolean")


view("curves", "select ticker, date, close, close*2 as equity from event_bars")


@query("nested_curve_round_trip", "A18", "select ticker, date, close, equity from curves")
def nested_curve_round_trip(spark, sf_dir):
    path = scratch_path(spark, "results")
    bars = tables.event_bars(spark, sf_dir).select("ticker", "date", "close", (F.col("close") * 2).alias("equity"))
    store.nest_curves(bars, ["ticker"], ["close", "equity"]).write.parquet(path)
    return store.unnest_curves(spark.read.parquet(path), ["ticker"])


@query("lineage_latest", "A19", """select model_id as ticker, run_id, status, created_at from (select *, row_number() over (partition by model_id order by created_at desc, run_id desc) as k from training_runs) t where k=1""")
def lineage_latest(spark, sf_dir):
    path = scratch_path(spark, "lineage")
    rows = tables.training_runs(spark, sf_dir).select(F.col("model_id").alias("ticker"), "run_id", "status", "created_at")
    store.append_lineage(rows.filter("status = 'completed'"), path)
    store.append_lineage(rows.filter("status <> 'completed'"), path)
    back = spark.read.schema("ticker string, run_id string, status string, created_at date").json(path)
    return merge.latest_per_key(back, ["ticker"], ["created_at", "run_id"])


@query("artifact_freshness", "A20")
def artifact_freshness(spark, sf_dir):
    s = _store_with_slices(spark, sf_dir)
    return store.artifact_freshness(spark, {n: s.path(n) for n in ("technical", "sentiment")})


@query("data_freshness", "A20", "select ticker, max(date) as last_date, cast((select max(date) from bars)-max(date) as int) as days_behind from bars group by 1")
def data_freshness(spark, sf_dir):
    return store.data_freshness(tables.bars(spark, sf_dir))


@query("runs_upsert", "A21", """select run_id, model_id, case when cast(run_id as bigint)%3=0 then 'completed' else status end as status,
    case when cast(run_id as bigint)%3=0 then created_at+1 else created_at end as created_at from training_runs""")
def runs_upsert(spark, sf_dir):
    rows = tables.training_runs(spark, sf_dir).select("run_id", "model_id", "status", "created_at")
    changes = rows.filter(F.col("run_id").cast("long") % 3 == 0).withColumn("status", F.lit("completed")).withColumn("created_at", F.date_add("created_at", 1))
    return merge.upsert(rows, changes, ["run_id"], "created_at")


@query("ticker_universe", "A22 B14", "select distinct upper(trim(ticker)) as ticker from sector_map")
def ticker_universe(spark, sf_dir):
    lines = tables.sector_map(spark, sf_dir).select(F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ,, "), F.upper("ticker")).alias("value"))
    noise = spark.range(1).select(F.lit("# a comment, not a ticker").alias("value"))
    return vendor.universe_from_text(lines.unionByName(noise))


# --- projections and filters ---------------------------------------------------------------------------------


@query("bars_between", "B1", "select ticker, date, close from bars where date between date '1996-01-01' and date '1996-12-31'")
def bars_between(spark, sf_dir):
    return projections.between_dates(tables.bars(spark, sf_dir), "1996-01-01", "1996-12-31").select("ticker", "date", "close")


@query("bars_last_period", "B2", """select '3m' as period, ticker, date from (select *, row_number() over (partition by ticker order by date desc) as k from bars) t where k<=66
    union all select 'other', ticker, date from (select *, row_number() over (partition by ticker order by date desc) as k from bars) t where k<=252""")
def bars_last_period(spark, sf_dir):
    bars = tables.bars(spark, sf_dir).select("ticker", "date")
    pick = lambda p: projections.last_rows(bars, p).withColumn("period", F.lit(p))
    return merge.stack([pick("3m"), pick("other")])


@query("complete_rows", "B5", "select ticker, date from tech where rsi is not null and volatility is not null and momentum is not null")
def complete_rows(spark, sf_dir):
    return indicators(spark, sf_dir).dropna(subset=["rsi", "volatility", "momentum"]).select("ticker", "date")


@query("filled_rows", "B6", f"select ticker, date, {r('coalesce(rsi,0)')} as rsi, {r('coalesce(volatility,0)')} as volatility from tech")
def filled_rows(spark, sf_dir):
    return rounded(indicators(spark, sf_dir).fillna(0.0, ["rsi", "volatility"]).select("ticker", "date", "rsi", "volatility"))


view("train_rows", "select * from tech where date < date '1998-01-01'")


@query("impute_median", "B7", f"""select ticker, date, {r("coalesce(rsi,(select quantile_cont(rsi,0.5) from train_rows))")} as rsi,
    {r("coalesce(momentum,(select quantile_cont(momentum,0.5) from train_rows))", 8)} as momentum from tech""")
def impute_median(spark, sf_dir):
    rows = indicators(spark, sf_dir).select("ticker", "date", "rsi", "momentum")
    medians = projections.learn_medians(rows.filter("date < '1998-01-01'"), ["rsi", "momentum"])
    out = projections.impute(rows, medians)
    return out.withColumn("rsi", F.round("rsi", 6)).withColumn("momentum", F.round("momentum", 8))


@query("exact_quantiles", "B7 B19", f"""select f as feature, {r("quantile_cont(v,0.01)")} as low, {r("quantile_cont(v,0.5)")} as median, {r("quantile_cont(v,0.99)")} as high
    from (select 'rsi' as f, rsi as v from tech union all select 'volatility', volatility from tech) t group by 1""")
def quantiles(spark, sf_dir):
    return rounded(exact_quantiles(indicators(spark, sf_dir), ["rsi", "volatility"], {"low": 0.01, "median": 0.5, "high": 0.99}))


@query("clip_quantiles", "B19", f"""select ticker, date, case when rsi is not null then {r("least(greatest(rsi,(select quantile_cont(rsi,0.01) from tech)),(select quantile_cont(rsi,0.99) from tech))")} end as rsi,
    case when volatility is not null then {r("least(greatest(volatility,(select quantile_cont(volatility,0.01) from tech)),(select quantile_cont(volatility,0.99) from tech))")} end as volatility from tech""")
def clip_quantiles(spark, sf_dir):
    rows = indicators(spark, sf_dir).select("ticker", "date", "rsi", "volatility")
    return rounded(projections.clip_to_quantiles(rows, ["rsi", "volatility"]))


@query("number_coercion", "B8 B18", "select event_id, try_cast(json_extract_string(props,'$.k') as double) as k, cast(null as double) as bad, case when value>400 then null else value end as finite_value from events")
def number_coercion(spark, sf_dir):
    events = tables.read(spark, sf_dir, "events")
    huge = F.when(F.col("value") > 450, F.lit(float("inf"))).when(F.col("value") > 400, F.lit(float("nan"))).otherwise(F.col("value"))
    return events.select("event_id", to_number(F.get_json_object("props", "$.k")).alias("k"), to_number("event_type").alias("bad"), finite(huge).alias("finite_value"))


@query("number_parse", "B9 H15", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case l_returnflag when 'A' then l_extendedprice when 'N' then l_discount end as parsed from lineitem""")
def number_parse(spark, sf_dir):
    flag, text = F.col("l_returnflag"), lambda c: F.col(c).cast("string")
    raw = F.when(flag == "A", F.concat(F.lit("$"), text("l_extendedprice"))).when(flag == "N", F.concat(text("l_discount"), F.lit(" %"))).otherwise("N/A")
    cleaned = fundamentals.parse_number(raw)
    return tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", cleaned.alias("parsed"))


@query("signals", "B11 B12 B13 H6", f"""select ticker, date, case when score>=0.7 then 'Strong Buy' when score>=0.55 then 'Buy' when score>=0.45 then 'Hold' else 'Sell' end as signal,
    {r("abs(score-0.5)*2")} as confidence, cast(score>=0.5 as int) as predicted, {r("1/(1+exp(-score))")} as squashed, {r("least(greatest(score,0.01),0.99)")} as clipped from scored""")
def signals(spark, sf_dir):
    p = F.col("score")
    return rounded(
        scored(spark, sf_dir).select(
            "ticker", "date", projections.signal(p).alias("signal"), projections.confidence(p).alias("confidence"),
            projections.predicted_class(p).alias("predicted"), sigmoid(p).alias("squashed"), clip(p, 0.01, 0.99).alias("clipped"),
        )
    )


@query("schema_violations", "B15", """select * from (select 'close' as "column", 'null_value' as rule, count(*) filter (extract(day from date)%5=0) as n_bad from event_bars
    union all select 'adjusted', 'missing_column', 1 union all select 'date', 'bad_date', count(*) filter (extract(day from date)%7=0) from event_bars) t where n_bad>0""")
def schema_violations(spark, sf_dir):
    day = F.dayofmonth("date")
    rows = tables.event_bars(spark, sf_dir).withColumn("close", F.when(day % 5 != 0, F.col("close")))
    rows = rows.withColumn("date", F.when(day % 7 == 0, "never").otherwise(F.col("date").cast("string")))
    return quality.violations(rows, [*quality.REQUIRED_BARS, "adjusted"])


@query("missing_fundamental_keys", "B16", """select ticker, 'PERatio' as missing_key from fundamentals where substring(ticker,7,1)='1' union all select ticker, 'Symbol' from fundamentals where ticker like '%3'""")
def missing_fundamental_keys(spark, sf_dir):
    raw = tables.fundamentals(spark, sf_dir)
    raw = raw.withColumn("Symbol", F.when(~F.col("ticker").endswith("3"), F.col("ticker"))).withColumn("PERatio", F.when(F.col("PERatio") == "-", " ").otherwise(F.col("PERatio")))
    return fundamentals.missing_keys(raw, ["Symbol", "PERatio"])


@query("json_filtered_runs", "B20 F8 H12", """select event_id, event_type from events where json_extract_string(props,'$.k')='7' order by ts desc, event_id desc limit 40""")
def json_filtered_runs(spark, sf_dir):
    events = tables.read(spark, sf_dir, "events").select("event_id", "event_type", "ts", "props")
    return runs.filter_payloads(events, "props", {"k": "7"}, ["ts", "event_id"], 40).select("event_id", "event_type")


@query("serialised_bars", "B21 H5", "select ticker, date, strftime(date,'%Y-%m-%d') as iso, open, volume from event_bars")
def serialised_bars(spark, sf_dir):
    out = projections.serialised_bars(tables.event_bars(spark, sf_dir))
    get = lambda c: F.get_json_object("record", f"$.{c}")
    return out.select("ticker", "date", get("date").alias("iso"), get("open").cast("double").alias("open"), get("volume").cast("long").alias("volume"))


@query("quote_or_close", "B24", """select ticker, case when ticker like '%1' then 12.5e0 else close end as price, case when ticker like '%1' then null else date end as as_of,
    case when ticker like '%1' then 'live' else 'stored' end as price_source from (select *, row_number() over (partition by ticker order by date desc) as k from bars) t where k=1""")
def quote_or_close(spark, sf_dir):
    quotes = tables.sector_map(spark, sf_dir).select("ticker", F.when(F.col("ticker").endswith("1"), F.lit(12.5)).alias("price"))
    return projections.quote_or_close(quotes, tables.bars(spark, sf_dir))


# --- joins and sets ------------------------------------------------------------------------------------------


@query("combined_panel", "C1 B3 B4", f"""select b.ticker, b.date, close, pe_ratio, eps, cast(null as double) as sentiment_score from bars b
    left join (select * from ratios where ticker not like '%7') f on f.ticker=b.ticker""")
def combined_panel(spark, sf_dir):
    bars = tables.bars(spark, sf_dir).select("ticker", "date", "close")
    known = bars.filter(~F.col("ticker").endswith("7"))
    daily = fundamentals.daily_static(known, fundamentals.ratios(tables.fundamentals(spark, sf_dir)))
    out = panel.combined(bars, daily, None)
    assert out.columns[2 : 2 + len(FUNDAMENTAL) + len(SENTIMENT)] == [*FUNDAMENTAL, *SENTIMENT]
    return out.select("ticker", "date", "close", "pe_ratio", "eps", "sentiment_score")


@query("aligned_prices_signals", "C2 G3", """select b.ticker, b.date, b.close, s.score from bars b join scored s on s.ticker=b.ticker and s.date=b.date""")
def aligned_prices_signals(spark, sf_dir):
    bars = tables.bars(spark, sf_dir).select("ticker", "date", "close")
    old = bars.withColumn("close", F.col("close") - 1).withColumn("v", F.lit(0))
    last = merge.keep_last(old.unionByName(bars.withColumn("v", F.lit(1))), ["ticker", "date"], ["v"])
    return last.drop("v").join(scored(spark, sf_dir).select("ticker", "date", "score"), ["ticker", "date"])


@query("reattached_raw", "C8", f"select ticker, date, {r('rsi')} as rsi, close, volume from tech")
def reattached_raw(spark, sf_dir):
    slim = indicators(spark, sf_dir).select("ticker", "date", "rsi")
    return rounded(panel.reattach(slim, tables.bars(spark, sf_dir)), 6, skip=["close"])


@query("attached_scores", "C12", f"select t.ticker, t.date, s.score from bars t left join (select * from scored where score>=0.5) s on s.ticker=t.ticker and s.date=t.date")
def attached_scores(spark, sf_dir):
    return panel.attach(tables.bars(spark, sf_dir).select("ticker", "date"), scored(spark, sf_dir).filter("score >= 0.5"), ["score"])


@query("filled_scores", "C15", "select t.ticker, t.date, coalesce(s.score,-1) as proba from bars t left join (select * from scored where score>=0.5) s on s.ticker=t.ticker and s.date=t.date")
def filled_scores(spark, sf_dir):
    rows = tables.bars(spark, sf_dir).select("ticker", "date").withColumn("proba", F.lit(-1.0))
    return panel.fill_scores(rows, scored(spark, sf_dir).filter("score >= 0.5"), "proba")


@query("stacked_frames", "G1", "select ticker, date, close, volume, 'stocks' as kind from bars union all select symbol, date, close, null, 'macro' from macro")
def stacked_frames(spark, sf_dir):
    stocks = tables.bars(spark, sf_dir).select("ticker", "date", "close", "volume", F.lit("stocks").alias("kind"))
    series = tables.macro(spark, sf_dir).select(F.col("symbol").alias("ticker"), "date", "close", F.lit("macro").alias("kind"))
    return merge.stack([stocks, series])


@query("merged_history", "G2", "select ticker, date, open, high, low, case when date>=date '2000-01-01' then close+1 else close end as close, volume from bars")
def merged_history(spark, sf_dir):
    bars = tables.bars(spark, sf_dir)
    new = bars.filter("date >= '2000-01-01'").withColumn("close", F.col("close") + 1)
    return merge.merge_history(bars.filter("date < '2001-01-01'"), new)


@query("stored_merge", "G2 A5", "select ticker, date, open, high, low, case when date>=date '2024-01-16' then close+1 else close end as close, volume from event_bars")
def stored_merge(spark, sf_dir):
    bars = tables.event_bars(spark, sf_dir)
    s = saved(spark, sf_dir, "bars", bars.filter("date < '2024-01-20'"))
    s.merge("bars", bars.filter("date >= '2024-01-16'").withColumn("close", F.col("close") + 1))
    return s.load("bars")


@query("newest_runs", "F8", "select run_id, model_id, created_at from training_runs where status='completed' order by created_at desc, run_id desc limit 1000")
def newest_runs(spark, sf_dir):
    rows = tables.training_runs(spark, sf_dir).filter("status = 'completed'").select("run_id", "model_id", "created_at")
    return crosssection.newest_first(rows, ["created_at", "run_id"], 1000)

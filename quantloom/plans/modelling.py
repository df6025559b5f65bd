"""Model, calibration, search, out-of-fold and attribution queries.

Every model runs the whole settings of ``models.specs``: all trees and boosting rounds, depth and solver. Only the searches draw from small spaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import rounded
from quantloom.functions.vocabulary import CROSS_SECTION, FUNDAMENTAL, LAG, PRICE, RANKED, SECTOR, SENTIMENT, TECHNICAL
from quantloom.models import attribution, folds, research, training
from quantloom.models.isotonic import IsotonicCurve
from quantloom.models.specs import ABLATION_STEPS, FOREST, META, PCA_LOGISTIC, STRATEGY_GROUPS, Spec, spec_of
from quantloom.operators import fundamentals, labels, market, panel, sentiment, splits, technical
from quantloom.operators.backtest import daily_portfolio
from quantloom.operators.explain import top_features
from quantloom.operators.merge import stack
from quantloom.operators.metrics import classification, ranking_quality
from quantloom.operators.ordering import average_ranks
from quantloom.operators.summaries import cv_summary
from quantloom.plans.features import scored_news
from quantloom.plans.inputs import FIXTURE_NEGATIVE, FIXTURE_POSITIVE, scored
from quantloom.plans.registry import VIEWS, query, r, view
from quantloom.plans.research import CPCV, PURGED, WALK_FORWARD
from quantloom.session import scratch_path
from quantloom.plans import workflows
from quantloom.sources import tables
from quantloom.sources.store import SliceStore

_stored: dict[tuple[str, str], DataFrame] = {}


def training_panel(spark, sf_dir) -> DataFrame:
    """Every listed feature (technical, lag, price, macro, sector, fundamental, sentiment, ranks) with labels, written once per session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        # each is read several times below: by the features, the calendar of news and ratios, sectors and macro columns
        bars, series = training.stored(tables.bars(spark, sf_dir), "bars"), training.stored(tables.macro(spark, sf_dir), "macro")
        cores = max(2, spark.sparkContext.defaultParallelism)  # few bytes, much work a row: coalescing by size would leave one task
        tech = training.stored(technical.price_patterns(technical.technical(bars.repartition(cores, "ticker"))), "technical")
        fund = fundamentals.daily_static(bars, fundamentals.ratios(tables.fundamentals(spark, sf_dir)))
        articles = sentiment.lexicon_scores(sentiment.usable_articles(tables.market_news(spark, sf_dir)), FIXTURE_POSITIVE, FIXTURE_NEGATIVE)
        sent = sentiment.rolling_features(articles, bars)
        sector = market.sector_features(tech.select("ticker", "date", "returns"), tables.sector_map(spark, sf_dir), series)
        rows = market.attach_macro(panel.combined(tech, fund, sent), market.macro_features(market.macro_panel(series)))
        rows = rows.join(sector.select("ticker", "date", *SECTOR), ["ticker", "date"], "left")
        rows = training.stored(rows.repartition(cores, "ticker", "date"), "features")  # the ranks look at their rows several times
        rows = labels.next_return(average_ranks(rows, ["date"], dict(zip(RANKED, CROSS_SECTION, strict=True)), pct=True)).withColumn("ret_1d", F.col("returns"))
        _stored[key] = training.stored(rows.dropna(subset=TECHNICAL), "panel")
    return _stored[key]


def roles(spark, sf_dir) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, f"{sf_dir}#roles")
    if key not in _stored:
        rows = training_panel(spark, sf_dir)
        _stored[key] = training.stored(rows.join(splits.chronological(rows), "date"), "roles")
    marked = _stored[key]
    return {role: marked.filter(F.col("role") == role).drop("role") for role in ("train", "validation", "test")}


def light(model_id: str) -> Spec:
    """The whole spec: what once made it lighter is gone."""
    return spec_of(model_id)


def _model_query(model_id, ids):
    @query(f"score_{model_id}", ids)
    def run(spark, sf_dir):
        part = roles(spark, sf_dir)
        return training.fit(spec_of(model_id), part["train"]).score(part["test"]).select("ticker", "date", "target", "probability")

    return run


for _id, _ids in (("baseline_lr", "N1 N10"), ("model_a", "N2"), ("model_b", "N3"), ("model_c", "N4"), ("model_d", "N5"), ("model_e", "N6"), ("model_f", "N7"), ("model_g_ranker", "N8")):
    _model_query(_id, _ids)


@query("soft_vote", "N7", f"select ticker, date, {r('(score+0.25e0)/2', 8)} as probability from scored")
def soft_vote(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("other", F.lit(0.25))
    return rounded(training.soft_vote(rows, ["score", "other"]).select("ticker", "date", "probability"), 8)


@query("calibrated_scores", "N11")
def calibrated_scores(spark, sf_dir):
    part = roles(spark, sf_dir)
    model = training.calibrate(training.fit(light("model_a"), part["train"]), part["validation"])
    return model.score(part["test"]).select("ticker", "date", "target", "probability", F.lit(model.status["calibration"]).alias("calibration"))


_CENT = "round(score,2)"


@query("isotonic_scores", "N11", f"""with d as (select {_CENT} as p, count(*) as w, cast(sum(target) as double) as y from scored group by 1),
    c as (select p, row_number() over (order by p) as i, sum(w) over (order by p) as cw, sum(y) over (order by p) as cy, w, y from d),
    spans as (select a.i as lo, b.i as hi, (b.cy-a.cy+a.y)/(b.cw-a.cw+a.w) as mean from c a join c b on b.i>=a.i),
    least as (select c.p, s.lo, min(s.mean) as m from c join spans s on s.lo<=c.i and s.hi>=c.i group by 1, 2),
    fit as (select p, max(m) as v from least group by 1)
    select ticker, date, {r("v", 8)} as calibrated from scored join fit on fit.p={_CENT}""")
def isotonic_scores(spark, sf_dir):
    """Every score at the isotonic fit of the outcome on all scores, cut to two digits so that ties are many."""
    rows = scored(spark, sf_dir).withColumn("p", F.round("score", 2))
    curve = IsotonicCurve.fit(rows, "p", "target")
    return rounded(curve.transform(rows, "p", "calibrated").select("ticker", "date", "calibrated"), 8)


@query("pca_logistic", "N12")
def pca_logistic(spark, sf_dir):
    part = roles(spark, sf_dir)
    spec = PCA_LOGISTIC.with_features(TECHNICAL + LAG)
    return training.fit(spec, part["train"]).score(part["test"]).select("ticker", "date", "target", "probability")


@query("strategy_groups", "N13 D16")
def strategy_groups(spark, sf_dir):
    part = roles(spark, sf_dir)
    return research.group_comparison(part["train"], part["test"], STRATEGY_GROUPS, FOREST)


@query("feature_ablation", "N16")
def feature_ablation(spark, sf_dir):
    part = roles(spark, sf_dir)
    return research.group_comparison(part["train"], part["test"], ABLATION_STEPS, light("model_a"))


@query("search_validation", "N14")
def search_validation(spark, sf_dir):
    part = roles(spark, sf_dir)
    space = {**research.FOREST_SPACE, "numTrees": research.whole(5, 10), "maxDepth": research.whole(3, 5)}
    spec = FOREST.with_features(TECHNICAL)
    _, log = research.search_on_validation(spec, space, part["train"], part["validation"], 2)
    return spark.createDataFrame([(i, v, str(d)) for i, v, d in log], "trial int, rank_ic double, settings string")


@query("search_folds", "N15")
def search_folds(spark, sf_dir):
    rows = roles(spark, sf_dir)["train"]
    parts = splits.time_series_split(rows, 3)
    space = {**research.BOOST_SPACE, "maxIter": research.whole(2, 4), "maxDepth": research.whole(3, 4)}
    _, log = research.search_on_folds(spec_of("model_a"), space, rows, parts, 2)
    return spark.createDataFrame([(i, v, str(d)) for i, v, d in log], "trial int, cv_auc double, settings string")


view("ready_rows", """select ticker, date from (select *, lead(returns) over (partition by ticker order by date) as ahead from tech) t
    where ahead is not null and returns is not null and volatility is not null and rsi is not null and momentum is not null and bb_width is not null""")
view("ready_axis", "select date, row_number() over (order by date)-1 as i, count(*) over () as n from (select distinct date from ready_rows) d")
FULL = list(ABLATION_STEPS)[-1]


def cv_scores(spark, sf_dir) -> DataFrame:
    """Test scores of all folds of the four schemes on every ablation step (the combinatorial scheme on all features), fitted once per session and scale."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}#cv")
    if key not in _stored:
        rows = training_panel(spark, sf_dir)
        matrix = folds.build(rows, ABLATION_STEPS[FULL], splits.research_schemes(rows.select("date")))
        _stored[key] = folds.scores(matrix, ABLATION_STEPS, FOREST, only={"cpcv": [FULL]})
    return _stored[key]


@query("cv_fold_metrics", "M12")
def cv_fold_metrics(spark, sf_dir):
    return folds.fold_metrics(cv_scores(spark, sf_dir))


@query("research_cv_summary", "M12 D10")
def research_cv_summary(spark, sf_dir):
    return cv_summary(folds.fold_metrics(cv_scores(spark, sf_dir)))


view("ready_blocks", VIEWS["blocks"].replace("from axis", "from ready_axis"))
_on_ready = lambda sql: sql.replace("from axis", "from ready_axis").replace("join blocks", "join ready_blocks")
_named = "select '{}' as split_name, fold, date, role from ({}) t"
_every_fold = " union all ".join(
    _named.format(name, _on_ready(sql))
    for name, sql in (
        ("walk_forward", WALK_FORWARD), ("purged_kfold", PURGED.format(gap=5)), ("purged_kfold_horizon", PURGED.format(gap=6)),
        ("cpcv", CPCV.format(n=24, out="select cast(fold as int) as fold, date, role")),
    )
)


@query("cv_fold_sizes", "M12 N16 C10", f"""select split_name, ablation, fold, n_train, n_test, n_test as n_scored
    from (select split_name, fold, count(*) filter (role='train') as n_train, count(*) filter (role='test') as n_test
          from ({_every_fold}) f join ready_rows using (date) group by 1, 2) sized
    cross join (select unnest([{", ".join(f"'{g}'" for g in ABLATION_STEPS)}]) as ablation) a
    where n_train>=50 and n_test>=20 and (split_name<>'cpcv' or ablation='{FULL}')""")
def cv_fold_sizes(spark, sf_dir):
    """Rows that each fit was trained and tested on, and the keys it scored."""
    return folds.fold_sizes(cv_scores(spark, sf_dir))


@query("ablation_auc", "N16 M2")
def ablation_auc(spark, sf_dir):
    rows = training_panel(spark, sf_dir)
    matrix = folds.build(rows, ABLATION_STEPS[FULL], {"holdout": splits.two_way(rows).withColumn("fold", F.lit(0))})
    return folds.ablation_auc(folds.scores(matrix, ABLATION_STEPS, light("model_a"), with_train=True))


def _primary(spark, sf_dir):
    part = roles(spark, sf_dir)
    rows = part["train"].unionByName(part["validation"])
    spec = FOREST.with_features(TECHNICAL)
    return part, rows, spec, research.out_of_fold(rows, research.out_of_fold_splits(rows), spec)


@query("out_of_fold", "N17 C15")
def out_of_fold(spark, sf_dir):
    _, rows, _, primary = _primary(spark, sf_dir)
    return panel.fill_scores(rows.select("ticker", "date"), primary, "proba_primary", "proba_primary")


@query("meta_gated_backtest", "N18 N19 O8")
def meta_gated_backtest(spark, sf_dir):
    part, rows, spec, primary = _primary(spark, sf_dir)
    meta = research.fit_meta(rows, primary, None, TECHNICAL, 0.5, META)
    test = training.fit(spec, rows).score(part["test"]).withColumnRenamed("probability", "proba_primary")
    test = meta.score(test).withColumnRenamed("probability", "proba_meta")
    return daily_portfolio(research.gate(test, 0.5), "signal_meta").select("date", "ret", "gross_ret", "signal", "net_ret")


@query("meta_gate", "N19", "select ticker, date, cast(score>=0.5 and round(1-ret_1d,6)>=0.55 as int)*1.0e0 as signal_meta from scored")
def meta_gate(spark, sf_dir):
    rows = scored(spark, sf_dir).select("ticker", "date", F.col("score").alias("proba_primary"), F.round(1 - F.col("ret_1d"), 6).alias("proba_meta"))
    return research.gate(rows, 0.5).select("ticker", "date", "signal_meta")


@query("saved_model_scores", "N20")
def saved_model_scores(spark, sf_dir):
    part = roles(spark, sf_dir)
    model = training.calibrate(training.fit(light("model_c"), part["train"]), part["validation"])
    path = scratch_path(spark, "model")
    model.save(path, spark)
    return training.load_model(path, spark).score(part["test"]).select("ticker", "date", "target", "probability")


@query("predict_latest", "N21 N22 O14")
def predict_latest(spark, sf_dir):
    part = roles(spark, sf_dir)
    models = {m: training.fit(light(m), part["train"]) for m in ("baseline_lr", "model_c")}
    return training.compare_latest(models, ["baseline_lr", "model_c", "model_d"], training_panel(spark, sf_dir))


@query("training_run", "N26")
def training_run(spark, sf_dir):
    part = roles(spark, sf_dir)
    model = training.calibrate(training.fit(light("model_b"), part["train"]), part["validation"])
    scored = model.score(part["test"]).withColumnRenamed("probability", "score").withColumn("model_id", F.lit("model_b"))
    out = classification(scored, ["model_id"]).join(ranking_quality(scored, ["model_id"]), "model_id")
    return out.withColumn("calibration", F.lit(model.status["calibration"]))


@query("feature_importances", "D16 Q9")
def feature_importances(spark, sf_dir):
    part = roles(spark, sf_dir)
    spec = FOREST.with_features(TECHNICAL + LAG + PRICE + FUNDAMENTAL + SENTIMENT)
    return training.fit(spec, part["train"]).importances(spark).orderBy(F.col("importance").desc(), "feature").limit(20)


view("fresh_panel", """select r.ticker, r.date from ready_rows r join ready_axis a using (date)
    where i >= greatest(greatest(5, least(floor(0.7e0*n), n-10))+3, least(floor(0.85e0*n), n-3))""")


view("market_scored", """select 'Brand#' || cast(1+doc_id%25 as varchar(4)) as ticker, date '1995-01-02' + cast(doc_id*7%2499 as int) as day from scored_news""")


@query("training_panel", "C1 N10 N16", f"""with near as (select b.ticker, b.date, count(m.day) as news from bars b
      left join market_scored m on m.ticker=b.ticker and m.day between b.date-2 and b.date group by 1, 2),
    ranked as (select ticker, date, case when returns is not null then
      (rank() over (partition by date order by returns nulls last)+(count(*) over (partition by date, returns)-1)/2.0e0)/count(returns) over (partition by date) end as pct from tech),
    sec as (select *, sec/nullif(lag(sec) over (partition by ticker order by date),0)-1 as ret from sector_aligned),
    full_rows as (select r.ticker, r.date, n.news, k.pct, s.ret from ready_rows r join near n using (ticker, date) join ranked k using (ticker, date) join sec s using (ticker, date))
    select f.ticker, count(*) as rows, count(m.vix_level) as macro_rows, count(m.spy_vol_5d) as vol_rows, count(f.ret) as sector_rows, cast(sum(f.news) as bigint) as articles,
      {r("avg(f.pct)")} as mean_rank, {r("avg(f.ret)", 5)} as mean_sector, {r("avg(m.spy_return)", 5)} as mean_spy
    from full_rows f asof left join macro_feat m on f.date>=m.date group by 1""")
def training_panel_summary(spark, sf_dir):
    """What the training panel holds per ticker: rows, macro, sector, news and rank features."""
    rows = training_panel(spark, sf_dir).filter(F.col("forward_return").isNotNull())
    means = [F.round(F.avg(c), d).alias(name) for c, d, name in (("returns_rank", 6, "mean_rank"), ("sector_ret1d", 5, "mean_sector"), ("spy_return", 5, "mean_spy"))]
    counts = [F.count(c).alias(name) for c, name in (("vix_level", "macro_rows"), ("spy_vol_5d", "vol_rows"), ("sector_ret1d", "sector_rows"))]
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), *counts, F.sum("news_count").cast("long").alias("articles"), *means)


view("ready_test", """select r.ticker, r.date from ready_rows r join ready_axis a using (date)
    where i >= greatest(greatest(5, least(floor(0.7e0*n), n-10))+3, least(floor(0.85e0*n), n-3))""")
_CHECKED = ["baseline_lr", "model_a", "model_b", "model_c", "model_d", "model_e", "model_f", "model_g_ranker", "pca_logistic"]


@query("model_score_invariants", "N1 N2 N3 N4 N5 N6 N7 N8 N10 N12", f"""select model_id, count(*) as rows, count(*) as keys, count(*) as in_range, count(distinct ticker) as tickers, count(distinct date) as dates
    from ready_test cross join (select unnest([{", ".join(f"'{m}'" for m in _CHECKED)}]) as model_id) m group by 1""")
def model_score_invariants(spark, sf_dir):
    """Every model scores every test row once, with a probability."""
    part, scored = roles(spark, sf_dir), []
    for name in _CHECKED:
        spec = PCA_LOGISTIC.with_features(TECHNICAL + LAG) if name == "pca_logistic" else light(name)
        scored.append(training.fit(spec, part["train"]).score(part["test"]).select("ticker", "date", F.lit(name).alias("model_id"), "probability"))
    ok = (F.col("probability").between(0.0, 1.0) & ~F.isnan("probability")).cast("long")
    out = stack(scored).groupBy("model_id", "ticker", "date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(ok, F.lit(0))).alias("ok"))
    return out.groupBy("model_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.sum("ok").alias("in_range"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("date").alias("dates"))


def _explained(spark, sf_dir):
    """A boosted model over all technical features, the newest row of every ticker and the background rows."""
    part = roles(spark, sf_dir)
    model = training.fit(spec_of("model_a"), part["train"])
    return model, technical.latest_indicators(part["test"], list(model.spec.features)), part["train"]


@query("tree_attributions", "Q2 Q3 Q5")
def tree_attributions(spark, sf_dir):
    return top_features(attribution.tree_attributions(*_explained(spark, sf_dir)), 4)


@query("tree_attribution_sums", "Q2 Q7", """with ready as (select ticker, max(date) as date from fresh_panel group by 1)
    select ticker, date, 13 as features, 0.0e0 as gap from ready""")
def tree_attribution_sums(spark, sf_dir):
    """What is left of prediction less base after all attributions: nothing."""
    model, newest, background = _explained(spark, sf_dir)
    sums = attribution.tree_attributions(model, newest, background).groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("features"), F.sum("value").alias("_total"))
    base = attribution.tree_base(model, background).first()["base_value"]  # one value
    both = attribution.explained(model, newest).select("ticker", "date", "explained").join(sums, ["ticker", "date"])
    return both.select("ticker", "date", "features", F.round(F.abs(F.col("explained") - F.lit(base) - F.col("_total")), 9).alias("gap"))


@query("tree_base_value", "Q7")
def tree_base_value(spark, sf_dir):
    model, _, background = _explained(spark, sf_dir)
    return attribution.tree_base(model, background)


@query("fold_auc", "Q8")
def fold_auc(spark, sf_dir):
    rows = training_panel(spark, sf_dir)
    return research.fold_auc(rows, splits.time_series_split(rows, 3, gap=5), light("model_a"))


@query("refresh_workflow", "T8 A14 A19", """select 'nightly' as run_id, ticker, 'completed' as status, count(*) as rows, max(date) as last_date from event_bars group by 2""")
def refresh_workflow(spark, sf_dir):
    bars = tables.event_bars(spark, sf_dir)
    s = SliceStore(spark, scratch_path(spark, "refresh"), buckets=8)
    tickers = bars.select("ticker").distinct()
    snapshot = tickers.withColumn("EPS", F.lit("1.5"))
    lineage = workflows.refresh(s, tickers, bars, snapshot, scored_news(spark, sf_dir), "nightly")
    return lineage.drop("error")


@query("backtest_fitted_models", "O14 B6 B11")
def backtest_fitted_models(spark, sf_dir):
    part = roles(spark, sf_dir)
    models = {m: training.fit(light(m), part["train"]) for m in ("baseline_lr", "model_c")}
    return workflows.backtest_models(part["test"], tables.bars(spark, sf_dir), models)[1]


@query("research_run", "A17 D18 N25 N13 N18 P1 P3")
def research_run(spark, sf_dir):
    """The whole holdout study: every model, feature group and bootstrap draw of ``workflows.research_run``; its tables are written as CSV, the model dashboard is returned."""
    results = workflows.research_run(training_panel(spark, sf_dir), cv=cv_scores(spark, sf_dir))
    folder = scratch_path(spark, "study")
    workflows.write_results(results, folder)
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/dashboard")

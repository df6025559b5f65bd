"""Aggregation, run-table and attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.safe import rounded
from quantloom.operators import explain, quality, runs, splits, summaries
from quantloom.operators.labels import next_return
from quantloom.operators.metrics import information_coefficients
from quantloom.operators.technical import base_indicators
from quantloom.plans import views  # noqa: F401
from quantloom.plans.inputs import indicators, scored
from quantloom.plans.registry import query, r, view
from quantloom.plans.research import outcomes
from quantloom.session import scratch_path
from quantloom.sources import store, tables

FEATURES = ["returns", "volatility", "rsi", "momentum", "bb_width"]
_ROLE = "case when i<floor(0.7e0*n) then 'train' when i<floor(0.85e0*n) then 'validation' else 'test' end"


@query("label_distribution", "D2 D7 D21", f"""select {_ROLE} as split, count(*) as n, cast(sum(target) as bigint) as n_positive, cast(sum(1-target) as bigint) as n_negative, {r("avg(target)")} as frac_positive
    from scored s join axis a on a.date=s.date group by 1""")
def label_distribution(spark, sf_dir):
    roles = splits.chronological(tables.bars(spark, sf_dir), clamp=False).withColumnRenamed("role", "split")
    return rounded(summaries.label_distribution(scored(spark, sf_dir).join(roles, "date")))


@query("panel_statistics", "D21", f"select count(*) as rows, count(distinct date) as n_dates, min(date) as first_date, max(date) as last_date, {r('avg(target)')} as positive_rate from scored")
def panel_statistics(spark, sf_dir):
    return rounded(summaries.panel_statistics(scored(spark, sf_dir)))


@query("missing_report", "D3", "select * from (" + " union all ".join(f"select '{f}' as feature, count(*) filter ({f} is null) as missing, {r(f'count(*) filter ({f} is null)*100.0e0/count(*)')} as pct from tech" for f in FEATURES) + ") t where missing>0")
def missing_report(spark, sf_dir):
    return rounded(summaries.missing_report(indicators(spark, sf_dir), FEATURES))


@query("describe_features", "D4", " union all ".join(f"""select '{f}' as feature, count({f}) as count, {r(f"avg({f})", 4)} as mean, {r(f"stddev_samp({f})", 4)} as std, {r(f"min({f})", 4)} as min, {r(f"max({f})", 4)} as max,
    {r(f"skewness({f})", 4)} as skew, {r(f"kurtosis({f})", 4)} as kurtosis from tech""" for f in FEATURES))
def describe_features(spark, sf_dir):
    return rounded(summaries.describe(indicators(spark, sf_dir), FEATURES), 4)


_COMPLETE = " and ".join(f"{f} is not null" for f in FEATURES)
view("pairs", " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, corr({a},{b}) as r from tech where {_COMPLETE}" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]))


@query("correlations", "D5", f"select feature_a, feature_b, {r('r')} as r from pairs")
def correlations(spark, sf_dir):
    return rounded(summaries.correlations(indicators(spark, sf_dir), FEATURES))


WIDE = ["open", "high", "low", "close", "volume", "returns", "volatility", "rsi", "sma_20", "sma_50", "sma_200", "bb_upper", "bb_lower", "bb_width", "momentum"]
_WIDE = " and ".join(f"{c} is not null" for c in WIDE)
view("wide_pairs", f"with complete as materialized (select * from tech where {_WIDE}) " + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, corr({a},{b}) as r from complete" for i, a in enumerate(WIDE) for b in WIDE[i + 1 :]))


@query("correlation_matrix", "D5", f"select feature_a, feature_b, {r('r')} as r from wide_pairs")
def correlation_matrix(spark, sf_dir):
    return rounded(summaries.correlations(indicators(spark, sf_dir), WIDE))


@query("strong_pairs", "D5", f"select feature_a, feature_b, {r('r')} as r from pairs where abs(r)>0.3")
def strong_pairs(spark, sf_dir):
    return rounded(summaries.strong_pairs(indicators(spark, sf_dir), FEATURES, 0.3))


view("labelled", "select *, cast(lead(returns) over (partition by ticker order by date)>0 as int) as target from tech")
_LAB = f"{_COMPLETE} and target is not null"


@query("point_biserial", "D6", "select feature, n, " + r("rr") + " as r, " + r("rr*sqrt(n-2)/sqrt(1-rr*rr)", 4) + " as t from (" + " union all ".join(f"select '{f}' as feature, count(*) as n, corr({f},target) as rr from labelled where {_LAB}" for f in FEATURES) + ") x")
def point_biserial(spark, sf_dir):
    out = summaries.point_biserial(next_return(indicators(spark, sf_dir)), FEATURES)
    return out.select("feature", "n", F.round("r", 6).alias("r"), F.round("t", 4).alias("t"))


@query("point_biserial_p", "D6")
def point_biserial_p(spark, sf_dir):
    return summaries.with_significance(summaries.point_biserial(next_return(indicators(spark, sf_dir)), FEATURES))


@query("bar_summary", "D9", """select ticker, count(*) as rows, min(date) as start, max(date) as "end", 0.0e0 as missing_pct, (round(max_by(close,date),2)+0.0) as last_close from bars group by 1""")
def bar_summary(spark, sf_dir):
    return summaries.bar_summary(tables.bars(spark, sf_dir))


view("yearly_ic", "select year(date) as fold, model_id as split_name, avg(rank_ic) as rank_ic from ics group by 1,2")


@query("cv_summary", "D10 D19", f"""select split_name, 'rank_ic_mean' as metric, {r("avg(rank_ic)")} as value from yearly_ic group by 1 union all select split_name, 'rank_ic_std', {r("stddev_samp(rank_ic)")} from yearly_ic group by 1""")
def cv_summary(spark, sf_dir):
    rows = outcomes(spark, sf_dir).select(F.col("model_id").alias("split_name"), F.year("date").alias("fold"), "ticker", "date", "score", "forward_return")
    folds = information_coefficients(rows, ["split_name", "fold"]).withColumnRenamed("rank_ic_mean", "rank_ic")
    return rounded(summaries.cv_summary(folds))


view("lineage", """select model_id as run, run_id as ticker, status, created_at from training_runs""")


@query("run_metrics", "D11", f"""select run as run_id, count(*) as total, count(*) filter (status='completed') as success, count(*) filter (status<>'completed') as failed,
    {r("count(*) filter (status='completed')*1.0e0/count(*)", 4)} as success_rate, cast(date_diff('second', min(created_at)::timestamp, max(created_at)::timestamp) as bigint) as duration_sec from lineage group by 1""")
def run_metrics(spark, sf_dir):
    rows = tables.training_runs(spark, sf_dir)
    stamp = F.col("created_at").cast("timestamp")
    rows = rows.select(F.col("model_id").alias("run_id"), F.col("run_id").alias("ticker"), "status", stamp.alias("started_at"), stamp.alias("finished_at"))
    return summaries.run_metrics(rows)


NOW = "2024-01-31 00:00:00"
_STALE = f"status='running' and updated_at < timestamp '{NOW}' - interval 864000 second"
_DEAD = "status='failed' and error like 'failed: max delivery attempts%'"
view("health", f"""select count(*) filter (status='queued') as queued, count(*) filter (status='running') as running, count(*) filter (status='completed') as completed, count(*) filter (status='failed') as failed,
    count(*) filter ({_STALE}) as stale_running, count(*) filter ({_DEAD}) as dead_letter from job_runs""")


def now():
    return F.lit(NOW).cast("timestamp")


@query("queue_health", "D12", "select * from health")
def queue_health(spark, sf_dir):
    return runs.queue_health(tables.job_runs(spark, sf_dir), now(), 864_000)


@query("queue_summary", "D13", f"""select queued+running as queue_depth, {r("failed*1.0e0/(failed+completed)", 4)} as failure_rate, dead_letter, stale_running,
    concat_ws(',', case when stale_running>0 then 'stale_running_jobs' end, case when dead_letter>0 then 'dead_letter_jobs' end) as unhealthy_reasons from health""")
def queue_summary(spark, sf_dir):
    out = runs.health_summary(runs.queue_health(tables.job_runs(spark, sf_dir), now(), 864_000))
    return out.withColumn("unhealthy_reasons", F.concat_ws(",", "unhealthy_reasons"))


@query("requeue_decisions", "T6", f"""select run_id, attempt_count, case when attempt_count>=max_attempts then 'failed' else 'queued' end as new_status,
    coalesce(error, case when attempt_count>=max_attempts then 'failed: max delivery attempts reached' else 'requeued after stale running heartbeat' end) as new_error from job_runs where {_STALE}""")
def requeue_decisions(spark, sf_dir):
    return runs.requeue_decisions(tables.job_runs(spark, sf_dir), now(), 864_000)


@query("dead_letters", "T7", f"select run_id, attempt_count, max_attempts, error from job_runs where {_DEAD} order by updated_at desc, run_id limit 100")
def dead_letters(spark, sf_dir):
    return runs.dead_letters(tables.job_runs(spark, sf_dir)).select("run_id", "attempt_count", "max_attempts", "error")


@query("dataset_fingerprint", "D15 H11", """select count(*) as rows, substring(sha256('{"columns": ["close", "date", "ticker"], "max_date": "'||strftime(max(date),'%Y-%m-%d %H:%M:%S')||'", "min_date": "'||strftime(min(date),'%Y-%m-%d %H:%M:%S')||'", "rows": '||count(*)||'}'),1,16) as fingerprint from bars""")
def dataset_fingerprint(spark, sf_dir):
    return summaries.fingerprint(tables.bars(spark, sf_dir).select("ticker", "date", "close"))


@query("positive_weight", "D17", f"select model_id, {r('sum(1-target)*1.0e0/sum(target)')} as positive_weight from outcomes group by 1")
def positive_weight(spark, sf_dir):
    return rounded(summaries.positive_weight(outcomes(spark, sf_dir), by=["model_id"]))


@query("model_dashboard", "D18", f"""with m as (select model_id as model, avg(ic) as ic_mean, avg(rank_ic) as rank_ic_mean from ics group by 1)
    select model, {r("ic_mean")} as ic_mean, {r("rank_ic_mean")} as rank_ic_mean, cast(rank_ic_mean>(select rank_ic_mean from m where model='momentum') as int) as beats_baseline_rank_ic,
    cast(rank_ic_mean>(select rank_ic_mean from m where model='momentum') as int)*100.0e0 as beat_baseline_pct, case when model='reversal' then 1.25e0 end as sharpe_ratio from m""")
def model_dashboard(spark, sf_dir):
    table = information_coefficients(outcomes(spark, sf_dir), ["model_id"]).withColumnRenamed("model_id", "model")
    return rounded(summaries.dashboard(table, "momentum", "reversal", 1.25))


@query("melted_metrics", "D19", f"select model_id, 'ic_mean' as metric, {r('avg(ic)')} as value from ics group by 1 union all select model_id, 'rank_ic_mean', {r('avg(rank_ic)')} from ics group by 1")
def melted_metrics(spark, sf_dir):
    return rounded(summaries.melt(information_coefficients(outcomes(spark, sf_dir), ["model_id"]), ["model_id"], ["ic_mean", "rank_ic_mean"]))


@query("best_model", "F9 N25", f"select model_id as best, {r('v')} as best_value from (select model_id, avg(rank_ic) as v from ics group by 1) t order by v desc, model_id limit 1")
def best_model(spark, sf_dir):
    return rounded(summaries.best_by(information_coefficients(outcomes(spark, sf_dir), ["model_id"]), "rank_ic_mean", "model_id"))


@query("service_levels", "D20", f"""select 'batch_success' as indicator, {r("avg(cast(status='completed' as int))")} as value from training_runs union all
    select 'bar_freshness', {r("avg(cast(d=(select max(date) from bars) as int))")} from (select max(date) as d from bars group by ticker) t union all
    select 'dead_letter', {r(f"avg(cast(coalesce({_DEAD},false) as int))")} from job_runs""")
def service_levels(spark, sf_dir):
    return rounded(summaries.service_levels(tables.training_runs(spark, sf_dir), tables.bars(spark, sf_dir), tables.job_runs(spark, sf_dir)))


@query("model_breadth", "D22", f"select model_id, count(*) as n, count(*) filter (status='completed') as n_ok, {r('avg(cast(status=$$completed$$ as int))')} as share_ok from training_runs group by 1")
def model_breadth(spark, sf_dir):
    return rounded(summaries.model_breadth(tables.training_runs(spark, sf_dir).withColumn("ok", F.col("status") == "completed")))


# --- model runs ----------------------------------------------------------------------------------------------

view("gapped_runs", "select run_id, model_id, status, created_at, case when cast(run_id as bigint)%11=0 then null else roc_auc end as roc_auc, case when cast(run_id as bigint)%11=0 or cast(run_id as bigint)%13=0 then null else f1 end as f1, case when cast(run_id as bigint)%11=0 then null else brier end as brier from training_runs")
view("promotions", "select run_id, model_id, created_at as promoted_at from training_runs where status='completed' and cast(run_id as bigint)%7=0 and model_id<>'model_f'")
view("placed_promotions", "select *, row_number() over (partition by model_id order by promoted_at desc, run_id desc) as k from promotions")
view("champs", "select model_id, max(run_id) filter (k=1) as champion_run_id, max(promoted_at) filter (k=1) as promoted_at, max(run_id) filter (k=2) as previous_run_id from placed_promotions group by 1")


def gapped_runs(spark, sf_dir):
    key = F.col("run_id").cast("long")
    rows = tables.training_runs(spark, sf_dir)
    blank = key % 11 == 0
    return rows.withColumns(
        {"roc_auc": F.when(~blank, F.col("roc_auc")), "f1": F.when(~(blank | (key % 13 == 0)), F.col("f1")), "brier": F.when(~blank, F.col("brier"))}
    )


def promotion_log(spark, sf_dir):
    rows = tables.training_runs(spark, sf_dir).filter((F.col("status") == "completed") & (F.col("run_id").cast("long") % 7 == 0) & (F.col("model_id") != "model_f"))
    return rows.select("run_id", "model_id", F.col("created_at").alias("promoted_at"))


@query("champions", "T3", "select * from champs")
def champions(spark, sf_dir):
    return runs.champions(promotion_log(spark, sf_dir))


view("judged", """select c.run_id, c.model_id, h.champion_run_id, c.roc_auc-p.roc_auc as g, c.f1-p.f1 as f, c.brier-p.brier as b,
    case when coalesce(c.roc_auc,c.f1,c.brier) is null then 'candidate run has no metrics' when h.champion_run_id is null then 'no current champion; accept first completed run'
      when p.run_id is null or coalesce(p.roc_auc,p.f1,p.brier) is null then 'current champion metrics unavailable; accept candidate'
      when c.roc_auc-p.roc_auc is null then 'missing roc_auc metric for policy comparison' when c.roc_auc-p.roc_auc<0.005 then 'roc_auc improvement below threshold'
      when c.f1-p.f1 < -0.02 then 'f1 regression exceeds allowed guardrail' when c.brier-p.brier>0.01 then 'brier increase exceeds allowed guardrail' else 'candidate passes promotion policy' end as reason
    from (select * from gapped_runs where status='completed') c left join champs h using (model_id) left join gapped_runs p on p.run_id=h.champion_run_id""")
_ACCEPTED = "(reason like 'no current%' or reason like 'current champion metrics%' or reason like '%passes%')"


@query("promotion_decisions", "C17 T1 T2", f"""select run_id, model_id, champion_run_id, {r("g")} as roc_auc_delta, {r("f")} as f1_delta, {r("b")} as brier_increase,
    case when cast(run_id as bigint)%5=0 and not {_ACCEPTED} then 'forced promotion: '||reason else reason end as reason, cast(run_id as bigint)%5=0 and not {_ACCEPTED} as forced,
    cast(run_id as bigint)%5=0 or {_ACCEPTED} as accepted from judged""")
def promotion_decisions(spark, sf_dir):
    rows = gapped_runs(spark, sf_dir)
    out = runs.promotion_decisions(
        rows.filter("status = 'completed'"), rows, runs.champions(promotion_log(spark, sf_dir)), F.col("run_id").cast("long") % 5 == 0
    )
    return rounded(out)


@query("champion_resolution", "T4", """select s.selector, s.m as model_id, h.champion_run_id, case when h.champion_run_id is null then 'no champion for model' when r.run_id is null then 'champion run not found'
    when r.status<>'completed' then 'champion run not completed' end as error from (select distinct 'champion:'||model_id as selector, model_id as m from training_runs union all select 'champion', 'model_d') s
    left join champs h on h.model_id=s.m left join training_runs r on r.run_id=h.champion_run_id""")
def champion_resolution(spark, sf_dir):
    rows = tables.training_runs(spark, sf_dir)
    asked = rows.select(F.concat(F.lit("champion:"), "model_id").alias("selector")).distinct().unionByName(spark.range(1).select(F.lit("champion").alias("selector")))
    return runs.resolve_champions(asked, runs.champions(promotion_log(spark, sf_dir)), rows)


@query("nightly_summary", "C18 T5", """select m.model_id, l.run_id as latest_run_id, l.status as latest_status, l.created_at as latest_created_at, h.champion_run_id from (select distinct model_id from training_runs) m
    left join (select * from (select *, row_number() over (partition by model_id order by created_at desc, run_id desc) as k from training_runs) t where k=1) l using (model_id) left join champs h using (model_id)""")
def nightly_summary(spark, sf_dir):
    rows = tables.training_runs(spark, sf_dir)
    return runs.nightly_summary(rows.select("model_id").distinct(), rows, runs.champions(promotion_log(spark, sf_dir)))


@query("readiness", "N23", """select t.ticker, m.model_id, true as raw_ohlcv, "PERatio"<>'-' as raw_fundamentals, t.ticker not like '%2' as processed_technical, m.model_id<>'model_x' as model_artifact, t.ticker not like '%3' as combined_features,
    t.ticker not like '%2' and m.model_id<>'model_x' and t.ticker not like '%3' as ready, case when t.ticker not like '%2' and m.model_id<>'model_x' and t.ticker not like '%3' then 'ready_for_predict'
    when m.model_id='model_x' then 'train_or_load_model_artifact' when t.ticker like '%2' then 'run_ensure_ready_with_etl' else 'inspect_checks_and_run_ensure_ready' end as recommended_action
    from fundamentals t, (values ('model_a'),('model_x')) m(model_id)""")
def readiness(spark, sf_dir):
    f = tables.fundamentals(spark, sf_dir)
    asked = f.select("ticker", F.explode(F.array(F.lit("model_a"), F.lit("model_x"))).alias("model_id"))
    models = tables.training_runs(spark, sf_dir).select("model_id").distinct()
    have = {
        "raw_ohlcv": tables.bars(spark, sf_dir),
        "raw_fundamentals": f.filter("PERatio <> '-'"),
        "processed_technical": f.filter("ticker not like '%2'"),
        "model_artifact": models,
        "combined_features": f.filter("ticker not like '%3'"),
    }
    return runs.readiness(asked, have)


view("refresh_state", "select ticker, count(*) as rows, count(*) filter (ticker like '%5' and extract(day from date)=1) as bad, max(date) as last_date from bars where ticker not like '%9' group by 1")


@query("universe_refresh", "T8", """select 'run-1' as run_id, t.ticker, case when s.rows is null or bad>0 then 'failed' else 'completed' end as status, coalesce(s.rows,0) as rows, last_date,
    case when s.rows is null then 'no bars' when bad>0 then bad||' rows without prices' end as error from sector_map t left join refresh_state s using (ticker)""")
def universe_refresh(spark, sf_dir):
    raw = tables.bars(spark, sf_dir).filter("ticker not like '%9'")
    raw = raw.withColumn("close", F.when(~(F.col("ticker").endswith("5") & (F.dayofmonth("date") == 1)), F.col("close")))
    s = store.SliceStore(spark, scratch_path(spark, "refresh"), buckets=8)
    return quality.refresh_universe(tables.sector_map(spark, sf_dir), raw, "run-1", s, base_indicators)


# --- attributions --------------------------------------------------------------------------------------------

COEFFICIENTS = {"rsi": 0.03, "volatility": -1.5, "bb_width": 0.25}
GROUPED = {"Oscillators": ["rsi"], "Dispersion": ["volatility", "bb_width"]}
_GOOD = "rsi is not null and volatility is not null and bb_width is not null"
view("attributions", " union all ".join(f"select ticker, date, '{f}' as feature, {c!r}::double*({f}-(select avg({f}) from tech where {_GOOD}))/(select stddev_pop({f}) from tech where {_GOOD}) as value from tech where {_GOOD}" for f, c in COEFFICIENTS.items()))


def attributions(spark, sf_dir):
    rows = indicators(spark, sf_dir).dropna(subset=list(COEFFICIENTS))
    one = rows.agg(*[F.avg(f).alias(f"{f}_m") for f in COEFFICIENTS], *[F.stddev_pop(f).alias(f"{f}_s") for f in COEFFICIENTS]).first()  # one row
    return explain.linear_attributions(rows, COEFFICIENTS, {f: one[f"{f}_m"] for f in COEFFICIENTS}, {f: one[f"{f}_s"] for f in COEFFICIENTS})


@query("linear_attributions", "Q1 Q3", f"select ticker, date, feature, {r('value')} as value from attributions")
def linear_attributions(spark, sf_dir):
    return rounded(attributions(spark, sf_dir))


_GROUP = "case feature when 'rsi' then 'Oscillators' else 'Dispersion' end"


@query("group_contributions", "Q4", f"select ticker, date, {_GROUP} as \"group\", {r('sum(abs(value))')} as contribution from attributions group by 1,2,3")
def group_contributions(spark, sf_dir):
    return explain.group_contributions(attributions(spark, sf_dir), GROUPED)


@query("group_shares", "Q4", f"with m as (select feature, avg(abs(value)) as v from attributions group by 1) select {_GROUP} as \"group\", {r('sum(v)/(select sum(v) from m)')} as share from m group by 1")
def group_shares(spark, sf_dir):
    return rounded(explain.group_shares(attributions(spark, sf_dir), GROUPED))


@query("top_attributions", "F7 Q5", f"select ticker, date, feature, {r('value')} as value, cast(k as int) as rank from (select *, row_number() over (partition by ticker, date order by abs(value) desc, feature) as k from attributions) t where k<=2")
def top_attributions(spark, sf_dir):
    return explain.top_features(attributions(spark, sf_dir), 2)


@query("global_importance", "Q6", f"select feature, {r('avg(abs(value))')} as mean_abs from attributions group by 1")
def global_importance(spark, sf_dir):
    return rounded(explain.global_importance(attributions(spark, sf_dir)))


@query("base_value", "Q7", f"select {r('avg(score)')} as base_value from scored")
def base_value(spark, sf_dir):
    return rounded(explain.base_value(scored(spark, sf_dir), "score"))


@query("importance_split", "Q9", f"""select case when feature='rsi_rank' then 'cross_sectional' else 'base' end as kind, {r("sum(v)")} as importance, count(*) as n_features from
    (select case feature when 'rsi' then 'rsi_rank' else feature end as feature, avg(abs(value)) as v from attributions group by 1) t group by 1""")
def importance_split(spark, sf_dir):
    table = explain.global_importance(attributions(spark, sf_dir)).withColumnRenamed("mean_abs", "importance")
    return rounded(summaries.feature_split(table.withColumn("feature", F.when(F.col("feature") == "rsi", "rsi_rank").otherwise(F.col("feature")))))

"""Split, metric, selection, backtest and test queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.safe import rounded
from quantloom.operators import backtest, crosssection, inference, metrics, splits
from quantloom.operators.labels import forward_sum
from quantloom.operators.merge import stack
from quantloom.operators.projections import forecast_probability
from quantloom.plans import views  # noqa: F401
from quantloom.plans.inputs import indicators, scored, scores
from quantloom.plans.registry import query, r, view
from quantloom.sources import tables

view("axis", "select date, row_number() over (order by date)-1 as i, count(*) over () as n from (select distinct date from bars) t")


def bar_dates(spark, sf_dir):
    return tables.bars(spark, sf_dir).select("ticker", "date")


@query("split_dates", "L1 G4", """select date, case when i<greatest(5,least(cast(floor(0.7e0*n) as bigint),n-10)) then 'train'
    when i<greatest(greatest(5,least(cast(floor(0.7e0*n) as bigint),n-10))+3,least(cast(floor(0.85e0*n) as bigint),n-3)) then 'validation' else 'test' end as role from axis""")
def split_dates(spark, sf_dir):
    return splits.chronological(bar_dates(spark, sf_dir))


@query("split_dates_per_ticker", "L1", """with a as (select ticker, date, row_number() over (partition by ticker order by date)-1 as i, count(*) over (partition by ticker) as n from bars),
    b as (select *, greatest(5,least(cast(floor(0.7e0*n) as bigint),n-10)) as v from a)
    select ticker, date, case when i<v then 'train' when i<greatest(v+3,least(cast(floor(0.85e0*n) as bigint),n-3)) then 'validation' else 'test' end as role from b""")
def split_dates_per_ticker(spark, sf_dir):
    return splits.chronological(bar_dates(spark, sf_dir), by=["ticker"])


@query("split_rows", "L2", """with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 as i, count(*) over () as n from lineitem),
    b as (select *, greatest(10,least(cast(floor(0.7e0*n) as bigint),n-20)) as v from a),
    c as (select *, case when i<v then 'train' when i<greatest(v+5,least(cast(floor(0.85e0*n) as bigint),n-5)) then 'validation' else 'test' end as role from b)
    select role, count(*) as n, min(l_orderkey) as lo, max(l_orderkey) as hi from c group by 1""")
def split_rows(spark, sf_dir):
    lines = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = splits.row_fraction(lines, lines.columns)
    return out.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


@query("split_holdout", "L3", "select date, case when i<floor(0.7e0*n) then 'train' when i<floor(0.85e0*n) then 'validation' else 'test' end as role from axis")
def split_holdout(spark, sf_dir):
    return splits.chronological(bar_dates(spark, sf_dir), clamp=False)


@query("split_two_way", "L4", "select date, case when i<greatest(5,least(floor(0.8e0*n),n-5)) then 'train' else 'test' end as role from axis")
def split_two_way(spark, sf_dir):
    return splits.two_way(bar_dates(spark, sf_dir))


@query("split_order_check", "L1 L4", "select 'none' as violation where false")
def split_order_check(spark, sf_dir):
    return splits.order_violations(splits.chronological(bar_dates(spark, sf_dir)))


WALK_FORWARD = """with f as (select *, cast(floor(k/5.0e0*n) as bigint) as a, cast(floor((k+1)/5.0e0*n) as bigint) as b from axis, generate_series(1,4) g(k))
    select cast(k as int) as fold, date, case when i<a then 'train' else 'test' end as role from f where i<b and a>=20 and b-a>=3"""


@query("cv_walk_forward", "L5", WALK_FORWARD)
def cv_walk_forward(spark, sf_dir):
    return splits.walk_forward(bar_dates(spark, sf_dir))


PURGED = """with f as (select *, k*greatest(1,n//5) as s, case when k=4 then n else (k+1)*greatest(1,n//5) end as e from axis, generate_series(0,4) g(k))
    select cast(k as int) as fold, date, case when i<s-{gap} then 'train' else 'test' end as role from f
    where (i<s-{gap} or (i>=s and i<e)) and s-{gap}>=20 and least(e,n)-least(s,n)>=3"""


@query("cv_purged_kfold", "L6", PURGED.format(gap=5))
def cv_purged_kfold(spark, sf_dir):
    return splits.purged_kfold(bar_dates(spark, sf_dir))


@query("cv_purged_horizon", "L7", PURGED.format(gap=10))
def cv_purged_horizon(spark, sf_dir):
    return splits.purged_kfold(bar_dates(spark, sf_dir), horizon=5)


view("blocks", "select a.*, g as block from axis a, generate_series(0,7) t(g) where i>=floor(g*(n/8.0e0)) and i<case when g=7 then n else floor((g+1)*(n/8.0e0)) end")


@query("cv_blocks", "L8", "select cast(block as int) as block, min(date) as lo, max(date) as hi, count(*) as n from blocks group by 1")
def cv_blocks(spark, sf_dir):
    out = splits.block_ranges(splits.date_axis(bar_dates(spark, sf_dir)), 8)
    return out.groupBy("block").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n"))


CPCV = """with every as (select a.g as g1, b.g as g2, sha256('42:' || a.g || ',' || b.g) as h from generate_series(0,7) a(g), generate_series(0,7) b(g) where a.g<b.g),
    combos as (select g1, g2, row_number() over (order by g1, g2)-1 as fold from (select * from every order by h limit {n}) t),
    span as (select fold, min(i) as lo, max(i) as hi from combos join blocks on block in (g1,g2) group by 1),
    roles as (select c.fold, date, case when block in (g1,g2) then 'test' when not (i<=least(n-1,hi+5) and least(i+1,n-1)>=greatest(0,lo-5)) then 'train' end as role
      from combos c join span s on s.fold=c.fold cross join blocks),
    kept as (select *, count(*) filter (role='train') over (partition by fold) as tr, count(*) filter (role='test') over (partition by fold) as te from roles where role is not null)
    {out} from kept where tr>=30 and te>=5"""


@query("cv_combinatorial", "L9 L10 C11 G6 G7", CPCV.format(n=28, out="select cast(fold as int) as fold, date, role"))
def cv_combinatorial(spark, sf_dir):
    return splits.combinatorial_purged(bar_dates(spark, sf_dir), max_splits=None)


@query("cv_combinatorial_sampled", "L10", CPCV.format(n=12, out="select cast(fold as int) as fold, role, count(*) as n") + " group by 1, 2")
def cv_combinatorial_sampled(spark, sf_dir):
    return splits.combinatorial_purged(bar_dates(spark, sf_dir), max_splits=12).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


_TSS = """with f as (select *, n//6 as size, n-(5-k)*(n//6) as s from axis, generate_series(0,4) g(k))
    select cast(k as int) as fold, date, case when i<s-{gap} then 'train' else 'test' end as role from f where i<s-{gap} or (i>=s and i<s+size)"""


@query("cv_time_series", "L11", _TSS.format(gap=0))
def cv_time_series(spark, sf_dir):
    return splits.time_series_split(bar_dates(spark, sf_dir))


@query("cv_time_series_gap", "L11", _TSS.format(gap=5))
def cv_time_series_gap(spark, sf_dir):
    return splits.time_series_split(bar_dates(spark, sf_dir), gap=5)


_ROLE3 = "case when i<floor(0.7e0*n) then 'train' when i<floor(0.85e0*n) then 'validation' else 'test' end"


@query("rows_on_test_dates", "C10 H4", f"select ticker, b.date, close from bars b join axis a on a.date=b.date where {_ROLE3}='test'")
def rows_on_test_dates(spark, sf_dir):
    bars = tables.bars(spark, sf_dir)
    roles = splits.chronological(bars, clamp=False)
    return splits.rows_on_dates(bars, roles.filter("role = 'test'")).select("ticker", "date", "close")


@query("rows_off_test_dates", "C11", f"select ticker, b.date, close from bars b join axis a on a.date=b.date where {_ROLE3}<>'test'")
def rows_off_test_dates(spark, sf_dir):
    bars = tables.bars(spark, sf_dir)
    roles = splits.chronological(bars, clamp=False)
    return splits.rows_off_dates(bars, roles.filter("role = 'test'")).select("ticker", "date", "close")


# --- metrics -------------------------------------------------------------------------------------------------

# two scored models with outcomes
view(
    "outcomes",
    f"""select ticker, date, m.model_id, case when m.model_id='momentum' then score else {r("1-score")} end as score, ret_1d, forward_return, target
    from scored, (values ('momentum'),('reversal')) m(model_id)""",
)


def outcomes(spark, sf_dir):
    both = F.explode(F.array(F.struct(F.lit("momentum").alias("m"), F.col("score").alias("s")), F.struct(F.lit("reversal").alias("m"), F.round(1 - F.col("score"), 6).alias("s"))))
    out = scored(spark, sf_dir).withColumn("_x", both)
    return out.select("ticker", "date", F.col("_x.m").alias("model_id"), F.col("_x.s").alias("score"), "ret_1d", "forward_return", "target")


@query("metric_classification", "M1 M4 B13", f"""with c as (select model_id, count(*) as n, count(*) filter (score>=0.5 and target=1) as tp, count(*) filter (score>=0.5 and target=0) as fp,
    count(*) filter (score<0.5 and target=1) as fn, avg((target-score)*(target-score)) as brier from outcomes group by 1)
    select model_id, {r("(n-fp-fn)*1.0e0/n")} as accuracy, {r("tp*1.0e0/(tp+fp)")} as precision, {r("tp*1.0e0/(tp+fn)")} as recall, {r("2.0e0*tp/(2*tp+fp+fn)")} as f1, {r("brier")} as brier from c""")
def metric_classification(spark, sf_dir):
    return rounded(metrics.classification(outcomes(spark, sf_dir), ["model_id"]))


view("curve", """select model_id, score, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model_id) as p, sum(neg) over (partition by model_id) as n
    from (select model_id, score, sum(target) as pos, sum(1-target) as neg from outcomes group by 1,2) t window w as (partition by model_id order by score desc)""")


@query("metric_auc", "M2 M3", f"""select model_id, {r("sum(neg*(tp-pos/2.0e0))/(max(p)*max(n))")} as roc_auc,
    {r("sum(pos/(1.0e0*p)*tp/(tp+fp))")} as pr_auc from curve group by 1""")
def metric_auc(spark, sf_dir):
    return rounded(metrics.ranking_quality(outcomes(spark, sf_dir), ["model_id"]))


@query("metric_roc_points", "M13", f"select model_id, score as threshold, {r('fp*1.0e0/n')} as fpr, {r('tp*1.0e0/p')} as tpr from curve")
def metric_roc_points(spark, sf_dir):
    return rounded(metrics.roc_points(outcomes(spark, sf_dir), ["model_id"]))


@query("metric_precision_at_k", "M5", f"""with o as (select *, row_number() over (partition by model_id order by score desc, ticker, date) as rn, count(*) over (partition by model_id) as n from outcomes),
    k as (select *, greatest(1,least(cast(floor(n*0.25e0) as bigint),n)) as k from o)
    select model_id, max(k) as k, {r("sum(target) filter (rn<=k)*1.0e0/max(k)")} as precision_at_k, {r("sum(target) filter (rn<=k)*1.0e0/sum(target)")} as recall_at_k from k group by 1""")
def metric_precision_at_k(spark, sf_dir):
    k = F.floor(F.col("n") * 0.25).cast("long")
    return rounded(metrics.precision_recall_at(outcomes(spark, sf_dir), ["model_id"], k, ["ticker", "date"]))


_BIN = "+".join(f"cast(score>={i * 0.1!r}::double as int)" for i in range(1, 10))
view("bins", f"select model_id, {_BIN} as bin, avg(score) as pred_mean, avg(target) as obs_freq, count(*) as count from outcomes group by 1,2")


@query("metric_reliability", "M6 H10", f"""select m.model_id, cast(g as int) as bin, {r("pred_mean")} as pred_mean, {r("obs_freq")} as obs_freq, coalesce(count,0) as count
    from (select distinct model_id from bins) m cross join generate_series(0,9) t(g) left join bins b on b.model_id=m.model_id and b.bin=g""")
def metric_reliability(spark, sf_dir):
    return rounded(metrics.reliability(outcomes(spark, sf_dir), ["model_id"]))


@query("metric_calibration_error", "M6", f"select model_id, {r('sum(count*abs(obs_freq-pred_mean))/sum(count)')} as ece from bins group by 1")
def metric_calibration_error(spark, sf_dir):
    return rounded(metrics.calibration_error(outcomes(spark, sf_dir), ["model_id"]))


view("placed", "select *, row_number() over (partition by model_id, date order by score desc, ticker) as pos, count(*) over (partition by model_id, date) as n from outcomes")
view("selected", """select model_id, date, avg(forward_return) filter (pos<=greatest(1,ceil(n*0.2e0))) as top_return, avg(forward_return) filter (pos>n-greatest(1,ceil(n*0.2e0))) as bottom_return,
    avg(cast(forward_return>0 as int)) filter (pos<=greatest(1,ceil(n*0.2e0))) as hit_rate from placed group by 1,2""")


@query("metric_selection_daily", "F3", f"select model_id, date, {r('top_return')} as top_return, {r('bottom_return')} as bottom_return, {r('hit_rate')} as hit_rate from selected")
def metric_selection_daily(spark, sf_dir):
    return rounded(metrics.selection_by_date(outcomes(spark, sf_dir), ["model_id"]))


@query("metric_selection", "M7", f"""select model_id, {r("avg(top_return)")} as top_quantile_return, {r("avg(bottom_return)")} as bottom_quantile_return,
    {r("avg(top_return)-avg(bottom_return)")} as long_short_spread, {r("avg(hit_rate)")} as hit_rate_top_quantile from selected group by 1""")
def metric_selection(spark, sf_dir):
    return rounded(metrics.selection_metrics(outcomes(spark, sf_dir), ["model_id"]))


view("ic_ranks", """select *, rank() over (partition by model_id,date order by score)+(count(*) over (partition by model_id,date,score)-1)/2.0e0 as rs,
    rank() over (partition by model_id,date order by forward_return)+(count(*) over (partition by model_id,date,forward_return)-1)/2.0e0 as rr from outcomes""")
view("ics", """select model_id, date, case when count(distinct score)>1 and count(distinct forward_return)>1 then corr(score,forward_return) end as ic,
    case when count(distinct score)>1 and count(distinct forward_return)>1 then corr(rs,rr) end as rank_ic from ic_ranks group by 1,2 having count(*)>=3""")


@query("metric_ic_daily", "M8", f"select model_id, date, {r('ic')} as ic, {r('rank_ic')} as rank_ic from ics")
def metric_ic_daily(spark, sf_dir):
    return rounded(metrics.daily_ic(outcomes(spark, sf_dir), ["model_id"]))


@query("metric_ic", "M8", f"select model_id, {r('avg(ic)')} as ic_mean, {r('avg(rank_ic)')} as rank_ic_mean from ics group by 1")
def metric_ic(spark, sf_dir):
    return rounded(metrics.information_coefficients(outcomes(spark, sf_dir), ["model_id"]))


view("fractions", """select model_id, date, max(n) as n_assets, max(k) as k_used, max(k)*1.0e0/max(n) as selected_fraction, avg(forward_return) filter (pos<=k) as portfolio_return,
    avg(target) filter (pos<=k) as precision, count(*) filter (pos<=k and forward_return>0) as wins
    from (select *, case when n>1 then least(greatest(1,cast(floor(0.2e0*n) as bigint)),n-1) else 1 end as k from placed) t group by 1,2""")


@query("strategy_daily", "F4 M9", f"""select model_id, date, n_assets, k_used, {r("selected_fraction")} as selected_fraction, {r("portfolio_return")} as portfolio_return,
    {r("precision")} as precision, wins from fractions""")
def strategy_daily(spark, sf_dir):
    return rounded(metrics.fraction_by_date(outcomes(spark, sf_dir), ["model_id"]))


@query("strategy_evaluation", "M9 O5", f"""with a as (select model_id, avg(precision) as precision_at_k, coalesce(stddev_samp(precision),0) as precision_at_k_std,
      avg(portfolio_return)/nullif(stddev_samp(portfolio_return),0)*sqrt(252.0e0) as sharpe, avg(portfolio_return) as average_return, sum(wins)*1.0e0/sum(k_used) as hit_rate,
      avg(selected_fraction) as avg_selected_fraction from fractions group by 1),
    b as (select model_id, avg(ic) as ic, avg(rank_ic) as rank_ic from ics group by 1),
    c as (select model_id, avg(top_return) as t, avg(bottom_return) as b from selected group by 1)
    select a.model_id, {r("precision_at_k")} as precision_at_k, {r("precision_at_k_std")} as precision_at_k_std, {r("sharpe")} as sharpe, {r("average_return")} as average_return,
    {r("hit_rate")} as hit_rate, {r("avg_selected_fraction")} as avg_selected_fraction, {r("ic")} as ic, {r("rank_ic")} as rank_ic, {r("t")} as quantile_top_return,
    {r("b")} as quantile_bottom_return, {r("t-b")} as long_short_spread from a join b using (model_id) join c using (model_id)""")
def strategy_evaluation(spark, sf_dir):
    return rounded(metrics.strategy_evaluation(outcomes(spark, sf_dir), ["model_id"]))


view("quantiles", """select date, quantile, avg(forward_return) as mean_return from (select *, cast(least(greatest(ceil(pos*1.0e0/n*least(5,n)),1),least(5,n)) as int) as quantile
    from (select *, row_number() over (partition by date order by score, ticker) as pos, count(*) over (partition by date) as n from scored) t where n>=2) u group by 1,2""")


@query("quantile_returns", "M10", f"select date, quantile, {r('mean_return')} as mean_return from quantiles")
def quantile_returns(spark, sf_dir):
    return rounded(metrics.quantile_returns(scored(spark, sf_dir)))


_Q = range(1, 6)


@query("quantile_curves", "M11 D19 E22", f"""with w as (select date, {", ".join(f"coalesce(max(mean_return) filter (quantile={q}),0) as m{q}" for q in _Q)} from quantiles group by 1)
    select date, {", ".join(f'case when product(1+m{q}) over o>0 then {r(f"ln(product(1+m{q}) over o)")} end as "Q{q}"' for q in _Q)} from w window o as (order by date)""")
def quantile_curves(spark, sf_dir):
    out = metrics.quantile_curves(metrics.quantile_returns(scored(spark, sf_dir)))
    return rounded(out.select("date", *[F.log(f"Q{q}").alias(f"Q{q}") for q in _Q]))


@query("quantile_spread", "M11", f"""select date, {r("coalesce(max(mean_return) filter (quantile=5),0)-coalesce(max(mean_return) filter (quantile=1),0)")} as long_short from quantiles group by 1""")
def quantile_spread(spark, sf_dir):
    wide = metrics.quantile_returns(scored(spark, sf_dir)).groupBy("date").pivot("quantile", [1, 5]).agg(F.first("mean_return")).fillna(0.0)
    return rounded(wide.select("date", (F.col("5") - F.col("1")).alias("long_short")))


# --- selections ----------------------------------------------------------------------------------------------


@query("topk_by_date", "F2", """select 'top' as side, date, ticker, score from (select *, row_number() over (partition by date order by score desc, ticker) as k from scored) t where k<=3
    union all select 'bottom', date, ticker, score from (select *, row_number() over (partition by date order by score, ticker desc) as k from scored) t where k<=3""")
def topk_by_date(spark, sf_dir):
    rows = scored(spark, sf_dir)
    best = crosssection.top_k(rows, ["date"], 3).select(F.lit("top").alias("side"), "date", "ticker", "score")
    worst = crosssection.top_k(rows, ["date"], 3, bottom=True).select(F.lit("bottom").alias("side"), "date", "ticker", "score")
    return stack([best, worst])


@query("topk_global", "F1", "select ticker, date, score from scored order by score desc, ticker, date limit 50")
def topk_global(spark, sf_dir):
    return crosssection.global_top_k(scored(spark, sf_dir), 50).select("ticker", "date", "score")


@query("topk_flag", "F6", "select ticker, date, cast(row_number() over (partition by date order by score desc, ticker)<=10 as int)*1.0e0 as selected from scored")
def topk_flag(spark, sf_dir):
    return crosssection.selected_flag(scored(spark, sf_dir), 10).select("ticker", "date", "selected")


view("held", "select date, ticker from (select *, row_number() over (partition by date order by score desc, ticker) as k from scored) t where k<=10")


@query("holdings_turnover", "C14 G5", f"""with d as (select date, lead(date) over (order by date) as nxt from (select distinct date from held) t)
    select h.date, {r("1-count(p.ticker)*1.0e0/count(*)")} as turnover from held h left join (select d.nxt as date, ticker from held join d using (date)) p on p.date=h.date and p.ticker=h.ticker group by 1""")
def holdings_turnover(spark, sf_dir):
    held = crosssection.top_k(scored(spark, sf_dir), ["date"], 10).select("date", "ticker")
    return rounded(crosssection.holdings_turnover(held))


# --- backtests -----------------------------------------------------------------------------------------------

view("bt0", "select *, cast(signal in ('Buy','Strong Buy') as int) as position from scores")
view("bt1", """select *, coalesce(close/lag(close) over w-1,0) as asset_ret, coalesce(lag(position) over w,0) as before,
    coalesce(abs(position-lag(position) over w),position) as position_change from bt0 window w as (partition by ticker, model_id order by date)""")
view("bt", """select *, 10000*product(1+before*asset_ret) over w as equity, 10000*product(1+asset_ret) over w as benchmark_equity
    from bt1 window w as (partition by ticker, model_id order by date rows between unbounded preceding and current row)""")
view("deals", """select ticker, model_id, trade, min(date) as entry_date, max(date) as exit_date, max_by(equity,date)/min_by(equity,date)-1 as pnl_pct, min(position)=1 as still_open
    from (select *, sum(cast(position=1 and before=0 as int)) over (partition by ticker, model_id order by date) as trade from bt) t where position=1 or before=1 group by 1,2,3""")


def curve(spark, sf_dir):
    rows = scores(spark, sf_dir)
    return backtest.signal_curve(rows.select("ticker", "model_id", "date", "close", "signal"))


@query("backtest_signal_curve", "O1 C2 E22", f"""select ticker, model_id, date, position, {r("asset_ret")} as asset_ret, {r("before*asset_ret")} as strategy_ret,
    {r("ln(equity)")} as log_equity, {r("ln(benchmark_equity)")} as log_benchmark from bt""")
def backtest_signal_curve(spark, sf_dir):
    rows = scores(spark, sf_dir)
    joined = backtest.align_prices_and_signals(tables.bars(spark, sf_dir), rows)
    out = backtest.signal_curve(joined)
    return rounded(out.select("ticker", "model_id", "date", "position", "asset_ret", "strategy_ret", F.log("equity").alias("log_equity"), F.log("benchmark_equity").alias("log_benchmark")))


@query("backtest_trades", "O2", f"select ticker, model_id, cast(trade as bigint) as trade, entry_date, exit_date, still_open, {r('pnl_pct')} as pnl_pct from deals")
def backtest_trades(spark, sf_dir):
    return rounded(backtest.trades(curve(spark, sf_dir)))


def slog(x: str) -> str:
    """Signed logarithm in SQL: compounded figures of the synthetic bars outgrow a double's decimals."""
    return f"(sign({x})*ln(1+abs({x})))"


def _logged(df, columns):
    """``columns`` as signed logarithms, named log_*."""
    return df.withColumns({f"log_{c}": F.signum(c) * F.log1p(F.abs(c)) for c in columns}).drop(*columns)


view("bt_metrics", f"""with c as (select ticker, model_id, min(date) as start_date, max(date) as end_date, max_by(equity,date)/10000-1 as cumulative_return, count(*) as n,
      case when stddev_pop(before*asset_ret)>1e-12 then avg(before*asset_ret)/stddev_pop(before*asset_ret)*sqrt(252.0e0) else 0 end as sharpe_ratio, min(dd) as max_drawdown, avg(position_change) as turnover
      from (select *, equity/max(equity) over (partition by ticker, model_id order by date)-1 as dd from bt) t group by 1,2)
    select c.*, {slog('c.cumulative_return')} as log_cumulative_return, coalesce(d.total_trades,0) as total_trades, coalesce(d.win_rate,0) as win_rate, {slog('(power(1+c.cumulative_return,252.0e0/c.n)-1)')} as log_annualized_return from c left join
    (select ticker, model_id, count(*) as total_trades, avg(cast(pnl_pct>0 as int)) as win_rate from deals group by 1,2) d using (ticker, model_id)""")
_BT = ["log_cumulative_return", "sharpe_ratio", "max_drawdown", "turnover", "win_rate", "log_annualized_return"]



@query("backtest_signal_metrics", "O3", f"select ticker, model_id, start_date, end_date, total_trades, {', '.join(f'{r(c)} as {c}' for c in _BT)} from bt_metrics")
def backtest_signal_metrics(spark, sf_dir):
    return rounded(_logged(backtest.signal_metrics(curve(spark, sf_dir)), ["cumulative_return", "annualized_return"]))


@query("backtest_drawdown", "E23 E24", f"select ticker, model_id, date, {r('equity/max(equity) over (partition by ticker, model_id order by date)-1')} as drawdown, position_change from bt")
def backtest_drawdown(spark, sf_dir):
    out = curve(spark, sf_dir).withColumn("drawdown", backtest.drawdown("equity", backtest.RUN))
    return rounded(out.select("ticker", "model_id", "date", "drawdown", "position_change"))


@query("backtest_mean_by_model", "D14", f"select model_id, {', '.join(f'{r(f'avg({c})')} as {c}' for c in _BT)} from bt_metrics group by 1")
def backtest_mean_by_model(spark, sf_dir):
    return rounded(_logged(backtest.signal_metrics(curve(spark, sf_dir)), ["cumulative_return", "annualized_return"]).groupBy("model_id").agg(*[F.avg(c).alias(c) for c in _BT]))


@query("backtest_rollup", "D14", f"""select ticker, model_id, {r("avg(sharpe_ratio)")} as sharpe_ratio, {r("avg(turnover)")} as turnover, count(*) as n from bt_metrics group by rollup (model_id, ticker)""")
def backtest_rollup(spark, sf_dir):
    out = backtest.signal_metrics(curve(spark, sf_dir)).rollup("model_id", "ticker")
    return rounded(out.agg(F.avg("sharpe_ratio").alias("sharpe_ratio"), F.avg("turnover").alias("turnover"), F.count(F.lit(1)).alias("n")))


view("topk_daily", """select t.date, top_ret, bottom_ret, top_ret-bottom_ret as long_short_ret from
    (select date, avg(forward_return) as top_ret from (select *, row_number() over (partition by date order by score desc, ticker) as k from scored) a where k<=10 group by 1) t join
    (select date, avg(forward_return) as bottom_ret from (select *, row_number() over (partition by date order by score, ticker desc) as k from scored) a where k<=10 group by 1) b using (date)""")


@query("backtest_topk_daily", "O4", f"""select date, {r("top_ret")} as top_ret, {r("bottom_ret")} as bottom_ret, {r("long_short_ret")} as long_short_ret,
    {r("ln(product(1+top_ret) over (order by date))")} as log_long_only from topk_daily""")
def backtest_topk_daily(spark, sf_dir):
    out = backtest.top_k_daily(scored(spark, sf_dir), 10)
    return rounded(out.select("date", "top_ret", "bottom_ret", "long_short_ret", F.log("curve_long_only").alias("log_long_only")))


@query("backtest_topk_summary", "O4", f"""with d as (select date, lead(date) over (order by date) as nxt from (select distinct date from held) t),
    u as (select h.date, 1-count(p.ticker)*1.0e0/count(*) as turnover from held h left join (select d.nxt as date, ticker from held join d using (date)) p on p.date=h.date and p.ticker=h.ticker group by 1)
    select {r("avg(top_ret)")} as topk_mean_return, {r("avg(bottom_ret)")} as bottomk_mean_return, {r("avg(long_short_ret)")} as long_short_mean_return,
    case when stddev_pop(long_short_ret)>1e-12 then {r("avg(long_short_ret)/stddev_pop(long_short_ret)*sqrt(252.0e0)")} else 0 end as long_short_sharpe,
    case when stddev_pop(top_ret)>1e-12 then {r("avg(top_ret)/stddev_pop(top_ret)*sqrt(252.0e0)")} else 0 end as long_only_sharpe,
    {r("(select avg(turnover) from u)")} as turnover from topk_daily""")
def backtest_topk_summary(spark, sf_dir):
    return rounded(backtest.top_k_summary(scored(spark, sf_dir), 10))


view("port0", "select model_id, date, avg(ret_1d) as ret, avg(case when score>=0.6 then ret_1d else 0 end) as gross_ret, avg(cast(score>=0.6 as int)) as signal from outcomes group by 1,2")
view("port", """select *, coalesce(abs(signal-lag(signal) over w),signal) as pos_change, gross_ret-abs(signal-coalesce(lag(signal) over w,0))*0.0002e0 as net_ret
    from port0 window w as (partition by model_id order by date)""")
view("port_curves", """select *, product(1+ret) over w as buy_hold_curve, product(1+gross_ret) over w as gross_curve, product(1+net_ret) over w as net_curve
    from port window w as (partition by model_id order by date rows between unbounded preceding and current row)""")
view("port_dd", "select *, net_curve/max(net_curve) over (partition by model_id order by date)-1 as drawdown from port_curves")
_PORT = ["ret", "gross_ret", "signal", "pos_change", "net_ret", "drawdown"]


def portfolio(spark, sf_dir):
    return backtest.threshold_portfolio(outcomes(spark, sf_dir), "score", 0.6, by=["model_id"], cost_bps=2.0)


@query("backtest_threshold_daily", "O6 O7 D1", f"select model_id, date, {', '.join(f'{r(c, 8)} as {c}' for c in _PORT)}, {r('ln(net_curve)', 8)} as log_net from port_dd")
def backtest_threshold_daily(spark, sf_dir):
    return rounded(portfolio(spark, sf_dir).select("model_id", "date", *_PORT, F.log("net_curve").alias("log_net")), 8)


@query("backtest_threshold_stats", "O7 O5", f"""select model_id, {r("avg(ret)/stddev_samp(ret)*sqrt(252.0e0)")} as sharpe_bh, {r("avg(net_ret)/stddev_samp(net_ret)*sqrt(252.0e0)")} as sharpe_strategy_net,
    {r("min(drawdown)")} as max_dd_net from port_dd group by 1""")
def backtest_threshold_stats(spark, sf_dir):
    return rounded(backtest.portfolio_stats(portfolio(spark, sf_dir), ["model_id"]))


@query("backtest_from_signal", "O8", f"""with s as (select date, avg(ret_1d) as ret, avg(g*ret_1d) as gross_ret, avg(g) as signal from (select *, cast(score>=0.55 and ret_1d<=0.5 as int)*1.0e0 as g from scored) t group by 1)
    select date, {r("ret")} as ret, {r("gross_ret")} as gross_ret, {r("signal")} as signal, {r("gross_ret-abs(signal-coalesce(lag(signal) over (order by date),0))*0.0005e0")} as net_ret from s""")
def backtest_from_signal(spark, sf_dir):
    gated = scored(spark, sf_dir).withColumn("gate", ((F.col("score") >= 0.55) & (F.col("ret_1d") <= 0.5)).cast("double"))
    return rounded(backtest.daily_portfolio(gated, "gate", cost_bps=5.0).select("date", "ret", "gross_ret", "signal", "net_ret"))


@query("excess_spread", "O16", f"select model_id, date, {r('net_ret-ret')} as spread from port")
def excess_spread(spark, sf_dir):
    return rounded(backtest.excess_spread(portfolio(spark, sf_dir)).select("model_id", "date", "spread"))


view("tku", """select date, avg(ret_1d) as ret, avg(cast(k<=10 as int)) as selected, coalesce(avg(ret_1d) filter (k<=10),0) as topk_ret
    from (select *, row_number() over (partition by date order by score desc, ticker) as k from scored) t group by 1""")


@query("backtest_topk_vs_universe", "O9 C13 F6", f"""select date, {r("ret")} as ret, {r("selected")} as selected, {r("topk_ret")} as topk_ret,
    {r("coalesce(abs(selected-lag(selected) over (order by date)),selected)")} as selected_share_turnover, {r("sum(ln(1+topk_ret)) over (order by date)")} as log_topk from tku""")
def backtest_topk_vs_universe(spark, sf_dir):
    out = backtest.top_k_vs_universe(scored(spark, sf_dir), 10)
    grown = F.sum(F.log1p("topk_ret")).over(Window.orderBy("date"))  # one row per date
    return rounded(out.select("date", "ret", "selected", "topk_ret", "selected_share_turnover", grown.alias("log_topk")))


@query("backtest_topk_vs_universe_stats", "O9", f"""select {r("avg(topk_ret)/stddev_samp(topk_ret)*sqrt(252.0e0)")} as topk_sharpe, {r("avg(ret)/stddev_samp(ret)*sqrt(252.0e0)")} as universe_sharpe,
    {r("avg(t)")} as topk_turnover, {r("ln(product(1+topk_ret))")} as log_topk, {r("ln(product(1+ret))")} as log_universe
    from (select *, coalesce(abs(selected-lag(selected) over (order by date)),selected) as t from tku) x""")
def backtest_topk_vs_universe_stats(spark, sf_dir):
    out = backtest.top_k_vs_universe_stats(backtest.top_k_vs_universe(scored(spark, sf_dir), 10))
    return rounded(out.select("topk_sharpe", "universe_sharpe", "topk_turnover", F.log1p("topk_cum_return").alias("log_topk"), F.log1p("universe_cum_return").alias("log_universe")))


def _ticker_views(prefix, thresholds):
    view(f"{prefix}_a", """select * from (select *, row_number() over (partition by ticker, model_id order by date)-1 as i, count(*) over (partition by ticker, model_id) as n from scores) t where i>=floor(n*0.8e0)""")
    grid = ",".join(f"({t!r}::double)" for t in thresholds)
    view(f"{prefix}_b", f"""select a.*, threshold, cast(probability>=threshold as int) as position from
        (select *, coalesce(lead(returns) over (partition by ticker, model_id order by date),0) as nxt from {prefix}_a) a, (values {grid}) g(threshold)""")
    view(f"{prefix}_c", f"""select *, coalesce(abs(position-lag(position) over w),position) as trade, nxt*position as gross_return from {prefix}_b window w as (partition by ticker, model_id, threshold order by date)""")
    view(f"{prefix}_d", f"""select *, product(1+gross_return-trade*0.001e0) over w as cs, product(1+returns) over w as cb from {prefix}_c
        window w as (partition by ticker, model_id, threshold order by date rows between unbounded preceding and current row)""")
    view(f"{prefix}_e", f"select *, cs/max(cs) over (partition by ticker, model_id, threshold order by date)-1 as dd from {prefix}_d where returns is not null")
    return f"""with m as (select ticker, model_id, threshold, max_by(cs,date)-1 as total_return, max_by(cb,date)-1 as bnh_return, count(*) as n,
        coalesce(case when stddev_samp(gross_return-trade*0.001e0)>0 then avg(gross_return-trade*0.001e0)/stddev_samp(gross_return-trade*0.001e0)*sqrt(252.0e0) end,0) as sharpe,
        min(dd) as max_drawdown, coalesce(avg(cast(gross_return>0 as int)) filter (position=1),0) as win_rate, cast(sum(position) as bigint) as n_trades from {prefix}_e group by 1,2,3),
      a as (select *, power(1+total_return,252.0e0/n)-1 as ann_return from m)
      select ticker, model_id, threshold, {r(slog("total_return"), 4)} as log_total_return, {r("ln(1+bnh_return)", 4)} as log_bnh, {r("sharpe", 3)} as sharpe, {r("max_drawdown", 4)} as max_drawdown,
      {r("win_rate", 4)} as win_rate, n_trades, {r(slog("ann_return"), 4)} as log_ann_return, {r(slog("coalesce(ann_return/nullif(abs(max_drawdown),0),0)"), 3)} as log_calmar from a"""


SWEEP = [round(0.45 + 0.02 * i, 2) for i in range(14)]


def _ticker_result(df):
    out = _logged(df, ["total_return", "ann_return", "calmar"]).withColumn("log_bnh", F.log1p("bnh_return")).drop("bnh_return")
    three = ["sharpe", "log_calmar"]
    return rounded(out, 4, skip=[*three, "threshold"]).withColumns({c: F.round(c, 3) for c in three})


@query("backtest_ticker_metrics", "O10 O11", _ticker_views("tb", [0.55]))
def backtest_ticker_metrics(spark, sf_dir):
    rows = backtest.last_fraction(scores(spark, sf_dir), by=backtest.RUN)
    return _ticker_result(backtest.ticker_metrics(backtest.ticker_backtest(rows)))


@query("backtest_threshold_sweep", "O12 C16", _ticker_views("ts", SWEEP))
def backtest_threshold_sweep(spark, sf_dir):
    rows = backtest.last_fraction(scores(spark, sf_dir), by=backtest.RUN)
    return _ticker_result(backtest.ticker_metrics(backtest.ticker_backtest(rows, SWEEP)))


GRID = [0.45 + 0.005 * i for i in range(31)]
_GAINS = " union all ".join(f"select model_id, {t!r}::double as threshold, avg(case when score>={t!r}::double then ret_1d else 0 end) as gain from outcomes group by 1" for t in GRID)


@query("threshold_gains", "C16", f"select model_id, {r('threshold')} as threshold, {r('gain', 8)} as gain from ({_GAINS}) t")
def threshold_gains(spark, sf_dir):
    out = backtest.threshold_gains(outcomes(spark, sf_dir), GRID, ["model_id"])
    return out.select("model_id", F.round("threshold", 6).alias("threshold"), F.round("gain", 8).alias("gain"))


@query("threshold_pick", "N24 F9", f"select model_id, {r('threshold')} as threshold, {r('gain', 8)} as gain from (select *, row_number() over (partition by model_id order by gain desc, threshold) as k from ({_GAINS}) t) u where k=1")
def threshold_pick(spark, sf_dir):
    out = backtest.pick_threshold(outcomes(spark, sf_dir), GRID, ["model_id"])
    return out.select("model_id", F.round("threshold", 6).alias("threshold"), F.round("gain", 8).alias("gain"))


view("hold0", f"""select b.ticker, b.date, {r("b.rsi/100")} as score, fwd_return from tech b join (select ticker, date, {r("fwd", 8)} as fwd_return from
    (select ticker, date, sum(returns) over f as fwd, count(returns) over f as n from steps window f as (partition by ticker order by date rows between 1 following and 5 following)) t where n=5) f
    on f.ticker=b.ticker and f.date=b.date where b.rsi is not null""")
view("hold1", """select date, avg(fwd_return) filter (k<=5) as long_ret, avg(fwd_return) filter (j<=5) as short_ret, avg(fwd_return) as market_ret from
    (select *, row_number() over (partition by date order by score desc, ticker) as k, row_number() over (partition by date order by score, ticker desc) as j from hold0) t group by 1 having count(*)>=5""")
view("hold2", "select *, long_ret-short_ret as long_short_ret from (select *, row_number() over (order by date)-1 as i from hold1) t where i%5=0")


def holding_rows(spark, sf_dir):
    rows = forward_sum(indicators(spark, sf_dir)).filter(F.col("rsi").isNotNull())
    return rows.select("ticker", "date", F.round(F.col("rsi") / 100, 6).alias("score"), F.round("fwd_return", 8).alias("fwd_return"))


@query("backtest_holding", "O13 F5 E25", f"""select date, {r("long_ret")} as long_ret, {r("short_ret")} as short_ret, {r("market_ret")} as market_ret, {r("long_short_ret")} as long_short_ret,
    {r("ln(product(1+long_ret) over (order by date))")} as log_long from hold2""")
def backtest_holding(spark, sf_dir):
    out = backtest.holding_period(holding_rows(spark, sf_dir))
    return rounded(out.select("date", "long_ret", "short_ret", "market_ret", "long_short_ret", F.log("cum_long").alias("log_long")))


@query("backtest_holding_stats", "O13", f"""select {", ".join(r(f"avg({s}_ret)/stddev_samp({s}_ret)*sqrt(50.0e0)") + f" as sharpe_{s}" for s in ("long", "long_short", "market"))} from hold2""")
def backtest_holding_stats(spark, sf_dir):
    out = backtest.holding_stats(backtest.holding_period(holding_rows(spark, sf_dir)))
    return rounded(out.select("sharpe_long", "sharpe_long_short", "sharpe_market"))


@query("backtest_compare_models", "O14", f"""select t.ticker, m.model_id, b.ticker is not null as ok, case when b.ticker is null then 'no overlapping dates between price and predictions' end as error,
    {r("b.sharpe_ratio")} as sharpe_ratio from (select distinct ticker from bars) t cross join (values ('momentum'),('reversal'),('model_x')) m(model_id)
    left join bt_metrics b on b.ticker=t.ticker and b.model_id=m.model_id""")
def backtest_compare_models(spark, sf_dir):
    done = backtest.signal_metrics(curve(spark, sf_dir))
    out = backtest.compare_models(done, tables.bars(spark, sf_dir), ["momentum", "reversal", "model_x"])
    return rounded(out.select("ticker", "model_id", "ok", "error", "sharpe_ratio"))


@query("backtest_preflight", "O15", """select t.ticker, coalesce(p.ok,false) and coalesce(c.ok,false) as ready, coalesce(p.ok,false) as has_prices, coalesce(c.ok,false) as has_features,
    case when p.ok is null and c.ok is null then 'missing cached OHLCV and combined features' when p.ok is null then 'missing cached OHLCV' when c.ok is null then 'missing combined features' else '' end as reason
    from (select ticker from sector_map union all select 'NONE') t left join (select distinct ticker, true as ok from bars where ticker not like '%4') p using (ticker)
    left join (select distinct ticker, true as ok from fundamentals where "ReturnOnEquityTTM"<>'None') c using (ticker)""")
def backtest_preflight(spark, sf_dir):
    tickers = tables.sector_map(spark, sf_dir).select("ticker").unionByName(spark.range(1).select(F.lit("NONE").alias("ticker")))
    prices = tables.bars(spark, sf_dir).filter(~F.col("ticker").like("%4"))
    feats = tables.fundamentals(spark, sf_dir).filter(F.col("ReturnOnEquityTTM") != "None")
    return backtest.preflight(tickers, prices, feats)


# --- tests ---------------------------------------------------------------------------------------------------

view("losses", """select model_id, date, -ln(p)*y-ln(1-p)*(1-y) as loss_model, -ln(0.5e0) as loss_constant from
    (select model_id, date, least(greatest(avg(score),0.01e0),0.99e0) as p, cast(avg(ret_1d)>0 as int) as y from outcomes group by 1,2) t""")


@query("daily_losses", "P2 H7 B22", f"select model_id, date, {r('loss_model')} as loss_model, {r('loss_constant')} as loss_constant from losses")
def daily_losses(spark, sf_dir):
    return rounded(inference.daily_direction_losses(outcomes(spark, sf_dir), "score", by=["model_id"]))


_DM = """with d as (select model_id, date, loss_model-loss_constant as d from losses), e as (select *, d-avg(d) over (partition by model_id) as e, count(*) over (partition by model_id) as n from d),
    l as (select *, {lags} from e window w as (partition by model_id order by date)),
    g as (select model_id, max(n) as n, avg(d) as mean_d, avg(e*e) as g0, {covs} from l group by 1),
    v as (select *, g0/n {terms} as v from g)
    select model_id, {mean} as mean_d, {var} as var_mean_d, {stat} as dm_stat from v"""
_DM5 = _DM.format(
    lags=", ".join(f"lag(e,{k}) over w as e{k}" for k in range(1, 6)),
    covs=", ".join(f"avg(e*e{k}) as g{k}" for k in range(1, 6)),
    terms=" ".join(f"+ 2*(1-{k}/6.0e0)*g{k}/n" for k in range(1, 6)),
    mean=r("mean_d", 8),
    var=r("case when v>0 then v else 0 end", 10),
    stat=r("case when v>0 then mean_d/sqrt(v) else 0 end"),
)


@query("dm_test", "P1", _DM5)
def dm_test(spark, sf_dir):
    losses = inference.daily_direction_losses(outcomes(spark, sf_dir), "score", by=["model_id"])
    out = inference.diebold_mariano(losses, "loss_model", "loss_constant", h=5, by=["model_id"])
    return out.select("model_id", F.round("mean_d", 8).alias("mean_d"), F.round("var_mean_d", 10).alias("var_mean_d"), F.round("dm_stat", 6).alias("dm_stat"))


@query("dm_p_value", "P1 H8")
def dm_p_value(spark, sf_dir):
    losses = inference.daily_direction_losses(outcomes(spark, sf_dir), "score", by=["model_id"])
    return inference.with_two_sided_p(inference.diebold_mariano(losses, "loss_model", "loss_constant", h=5, by=["model_id"]))


@query("forecast_binary_check", "B22 B23", f"""select ticker, date, {r("least(greatest(score,0),1)")} as soft, cast(target>=0.6 as int)*1.0e0 as hard from scored""")
def forecast_binary_check(spark, sf_dir):
    rows = scored(spark, sf_dir)
    soft = forecast_probability(rows, "score", 0.6).withColumnRenamed("forecast_proba", "soft")
    return rounded(forecast_probability(soft, "target", 0.6).select("ticker", "date", "soft", F.col("forecast_proba").alias("hard")))


_STATE = "((rep*73856093+blk*19349663+42::bigint*83492791)%2147483647)"
view("spread_series", "select model_id, net_ret-ret as x, row_number() over (partition by model_id order by date)-1 as pos from port")


@query("block_bootstrap", "P3", f"""with s as (select model_id, count(*) as n, avg(x) as observed_mean from spread_series group by 1),
    d as (select model_id, n, rep, i, i//5 as blk from s, generate_series(0,199) a(rep), generate_series(0,(select max(n) from s)-1) b(i) where i<n),
    h1 as (select *, {_STATE} as s0 from d), h2 as (select *, (s0*s0+s0*48271+12345)%2147483647 as s1 from h1), h3 as (select *, (s1*s1+s1*16807+1)%2147483647 as s2 from h2),
    m as (select h.model_id, rep, avg(x) as mean from h3 h join spread_series q on q.model_id=h.model_id and q.pos=(s2%n+i%5)%n group by 1,2)
    select s.model_id, {r("max(observed_mean)", 8)} as observed_mean, {r("avg(cast(mean>=observed_mean as int))")} as p_value_one_sided, {r("avg(mean)", 8)} as bootstrap_mean,
    {r("stddev_samp(mean)", 8)} as bootstrap_std, cast(null as varchar) as note from s join m using (model_id) group by 1""")
def block_bootstrap(spark, sf_dir):
    daily = backtest.excess_spread(portfolio(spark, sf_dir))
    out = inference.block_bootstrap(daily, "spread", reps=200, by=["model_id"])
    return rounded(out, 8, skip=["p_value_one_sided"]).withColumn("p_value_one_sided", F.round("p_value_one_sided", 6))

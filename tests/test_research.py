import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest, crosssection, inference, metrics, splits, summaries


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(i) for i in range(n)]


def axis(spark, n):
    return spark.createDataFrame([(d,) for d in days(n)], "date date")


def test_chronological_split_is_ordered_and_complete(spark):
    out = splits.chronological(axis(spark, 100))
    assert {r["role"]: r["count"] for r in out.groupBy("role").count().collect()} == {"train": 70, "validation": 15, "test": 15}
    assert splits.order_violations(out).count() == 0


def test_split_size_errors(spark):
    with pytest.raises(ValueError, match="at least 60 rows"):
        splits.require_size(axis(spark, 10))
    with pytest.raises(ValueError, match="unique dates"):
        splits.require_size(spark.createDataFrame([(days(5)[i % 5],) for i in range(70)], "date date"))


@pytest.mark.parametrize("make", [lambda d: splits.walk_forward(d), lambda d: splits.purged_kfold(d, horizon=3), lambda d: splits.time_series_split(d, gap=5)])
def test_training_precedes_test(spark, make):
    out = make(axis(spark, 300)).groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("date"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("date"))).alias("b")).collect()
    assert out and all(r["a"] < r["b"] for r in out)


def test_purge_removes_the_leaking_date(spark):
    out = splits.combinatorial_purged(axis(spark, 80), groups=16, test_groups=1, embargo=0, horizon=1, max_splits=None).filter("fold = 1").toPandas()
    kept = set(out[out["role"] == "train"]["date"])
    d = days(80)
    assert set(out[out["role"] == "test"]["date"]) == set(d[5:10])
    assert d[4] not in kept and d[3] in kept and d[10] in kept


def test_per_block_purge_keeps_dates_between_blocks(spark):
    wide = splits.combinatorial_purged(axis(spark, 200), groups=8, test_groups=2, max_splits=None)
    tight = splits.combinatorial_purged(axis(spark, 200), groups=8, test_groups=2, max_splits=None, per_block=True)
    n = lambda df: df.filter("role = 'train'").count()
    assert n(tight) > n(wide)


def test_combinations_are_sampled_reproducibly():
    a, b = (splits.combinations(8, 2, 10, 42) for _ in range(2))
    assert a == b and len(a) == 10 and len(splits.combinations(8, 2, None, 42)) == 28


PRICES = [100.0, 101.0, 103.0, 102.0, 104.0, 105.0]
SIGNALS = ["Hold", "Buy", "Buy", "Hold", "Buy", "Sell"]


def test_signal_backtest_by_hand(spark):
    rows = spark.createDataFrame([("A", "m", d, c, s) for d, c, s in zip(days(6), PRICES, SIGNALS, strict=True)], "ticker string, model_id string, date date, close double, signal string")
    curve = backtest.signal_curve(rows)
    got = curve.orderBy("date").toPandas()
    r = pd.Series(PRICES).pct_change().fillna(0)
    pos = pd.Series([0, 1, 1, 0, 1, 0])
    equity = 10_000 * (1 + pos.shift(1).fillna(0) * r).cumprod()
    assert np.allclose(got["equity"], equity)
    deals = backtest.trades(curve).orderBy("trade").toPandas()
    assert np.allclose(deals["pnl_pct"], [equity[3] / equity[1] - 1, equity[5] / equity[4] - 1])
    m = backtest.signal_metrics(curve).first()
    assert m["total_trades"] == 2 and m["win_rate"] == 1.0
    assert abs(m["turnover"] - pos.diff().abs().fillna(pos[0]).mean()) < 1e-12
    assert abs(m["max_drawdown"] - (equity / equity.cummax() - 1).min()) < 1e-12
    strat = pos.shift(1).fillna(0) * r
    assert abs(m["sharpe_ratio"] - strat.mean() / strat.std(ddof=0) * 252**0.5) < 1e-9


def test_open_trade_closes_on_the_last_row(spark):
    rows = spark.createDataFrame([("A", "m", d, c, "Buy") for d, c in zip(days(3), [1.0, 2.0, 4.0], strict=True)], "ticker string, model_id string, date date, close double, signal string")
    curve = backtest.signal_curve(rows)
    deal = backtest.trades(curve).first()
    assert deal["still_open"] and deal["pnl_pct"] == 3.0
    assert backtest.signal_metrics(curve).first()["total_trades"] == 1


def test_flat_run_has_zero_sharpe(spark):
    rows = spark.createDataFrame([("A", "m", d, 5.0, "Sell") for d in days(4)], "ticker string, model_id string, date date, close double, signal string")
    m = backtest.signal_metrics(backtest.signal_curve(rows)).first()
    assert (m["sharpe_ratio"], m["total_trades"], m["win_rate"], m["max_drawdown"]) == (0.0, 0, 0.0, 0.0)


def test_costs_by_hand(spark):
    rows = spark.createDataFrame([(d, g, p) for d, g, p in zip(days(4), [0.01, 0.02, -0.01, 0.0], [1.0, 1.0, 0.0, 1.0], strict=True)], "date date, g double, p double")
    out = [r[0] for r in rows.orderBy("date").select(backtest.net_of_costs("g", "p", 0.001, [])).collect()]
    assert np.allclose(sorted(out), sorted([0.009, 0.02, -0.011, -0.001]))
    with pytest.raises(ValueError):
        backtest.net_of_costs("g", "p", -1.0, [])


def test_threshold_ties_go_to_the_lowest(spark):
    rows = spark.createDataFrame([(0.9, 0.1), (0.2, -0.1)], "score double, ret_1d double")
    assert backtest.pick_threshold(rows, [0.45, 0.5, 0.6]).first()["threshold"] == 0.45


def test_dm_equal_losses_and_short_series(spark):
    rows = [("a", d, 0.3, 0.3) for d in days(10)] + [("b", d, 0.3, 0.1) for d in days(4)]
    out = inference.with_two_sided_p(inference.diebold_mariano(spark.createDataFrame(rows, "m string, date date, x double, y double"), "x", "y", 1, ["m"])).collect()
    assert [(r["m"], r["dm_stat"], r["p_value_two_sided"]) for r in out] == [("a", 0.0, 1.0)]


def test_dm_against_numpy(spark):
    rng = np.random.default_rng(5)
    d = rng.normal(0.1, 1, 60)
    got = inference.diebold_mariano(spark.createDataFrame([(x, float(v), 0.0) for x, v in zip(days(60), d, strict=True)], "date date, a double, b double"), "a", "b", 3).first()
    e = d - d.mean()
    var = (e**2).mean() / 60 + sum(2 * (1 - k / 4) * (e[k:] * e[:-k]).mean() / 60 for k in (1, 2, 3))
    assert abs(got["dm_stat"] - d.mean() / var**0.5) < 1e-9


def test_bootstrap_reproducible_and_too_short(spark):
    rng = np.random.default_rng(6)
    long = spark.createDataFrame([(d, float(v)) for d, v in zip(days(200), rng.normal(0.05, 1, 200), strict=True)], "date date, x double")
    a, b = (inference.block_bootstrap(long, "x", 100).first() for _ in range(2))
    assert a["p_value_one_sided"] == b["p_value_one_sided"] and 0 <= a["p_value_one_sided"] <= 1
    assert abs(a["bootstrap_mean"] - a["observed_mean"]) < 4 * a["bootstrap_std"]
    short = inference.block_bootstrap(long.limit(2), "x").first()
    assert short["p_value_one_sided"] == 1.0 and short["note"] == "too_few_observations"


def test_bins_at_exact_edges(spark):
    rows = spark.createDataFrame([(0.3, 1), (1.0, 1), (0.0, 0), (0.1, 0)], "score double, target int")
    out = {r["bin"]: r["count"] for r in metrics.reliability(rows, []).collect()}
    assert len(out) == 10 and out[9] == 1 and out[0] == 1 and out[1] == 1 and out[2] == 1 and out[3] == 0


def test_constant_cross_section_has_no_ic(spark):
    rows = [(days(1)[0], t, 0.5, float(i)) for i, t in enumerate("abcd")] + [(days(2)[1], t, i / 10, float(i)) for i, t in enumerate("abcd")]
    out = {r["date"]: r["rank_ic"] for r in metrics.daily_ic(spark.createDataFrame(rows, "date date, ticker string, score double, forward_return double")).collect()}
    assert out[days(1)[0]] is None and abs(out[days(2)[1]] - 1.0) < 1e-12


def test_one_ticker_date_and_ties(spark):
    rows = spark.createDataFrame([(days(1)[0], "a", 0.5, 1.0, 1), (days(2)[1], "a", 0.5, 1.0, 1), (days(2)[1], "b", 0.5, 2.0, 0)], "date date, ticker string, score double, forward_return double, target int")
    out = {r["date"]: (r["k_used"], r["portfolio_return"]) for r in metrics.fraction_by_date(rows).collect()}
    assert out == {days(1)[0]: (1, 1.0), days(2)[1]: (1, 1.0)}
    assert {(r["date"], r["quantile"]) for r in metrics.quantile_returns(rows).collect()} == {(days(2)[1], 1), (days(2)[1], 2)}


def test_turnover_starts_at_one(spark):
    d = days(3)
    held = spark.createDataFrame([(d[0], "a"), (d[0], "b"), (d[1], "b"), (d[1], "c"), (d[2], "b"), (d[2], "c")], "date date, ticker string")
    assert [r["turnover"] for r in crosssection.holdings_turnover(held).orderBy("date").collect()] == [1.0, 0.5, 0.0]


def test_all_positive_labels(spark):
    rows = spark.createDataFrame([(0.2, 1), (0.9, 1)], "score double, target int")
    assert metrics.ranking_quality(rows, []).first()["roc_auc"] is None
    assert summaries.positive_weight(rows).first()[0] == 1.0


def test_describe_matches_pandas(spark):
    x = pd.Series(np.random.default_rng(8).gamma(2, 2, 200))
    row = summaries.describe(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]).first()
    assert abs(row["skew"] - x.skew()) < 1e-9 and abs(row["kurtosis"] - x.kurt()) < 1e-9


def test_student_tail(spark):
    from quantloom.functions.tails import student_t_two_sided

    p = spark.createDataFrame([(2.228, 10.0), (0.0, 5.0), (12.706, 1.0)], "t double, v double").select(student_t_two_sided("t", "v")).collect()
    assert np.allclose([r[0] for r in p], [0.05, 1.0, 0.05], atol=2e-4)


def test_group_comparison_names_absent_features(spark):
    import pytest

    from quantloom.models import research

    rows = spark.createDataFrame([(0.1, 0.2, 1)], "a double, b double, target int")
    with pytest.raises(ValueError, match="'gone'"):
        research.group_comparison(rows, rows, {"g": ["a", "b", "gone"]})


def test_model_queries_shorten_no_solver():
    from quantloom.models.specs import SPECS
    from quantloom.plans import modelling

    assert modelling.light("baseline_lr") == SPECS["baseline_lr"]
    trees = {"gbt": "maxIter", "ranker": "maxIter", "forest": "numTrees"}
    for name, spec in SPECS.items():
        for (kind, full), (_, used) in zip(spec.parts, modelling.light(name).parts, strict=True):
            assert {k: v for k, v in used.items() if k != trees.get(kind)} == {k: v for k, v in full.items() if k != trees.get(kind)}


def test_walks_start_from_the_whole_background(spark):
    from quantloom.models.attribution import walks

    background = spark.createDataFrame([(float(k), -float(k)) for k in range(7)], "a double, b double")
    for permutations, each in ((3, 1), (7, 1), (8, 2)):
        starts = [row for _, row in walks(background, ["a", "b"], permutations)]
        assert sorted(starts) == sorted([[float(k), -float(k)] for k in range(7)] * each)

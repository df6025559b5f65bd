"""Whole batch jobs over the universe: refresh, backtest of many models, research run.

Each is a composition of the operators; stages meet in stored tables, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.vocabulary import LAG, TECHNICAL
from quantloom.models import folds, research, training
from quantloom.models.specs import ABLATION_STEPS, FOREST, META, PCA_LOGISTIC, STRATEGY_GROUPS, Spec, spec_of
from quantloom.operators import backtest, fundamentals, incremental, inference, metrics, quality, sentiment, splits, summaries
from quantloom.operators.merge import stack
from quantloom.operators.projections import forecast_probability, signal
from quantloom.sources import store as tables_at_rest
from quantloom.sources.store import SliceStore

THRESHOLDS = [0.45 + 0.005 * i for i in range(31)]


def refresh(store: SliceStore, universe: DataFrame, increment: DataFrame, snapshot: DataFrame, scored_news: DataFrame, run_id: str, lineage_path: str | None = None, window: int = 3) -> DataFrame:
    """Merge new bars, bring the slices of the tickers that changed up to date, record lineage.

    Change propagation: bars that equal the stored ones change nothing. Per changed ticker the technical slice is recomputed from its first changed day
    (``operators/incremental.py``), fundamentals and sentiment are merged into what is stored and never replaced by NULL or by zeros for lack of a snapshot or of older news.
    Articles are kept scored, so that a window over old and new ones is whole. Buckets without a touched ticker are neither read nor written.
    """
    lineage = quality.refresh_lineage(universe, increment, run_id)
    good = lineage.filter(F.col("status") == "completed").select("ticker")
    fixed = lambda df: training.stored(df, "refresh")  # noqa: E731 - small tables that several steps read
    new = fixed(increment.join(good, "ticker", "left_semi"))
    first = fixed(incremental.first_changes(store.load_tickers("bars", new), new))
    store.merge("bars", new.join(first, "ticker").filter(F.col("date") >= F.col("first")).drop("first"))
    bars = store.load_tickers("bars", first)
    if bars is not None:
        rows, state = incremental.split_state(fixed(incremental.technical_from(bars, first, store.load_tickers("state", first))))
        store.replace_from("technical", rows, first)
        store.replace_from("state", state, first)

    ratios = fixed(fundamentals.ratios(snapshot))
    either = fixed(first.select("ticker").unionByName(ratios.select("ticker")).distinct())
    dates = store.load_tickers("bars", either)
    if dates is not None:
        store.merge("fundamental", incremental.fundamental_changes(dates, store.load_tickers("fundamental", either), ratios, first))

    texts = [c for c in scored_news.columns if c not in ("ticker", "day")]
    articles = scored_news.withColumn("date", F.col("day")).withColumn("article", F.sha2(F.to_json(F.struct(*texts)), 256)).select("ticker", "date", "article", "day", "score", "label")
    known = store.load_tickers("articles", articles)
    fresh = fixed(articles if known is None else articles.join(known.select("ticker", "date", "article"), ["ticker", "date", "article"], "left_anti"))
    store.merge("articles", fresh, ("ticker", "date", "article"))
    either = fixed(first.select("ticker").unionByName(fresh.select("ticker")).distinct())
    dates = store.load_tickers("bars", either)
    if dates is not None:
        days = fixed(incremental.sentiment_days(dates, first, fresh, window))
        held = store.load_tickers("articles", days)
        if held is None:
            held = fresh
        near = held.select("ticker", "day", "score", "label", "date")
        store.merge("sentiment", sentiment.rolling_features(near, days, window))
    if lineage_path:
        tables_at_rest.append_lineage(lineage, lineage_path)
    return lineage


def backtest_models(features: DataFrame, bars: DataFrame, models: dict[str, training.FittedModel], start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Curves and metrics of every (ticker, model): score, signal, backtest in one plan."""
    from quantloom.operators.projections import between_dates

    rows = between_dates(features, start, end)
    scored = []
    for name, model in models.items():
        filled = rows.fillna(0.0, list(model.spec.features))
        scored.append(model.score(filled).select("ticker", "date", F.lit(name).alias("model_id"), "probability"))
    signals = stack(scored).withColumn("signal", signal(F.col("probability")))
    curve = backtest.signal_curve(backtest.align_prices_and_signals(bars, signals))
    return curve, backtest.signal_metrics(curve)


def research_run(
    panel: DataFrame,
    label: str = "target",
    cost_bps: float = 2.0,
    top_k: int = 10,
    bootstrap: int = 200,
    models: dict[str, Spec] | None = None,
    primary: Spec = FOREST,
    meta: Spec = META,
    groups: dict[str, Sequence[str]] = STRATEGY_GROUPS,
    steps: dict[str, Sequence[str]] = ABLATION_STEPS,
    cv: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Holdout study of a labelled panel (ticker, date, features, ret_1d, forward_return, label) as named result tables.

    Models are fitted on the training dates, the best by validation rank-IC sets the threshold, and the test dates give
    metrics, cost-adjusted backtests, the forecast test, the bootstrap, the meta-gated variant and the comparison of feature groups. Four schemes of
    folds are run on every ablation step (the combinatorial one on the last), unless their scores are given as ``cv`` (``folds.scores``).
    """
    features = TECHNICAL + LAG
    models = models or {"logreg_baseline": spec_of("baseline_lr"), "pca_logistic": PCA_LOGISTIC.with_features(features), "random_forest": primary}
    marked = training.stored(panel.join(splits.chronological(panel, clamp=False), "date"), "research-panel")
    part = {role: marked.filter(F.col("role") == role) for role in ("train", "validation", "test")}
    results = {"label_distribution": summaries.label_distribution(marked, ["role"], label)}

    keep = ["ticker", "date", "ret_1d", "forward_return", F.col(label).alias("target")]
    fitted = {name: training.fit(spec, part["train"], label) for name, spec in models.items()}

    def scored_by_all(role: str) -> DataFrame:
        rows = [m.score(part[role]).select(*keep, F.lit(name).alias("model"), F.col("probability").alias("score")) for name, m in fitted.items()]
        return training.stored(stack(rows), f"scored-{role}")

    validation, test = scored_by_all("validation"), scored_by_all("test")
    by = ["model"]
    quarter = F.floor(F.col("n") * 0.25).cast("long")
    results["model_metrics"] = (
        metrics.classification(test, by)
        .join(metrics.ranking_quality(test, by), by)
        .join(metrics.precision_recall_at(test, by, quarter, ["ticker", "date"]).drop("k"), by)
        .join(metrics.calibration_error(test, by), by)
        .join(metrics.selection_metrics(test, by), by)
        .join(metrics.information_coefficients(test, by), by, "left")
    )
    results["reliability"] = metrics.reliability(test, by)

    best = summaries.best_by(metrics.information_coefficients(validation, by), "rank_ic_mean", "model").first()["best"]  # one name
    threshold = backtest.pick_threshold(validation.filter(F.col("model") == best), THRESHOLDS).first()["threshold"]  # one value
    chosen = test.filter(F.col("model") == best)
    daily = backtest.threshold_portfolio(chosen, "score", threshold, cost_bps=cost_bps)
    results["backtest_daily"] = daily
    stats = training.stored(backtest.portfolio_stats(daily), "stats")
    results["backtest_stats"] = stats
    results["spread_bootstrap"] = inference.block_bootstrap(backtest.excess_spread(daily), "spread", bootstrap)
    forecast = forecast_probability(chosen, "score", threshold)
    losses = inference.daily_direction_losses(forecast, "forecast_proba")
    results["forecast_test"] = inference.with_two_sided_p(inference.diebold_mariano(losses, "loss_model", "loss_constant", h=5))

    before = part["train"].unionByName(part["validation"])
    oof = research.out_of_fold(before, research.out_of_fold_splits(before), primary, label)
    gatekeeper = research.fit_meta(before, oof, None, primary.features, threshold, meta)
    first = training.fit(primary, part["train"], label).score(part["test"]).withColumnRenamed("probability", "proba_primary")
    gated = research.gate(gatekeeper.score(first).withColumnRenamed("probability", "proba_meta"), threshold)
    results["backtest_meta"] = backtest.portfolio_stats(backtest.daily_portfolio(gated, "signal_meta", cost_bps=cost_bps))
    results["backtest_topk"] = backtest.top_k_vs_universe_stats(backtest.top_k_vs_universe(chosen, top_k))
    results["dashboard"] = summaries.dashboard(
        results["model_metrics"].select("model", "ic_mean", "rank_ic_mean", "precision_at_k", "long_short_spread", "top_quantile_return"),
        next(iter(models)), best, stats.first()["sharpe_strategy_net"],
    )
    results["strategy_comparison"] = research.group_comparison(part["train"], part["test"], groups, primary, label)
    if cv is None:
        last = list(steps)[-1]
        matrix = folds.build(panel, sorted({f for names in steps.values() for f in names}), splits.research_schemes(panel.select("date")), label)
        cv = folds.scores(matrix, steps, primary, only={"cpcv": [last]})
    results["cv_fold_metrics"] = folds.fold_metrics(cv)
    results["cv_summary"] = summaries.cv_summary(results["cv_fold_metrics"])
    results["quantile_curves"] = metrics.quantile_curves(metrics.quantile_returns(chosen))
    return results


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """Every result table as CSV."""
    for name, df in results.items():
        tables_at_rest.write_result(df, f"{folder}/{name}")

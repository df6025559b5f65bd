"""Evaluation metrics (M1-M11, M13), each for all groups (models, splits) in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import div, pearson
from quantloom.functions.vocabulary import TRADING_DAYS
from quantloom.operators.crosssection import positions, share_down, share_up
from quantloom.operators.ordering import MAX_GROUP_ROWS, average_ranks, positions_and_ranks, running_sums, with_position


def sharpe(x: Column | str, ddof: int = 1, periods: float = TRADING_DAYS, on_zero: float | None = None, eps: float = 0.0) -> Column:
    """Annualised mean over deviation as an aggregate (O5); ``on_zero`` answers a flat or single-row series."""
    x = F.col(x) if isinstance(x, str) else x
    sd = F.stddev_samp(x) if ddof else F.stddev_pop(x)
    value = F.when(sd > eps, F.avg(x) / sd * F.sqrt(F.lit(float(periods))))
    return value if on_zero is None else F.coalesce(value, F.lit(on_zero))


def _paired(df: DataFrame, p: str, y: str) -> DataFrame:
    return df.filter(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())


def classification(df: DataFrame, by: Sequence[str], p: str = "score", y: str = "target", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and Brier score (M1, M4). Rows without score or label do not count."""
    hat, yes = F.col(p) >= threshold, F.col(y) == 1
    n = lambda c: F.sum(c.cast("long"))
    counts = _paired(df, p, y).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        n(hat & yes).alias("tp"),
        n(hat & ~yes).alias("fp"),
        n(~hat & yes).alias("fn"),
        F.avg(F.pow(F.col(y) - F.col(p), 2)).alias("brier"),
    )
    zero = F.lit(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by,
        ((F.col("n") - fp - fn) / F.col("n")).alias("accuracy"),
        F.coalesce(div(tp, tp + fp), zero).alias("precision"),
        F.coalesce(div(tp, tp + fn), zero).alias("recall"),
        F.coalesce(div(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
        "brier",
    )


def score_curve(df: DataFrame, by: Sequence[str], p: str = "score", y: str = "target", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """One row per distinct score, best first, with cumulative and total positives and negatives."""
    counts = df.groupBy(*by, F.col(p).alias("threshold")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg")
    )
    return running_sums(
        counts, by, [F.col("threshold").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, {"all_pos": "tp", "all_neg": "fp"}, max_group_rows
    )


def ranking_quality(df: DataFrame, by: Sequence[str], p: str = "score", y: str = "target", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """ROC-AUC with half credit for ties and average precision (M2, M3)."""
    c = score_curve(df, by, p, y, max_group_rows)
    above = F.col("tp") - F.col("pos") / F.lit(2.0)
    return c.groupBy(*by).agg(
        div(F.sum(F.col("neg") * above), F.max("all_pos") * F.max("all_neg")).alias("roc_auc"),
        F.sum(div(F.col("pos"), F.col("all_pos")) * div(F.col("tp"), F.col("tp") + F.col("fp"))).alias("pr_auc"),
    )


def roc_points(df: DataFrame, by: Sequence[str], p: str = "score", y: str = "target", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """False and true positive rate at every distinct score."""
    c = score_curve(df, by, p, y, max_group_rows)
    return c.select(*by, "threshold", div("fp", "all_neg").alias("fpr"), div("tp", "all_pos").alias("tpr"))


def precision_recall_at(df: DataFrame, by: Sequence[str], k: Column, tie: Sequence[str], p: str = "score", y: str = "target", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Precision and recall among the best k rows of each group; ``k`` may use the group size ``n`` (M5)."""
    ranked = with_position(df, by, [F.col(p).desc(), *[F.col(t).asc() for t in tie]], "pos", "n", max_group_rows)
    ranked = ranked.withColumn("_k", F.greatest(F.lit(1), F.least(k, F.col("n"))))
    hits = F.sum(F.when(F.col("pos") <= F.col("_k"), F.col(y)).otherwise(0))
    return ranked.groupBy(*by).agg(
        F.max("_k").alias("k"), (hits / F.max("_k")).alias("precision_at_k"), div(hits, F.nullif(F.sum(y), F.lit(0))).alias("recall_at_k")
    )


def probability_bin(p: str, bins: int) -> Column:
    """Bin by the interior edges at or below p; 1.0 falls in the last bin."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in edges), F.lit(0))


def reliability(df: DataFrame, by: Sequence[str], p: str = "score", y: str = "target", bins: int = 10) -> DataFrame:
    """Mean forecast and observed rate of every bin, empty bins listed with NULLs."""
    df = _paired(df, p, y)
    got = df.groupBy(*by, probability_bin(p, bins).alias("bin")).agg(F.avg(p).alias("pred_mean"), F.avg(y).alias("obs_freq"), F.count(F.lit(1)).alias("count"))
    every = got.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(got, [*by, "bin"], "left").fillna(0, ["count"])


def calibration_error(df: DataFrame, by: Sequence[str], p: str = "score", y: str = "target", bins: int = 10) -> DataFrame:
    """Expected calibration error: bin gaps weighted by bin size (M6)."""
    curve = reliability(df, by, p, y, bins)
    return curve.groupBy(*by).agg((F.sum(F.col("count") * F.abs(F.col("obs_freq") - F.col("pred_mean"))) / F.sum("count")).alias("ece"))


def _usable(df: DataFrame, score: str, ret: str) -> DataFrame:
    return df.dropna(subset=["date", score, ret])


def selection_by_date(df: DataFrame, by: Sequence[str] = (), score: str = "score", ret: str = "forward_return", top_q: float = 0.2, bottom_q: float = 0.2, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Mean return of the top and bottom share of each date and the top share's hit rate."""
    rows = positions(_usable(df, score, ret), [*by, "date"], score, max_group_rows=max_group_rows)
    r = F.col(ret)
    top, bottom = F.col("pos") <= share_up(top_q), F.col("pos") > F.col("n") - share_up(bottom_q)
    return rows.groupBy(*by, "date").agg(
        F.avg(F.when(top, r)).alias("top_return"),
        F.avg(F.when(bottom, r)).alias("bottom_return"),
        F.avg(F.when(top, (r > 0).cast("double"))).alias("hit_rate"),
    )


def selection_metrics(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """Quantile returns, spread and hit rate averaged over dates (M7)."""
    daily = selection_by_date(df, by, **options)
    return daily.groupBy(*by).agg(
        F.avg("top_return").alias("top_quantile_return"),
        F.avg("bottom_return").alias("bottom_quantile_return"),
        (F.avg("top_return") - F.avg("bottom_return")).alias("long_short_spread"),
        F.avg("hit_rate").alias("hit_rate_top_quantile"),
    )


def daily_ic(df: DataFrame, by: Sequence[str] = (), score: str = "score", ret: str = "forward_return", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Pearson and Spearman correlation of score and return on each date with three rows or more."""
    rows = average_ranks(_usable(df, score, ret), [*by, "date"], {score: "_rs", ret: "_rr"}, max_group_rows)
    daily = rows.groupBy(*by, "date").agg(F.count(F.lit(1)).alias("n"), pearson(score, ret).alias("ic"), pearson("_rs", "_rr").alias("rank_ic"))
    return daily.filter(F.col("n") >= 3).drop("n")


def information_coefficients(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """Mean daily IC and rank-IC (M8)."""
    return daily_ic(df, by, **options).groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.avg("rank_ic").alias("rank_ic_mean"))


def fraction_by_date(df: DataFrame, by: Sequence[str] = (), score: str = "score", ret: str = "forward_return", y: str = "target", top_frac: float = 0.2, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per-date portfolio of the top fraction: return, precision, sizes (M9 debug table)."""
    if not 0.0 < top_frac < 1.0:
        raise ValueError("top_frac must be in (0, 1)")
    rows = positions(df.dropna(subset=["date", score, ret, y]), [*by, "date"], score, max_group_rows=max_group_rows)
    k = share_down(top_frac)
    top = F.col("pos") <= k
    return rows.groupBy(*by, "date").agg(
        F.max("n").alias("n_assets"),
        F.max(k).alias("k_used"),
        (F.max(k) / F.max("n")).alias("selected_fraction"),
        F.avg(F.when(top, F.col(ret))).alias("portfolio_return"),
        F.avg(F.when(top, F.col(y))).alias("precision"),
        F.sum(F.when(top, (F.col(ret) > 0).cast("long"))).alias("wins"),
    )


def strategy_evaluation(df: DataFrame, by: Sequence[str] = (), top_frac: float = 0.2, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Eleven summary numbers of a ranking strategy (M9).

    Fraction portfolio, quantile returns and both correlations need the same (group, date) rows, so they share one shuffle
    and one aggregate per date; a second, small aggregate averages the dates.
    """
    if not 0.0 < top_frac < 1.0:
        raise ValueError("top_frac must be in (0, 1)")
    score, ret, y, keys = "score", "forward_return", "target", [*by, "date"]
    rows = df.dropna(subset=["date", score, ret, y]).select(*keys, "ticker", score, ret, y)

    rows = positions_and_ranks(rows, keys, [F.col(score).desc(), F.col("ticker").asc()], {score: "_rs", ret: "_rr"}, "pos", "n", max_group_rows)
    r, k, q = F.col(ret), share_down(top_frac), share_up(0.2)
    top = F.col("pos") <= k
    enough = F.count(F.lit(1)) >= 3
    daily = rows.groupBy(*keys).agg(
        F.avg(F.when(top, F.col(y))).alias("precision"),
        F.avg(F.when(top, r)).alias("portfolio"),
        F.sum(F.when(top, (r > 0).cast("long"))).alias("wins"),
        F.max(k).alias("k"),
        (F.max(k) / F.max("n")).alias("fraction"),
        F.avg(F.when(F.col("pos") <= q, r)).alias("top"),
        F.avg(F.when(F.col("pos") > F.col("n") - q, r)).alias("bottom"),
        F.when(enough, pearson(score, ret)).alias("ic"),
        F.when(enough, pearson("_rs", "_rr")).alias("rank_ic"),
    )
    return daily.groupBy(*by).agg(
        F.avg("precision").alias("precision_at_k"),
        F.coalesce(F.stddev_samp("precision"), F.lit(0.0)).alias("precision_at_k_std"),
        F.avg("ic").alias("ic"),
        F.avg("rank_ic").alias("rank_ic"),
        F.avg("top").alias("quantile_top_return"),
        F.avg("bottom").alias("quantile_bottom_return"),
        (F.avg("top") - F.avg("bottom")).alias("long_short_spread"),
        sharpe("portfolio").alias("sharpe"),
        F.avg("portfolio").alias("average_return"),
        (F.sum("wins") / F.sum("k")).alias("hit_rate"),
        F.avg("fraction").alias("avg_selected_fraction"),
    )


def quantile_returns(df: DataFrame, by: Sequence[str] = (), n_quantiles: int = 5, score: str = "score", ret: str = "forward_return", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Mean return of each per-date quantile, 1 the lowest scores; dates with one row skipped."""
    if n_quantiles < 2:
        raise ValueError("n_quantiles must be >= 2")
    rows = with_position(_usable(df, score, ret), [*by, "date"], [F.col(score).asc(), F.col("ticker").asc()], "pos", "n", max_group_rows)
    used = F.least(F.lit(n_quantiles), F.col("n"))
    quantile = F.least(F.greatest(F.ceil(F.col("pos") / F.col("n") * used), F.lit(1)), used).cast("int")
    return rows.filter(F.col("n") >= 2).groupBy(*by, "date", quantile.alias("quantile")).agg(F.avg(ret).alias("mean_return"))


def quantile_curves(daily: DataFrame, n_quantiles: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Quantiles as columns with compounded curves and the long-short curve, one row per date."""
    wide = daily.groupBy(*by, "date").pivot("quantile", list(range(1, n_quantiles + 1))).agg(F.first("mean_return")).fillna(0.0)
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    names = [str(q) for q in range(1, n_quantiles + 1)]
    curves = [F.product(1 + F.col(f"`{q}`")).over(w).alias(f"Q{q}") for q in names]
    spread = F.product(1 + F.col(f"`{names[-1]}`") - F.col("`1`")).over(w).alias("long_short")
    return wide.select(*by, "date", *curves, spread)

"""Backtests as window plans.

Curves are partitioned by run (ticker and model, or model) and ordered by date: one row per date, bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import div
from quantloom.functions.vocabulary import TRADING_DAYS
from quantloom.operators.crosssection import holdings_turnover, selected_flag, top_k
from quantloom.operators.merge import keep_last
from quantloom.operators.metrics import sharpe
from quantloom.operators.ordering import MAX_GROUP_ROWS

RUN = ("ticker", "model_id")


def _axis(by: Sequence[str]):
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("date")


def compounded(r: Column | str, by: Sequence[str]) -> Column:
    """Running product of 1 + r."""
    r = F.col(r) if isinstance(r, str) else r
    return F.product(1 + r).over(_axis(by).rowsBetween(Window.unboundedPreceding, 0))


def drawdown(curve: str, by: Sequence[str], start: float | None = None) -> Column:
    """Curve over its running peak minus one (E23). The peak starts at the first value, or at ``start`` capital if given."""
    peak = F.max(curve).over(_axis(by).rowsBetween(Window.unboundedPreceding, 0))
    return div(F.col(curve), peak if start is None else F.greatest(peak, F.lit(start))) - 1


def position_change(p: str, by: Sequence[str]) -> Column:
    """Absolute change of position, the first row's own size."""
    return F.coalesce(F.abs(F.col(p) - F.lag(p, 1).over(_axis(by))), F.col(p))


def net_of_costs(gross: str, p: str, cost: float, by: Sequence[str]) -> Column:
    """Gross return minus cost per unit of position change, starting flat."""
    if cost < 0:
        raise ValueError("cost must be non-negative")
    return F.col(gross) - F.abs(F.col(p) - F.lag(p, 1, 0.0).over(_axis(by))) * cost


def align_prices_and_signals(prices: DataFrame, signals: DataFrame, price_version: str | None = None, signal_version: str | None = None) -> DataFrame:
    """Inner join on (ticker, date), each side deduplicated keep-last by its version column when it has one."""
    if price_version:
        prices = keep_last(prices, ["ticker", "date"], [price_version])
    if signal_version:
        signals = keep_last(signals, [*RUN, "date"], [signal_version])
    return prices.select("ticker", "date", "close").join(signals.select(*RUN, "date", "signal"), ["ticker", "date"])


def signal_curve(rows: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """Long-only curve: yesterday's position earns today's return (O1). ``rows`` is (ticker, model_id, date, close, signal)."""
    w = _axis(RUN)
    out = rows.withColumn("position", F.when(F.col("signal").isin("Buy", "Strong Buy"), 1).otherwise(0))
    out = out.withColumn("asset_ret", F.coalesce(div("close", F.lag("close", 1).over(w)) - 1, F.lit(0.0)))
    out = out.withColumn("strategy_ret", F.coalesce(F.lag("position", 1).over(w), F.lit(0)) * F.col("asset_ret"))
    out = out.select(
        "*",
        (F.lit(initial) * compounded("strategy_ret", RUN)).alias("equity"),
        (F.lit(initial) * compounded("asset_ret", RUN)).alias("benchmark_equity"),
        position_change("position", RUN).alias("position_change"),
    )
    return out.withColumn("return_pct", F.col("equity") / initial - 1)


def trades(curve: DataFrame) -> DataFrame:
    """Round trips: from the row that enters to the first flat row, or the last row while still open (O2)."""
    w = _axis(RUN)
    before = F.coalesce(F.lag("position", 1).over(w), F.lit(0))
    out = curve.withColumn("_before", before).withColumn("_enter", ((F.col("position") == 1) & (F.col("_before") == 0)).cast("int"))
    out = out.withColumn("trade", F.sum("_enter").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.filter((F.col("position") == 1) | (F.col("_before") == 1))
    deals = out.groupBy(*RUN, "trade").agg(
        F.min("date").alias("entry_date"),
        F.max("date").alias("exit_date"),
        F.min_by("equity", "date").alias("_in"),
        F.max_by("equity", "date").alias("_out"),
        (F.min("position") == 1).alias("still_open"),
    )
    return deals.withColumn("pnl_pct", div("_out", "_in") - 1).drop("_in", "_out")


def signal_metrics(curve: DataFrame, initial: float = 10_000.0, risk_free: float = 0.0) -> DataFrame:
    """Return, Sharpe, drawdown, win rate, trades and turnover of every run (O3).

    A trade is settled on its exit row against the equity carried from its entry row, so trades and curve figures
    come from one aggregate over one partitioning.
    """
    w = _axis(RUN)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    position, before = F.col("position"), F.coalesce(F.lag("position", 1).over(w), F.lit(0))
    rows = curve.withColumns({"_before": before, "_next": F.lead("date", 1).over(w), "_dd": drawdown("equity", RUN)})
    entered = F.when((position == 1) & (F.col("_before") == 0), F.col("equity"))
    rows = rows.withColumn("_entry", F.last(entered, ignorenulls=True).over(so_far))
    left = ((position == 0) & (F.col("_before") == 1)) | ((position == 1) & F.col("_next").isNull())
    rows = rows.withColumn("_pnl", F.when(left, F.coalesce(div("equity", "_entry") - 1, F.lit(0.0))))
    out = rows.groupBy(*RUN).agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        (F.max_by("equity", "date") / initial - 1).alias("cumulative_return"),
        F.count(F.lit(1)).alias("_n"),
        sharpe(F.col("strategy_ret") - risk_free / TRADING_DAYS, ddof=0, on_zero=0.0, eps=1e-12).alias("sharpe_ratio"),
        F.min("_dd").alias("max_drawdown"),
        F.avg("position_change").alias("turnover"),
        F.count("_pnl").alias("total_trades"),
        F.coalesce(F.avg((F.col("_pnl") > 0).cast("double")), F.lit(0.0)).alias("win_rate"),
    )
    annual = F.pow(1 + F.col("cumulative_return"), F.lit(float(TRADING_DAYS)) / F.col("_n")) - 1
    return out.withColumn("annualized_return", annual).drop("_n")


def top_k_daily(panel: DataFrame, k: int = 10, score: str = "score", ret: str = "forward_return", by: Sequence[str] = ()) -> DataFrame:
    """Mean return of the best and worst k names of each date and the compounded curves."""
    rows = panel.dropna(subset=["date", "ticker", score, ret])
    best = top_k(rows, [*by, "date"], k, score).select(*by, "date", F.col(ret).alias("_top"), F.lit(None).cast("double").alias("_bottom"))
    worst = top_k(rows, [*by, "date"], k, score, bottom=True).select(*by, "date", F.lit(None).cast("double").alias("_top"), F.col(ret).alias("_bottom"))
    daily = best.unionByName(worst).groupBy(*by, "date").agg(F.avg("_top").alias("top_ret"), F.avg("_bottom").alias("bottom_ret"))
    daily = daily.withColumn("long_short_ret", F.col("top_ret") - F.col("bottom_ret"))
    return daily.select("*", compounded("long_short_ret", by).alias("curve_long_short"), compounded("top_ret", by).alias("curve_long_only"))


def top_k_summary(panel: DataFrame, k: int = 10, score: str = "score", ret: str = "forward_return") -> DataFrame:
    """Six numbers of the top-k ranking backtest, turnover by names."""
    daily = top_k_daily(panel, k, score, ret).agg(
        F.avg("top_ret").alias("topk_mean_return"),
        F.avg("bottom_ret").alias("bottomk_mean_return"),
        F.avg("long_short_ret").alias("long_short_mean_return"),
        sharpe("long_short_ret", ddof=0, on_zero=0.0, eps=1e-12).alias("long_short_sharpe"),
        sharpe("top_ret", ddof=0, on_zero=0.0, eps=1e-12).alias("long_only_sharpe"),
    )
    held = top_k(panel.dropna(subset=["date", "ticker", score, ret]), ["date"], k, score).select("date", "ticker")
    turns = holdings_turnover(held).agg(F.avg("turnover").alias("turnover"))
    return daily.withColumn("_one", F.lit(1)).join(turns.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


def daily_portfolio(rows: DataFrame, signal: str, by: Sequence[str] = (), ret: str = "ret_1d", cost_bps: float = 2.0) -> DataFrame:
    """Equal-weight daily portfolio of a 0/1 (or sized) signal with costs, curves and drawdown."""
    sized = rows.withColumn("_s", F.coalesce(F.col(signal).cast("double"), F.lit(0.0)))
    daily = sized.groupBy(*by, "date").agg(F.avg(ret).alias("ret"), F.avg(F.col("_s") * F.col(ret)).alias("gross_ret"), F.avg("_s").alias("signal"))
    daily = daily.select("*", position_change("signal", by).alias("pos_change"), net_of_costs("gross_ret", "signal", cost_bps / 10_000, by).alias("net_ret"))
    filled = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    daily = daily.select(
        "*",
        compounded(filled("ret"), by).alias("buy_hold_curve"),
        compounded(filled("gross_ret"), by).alias("gross_curve"),
        compounded(filled("net_ret"), by).alias("net_curve"),
    )
    return daily.withColumn("drawdown", drawdown("net_curve", by))


def threshold_portfolio(rows: DataFrame, probability: str, threshold: float, **options) -> DataFrame:
    """Daily portfolio of the rows at or above a threshold."""
    return daily_portfolio(rows.withColumn("_signal", (F.col(probability) >= threshold).cast("double")), "_signal", **options)


def portfolio_stats(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return daily.groupBy(*by).agg(
        sharpe("ret").alias("sharpe_bh"), sharpe("net_ret").alias("sharpe_strategy_net"), F.min("drawdown").alias("max_dd_net")
    )


def top_k_vs_universe(rows: DataFrame, k: int = 10, by: Sequence[str] = (), ret: str = "ret_1d", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Daily top-k and universe returns with curves; turnover is the change of the selected share.

    ``covers_universe`` marks dates on which k reached the whole cross-section, where top-k and universe are the same.
    """
    marked = selected_flag(rows.dropna(subset=["date", "ticker", ret, "score"]), k, [*by, "date"], max_group_rows)
    daily = marked.groupBy(*by, "date").agg(
        F.avg(ret).alias("ret"),
        F.avg("selected").alias("selected"),
        (F.min("selected") >= 1).alias("covers_universe"),
        F.coalesce(F.avg(F.when(F.col("selected") > 0, F.col(ret))), F.lit(0.0)).alias("topk_ret"),
    )
    return daily.select(
        "*",
        compounded("topk_ret", by).alias("curve_topk"),
        compounded("ret", by).alias("curve_universe"),
        position_change("selected", by).alias("selected_share_turnover"),
    )


def top_k_vs_universe_stats(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return daily.groupBy(*by).agg(
        sharpe("topk_ret").alias("topk_sharpe"),
        sharpe("ret").alias("universe_sharpe"),
        F.avg("selected_share_turnover").alias("topk_turnover"),
        (F.max_by("curve_topk", "date") - 1).alias("topk_cum_return"),
        (F.max_by("curve_universe", "date") - 1).alias("universe_cum_return"),
    )


def last_fraction(rows: DataFrame, train_share: float = 0.8, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Rows after the first ``train_share`` of each key's dates."""
    w = Window.partitionBy(*by)
    out = rows.select("*", F.row_number().over(w.orderBy("date")).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    return out.filter(F.col("_r") - 1 >= F.floor(F.col("_n") * train_share)).drop("_r", "_n")


def ticker_backtest(rows: DataFrame, thresholds: Sequence[float] = (0.55,), cost: float = 0.001, by: Sequence[str] = RUN) -> DataFrame:
    """Per-ticker curve with next-day returns and costs, for every threshold at once.

    The threshold grid is a literal list, exploded after the rows were hashed by ticker, so the grid adds no shuffle.
    """
    w, keys = _axis(by), [*by, "threshold"]
    out = rows.withColumn("_next", F.coalesce(F.lead("returns", 1).over(w), F.lit(0.0)))
    out = out.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    out = out.withColumn("position", (F.col("probability") >= F.col("threshold")).cast("int"))
    out = out.withColumn("trade", position_change("position", keys)).withColumn("gross_return", F.col("_next") * F.col("position"))
    out = out.withColumn("strategy_return", F.col("gross_return") - F.col("trade") * cost)
    out = out.select(
        "*",
        compounded("strategy_return", keys).alias("cumulative_strategy"),
        F.product(1 + F.col("returns")).over(_axis(keys).rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_bnh"),
    )
    return out.drop("_next").filter(F.col("returns").isNotNull())


def ticker_metrics(curve: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Total, annual and buy-and-hold return, Sharpe, drawdown, Calmar, win rate, trades."""
    keys = [*by, "threshold"]
    rows = curve.withColumn("_dd", drawdown("cumulative_strategy", keys))
    held = F.col("position") == 1
    out = rows.groupBy(*keys).agg(
        (F.max_by("cumulative_strategy", "date") - 1).alias("total_return"),
        (F.max_by("cumulative_bnh", "date") - 1).alias("bnh_return"),
        F.count(F.lit(1)).alias("_n"),
        sharpe("strategy_return", on_zero=0.0).alias("sharpe"),
        F.min("_dd").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(held, (F.col("gross_return") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        F.sum("position").alias("n_trades"),
    )
    out = out.withColumn("ann_return", F.pow(1 + F.col("total_return"), F.lit(float(TRADING_DAYS)) / F.col("_n")) - 1)
    return out.withColumn("calmar", F.coalesce(div("ann_return", F.nullif(F.abs("max_drawdown"), F.lit(0.0))), F.lit(0.0))).drop("_n")


def pick_threshold(rows: DataFrame, grid: Sequence[float], by: Sequence[str] = (), probability: str = "score", ret: str = "ret_1d") -> DataFrame:
    """Threshold with the best mean of signal times return, the lowest on ties.

    One conditional sum per grid point in a single aggregate: no row is multiplied by the grid.
    """
    gains = rows.groupBy(*by).agg(*[F.avg(F.when(F.col(probability) >= t, F.col(ret)).otherwise(0.0)).alias(f"g{i}") for i, t in enumerate(grid)])
    points = F.array(*[F.struct(F.col(f"g{i}").alias("gain"), F.lit(-float(t)).alias("minus_t")) for i, t in enumerate(grid)])
    best = F.array_max(points)
    return gains.select(*by, (-best["minus_t"]).alias("threshold"), best["gain"].alias("gain"))


def threshold_gains(rows: DataFrame, grid: Sequence[float], by: Sequence[str] = (), probability: str = "score", ret: str = "ret_1d") -> DataFrame:
    """Mean gain at every grid point."""
    gains = rows.groupBy(*by).agg(*[F.avg(F.when(F.col(probability) >= t, F.col(ret)).otherwise(0.0)).alias(f"g{i}") for i, t in enumerate(grid)])
    points = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"g{i}").alias("gain")) for i, t in enumerate(grid)])
    return gains.select(*by, F.inline(points))


def holding_period(panel: DataFrame, k: int = 5, hold: int = 5, score: str = "score", ret: str = "fwd_return") -> DataFrame:
    """Non-overlapping top-k holding: long, short and market return on every ``hold``-th date with curves."""
    rows = panel.dropna(subset=[ret])
    best = top_k(rows, ["date"], k, score).groupBy("date").agg(F.avg(ret).alias("long_ret"))
    worst = top_k(rows, ["date"], k, score, bottom=True).groupBy("date").agg(F.avg(ret).alias("short_ret"))
    market = rows.groupBy("date").agg(F.avg(ret).alias("market_ret"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).drop("_n")
    daily = market.join(best, "date").join(worst, "date")
    daily = daily.withColumn("_i", F.row_number().over(_axis([]))).filter((F.col("_i") - 1) % hold == 0).drop("_i")
    daily = daily.withColumn("long_short_ret", F.col("long_ret") - F.col("short_ret"))
    return daily.select(
        "*", *[compounded(f"{s}_ret", []).alias(f"cum_{s}") for s in ("long", "long_short", "market")]
    )


def holding_stats(curve: DataFrame, hold: int = 5) -> DataFrame:
    """Sharpe at whole holding periods per year, cumulative return and drawdown of each leg."""
    periods = TRADING_DAYS // hold
    rows = curve.select("*", *[drawdown(f"cum_{s}", []).alias(f"_dd_{s}") for s in ("long", "long_short")])
    return rows.agg(
        *[sharpe(f"{s}_ret", periods=periods, on_zero=0.0).alias(f"sharpe_{s}") for s in ("long", "long_short", "market")],
        *[(F.max_by(f"cum_{s}", "date") - 1).alias(f"return_{s}") for s in ("long", "long_short", "market")],
        *[F.min(f"_dd_{s}").alias(f"max_dd_{s}") for s in ("long", "long_short")],
    )


def compare_models(metrics: DataFrame, tickers: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every requested (ticker, model); a run that could not be made is a row with ok = false."""
    asked = tickers.select("ticker").distinct().withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in models])))
    out = asked.join(metrics.withColumn("_ok", F.lit(True)), list(RUN), "left").withColumn("ok", F.coalesce("_ok", F.lit(False)))
    return out.withColumn("error", F.when(~F.col("ok"), F.lit("no overlapping dates between price and predictions"))).drop("_ok")


def preflight(tickers: DataFrame, bars: DataFrame, combined: DataFrame) -> DataFrame:
    """Whether each ticker has prices and features, with the reason when not."""
    have = lambda df, name: df.select("ticker").distinct().withColumn(name, F.lit(True))
    out = tickers.join(have(bars, "_p"), "ticker", "left").join(have(combined, "_c"), "ticker", "left")
    price, feats = F.coalesce("_p", F.lit(False)), F.coalesce("_c", F.lit(False))
    reason = (
        F.when(~price & ~feats, "missing cached OHLCV and combined features")
        .when(~price, "missing cached OHLCV")
        .when(~feats, "missing combined features")
        .otherwise("")
    )
    return out.select("ticker", (price & feats).alias("ready"), price.alias("has_prices"), feats.alias("has_features"), reason.alias("reason"))


def excess_spread(daily: DataFrame, strategy: str = "net_ret", benchmark: str = "ret") -> DataFrame:
    """Daily strategy return minus benchmark."""
    return daily.withColumn("spread", F.col(strategy) - F.col(benchmark))

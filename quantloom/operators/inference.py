"""Forecast comparison and bootstrap tests on daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import clip, finite, log_loss
from quantloom.functions.tails import normal_sf


def _axis(by: Sequence[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def diebold_mariano(losses: DataFrame, a: str, b: str, h: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Equal-accuracy test of two daily loss series with Bartlett-weighted autocovariances up to lag h.

    Series shorter than five give no row; a non-positive variance gives statistic 0.
    """
    d = losses.select(*by, "date", (finite(a) - finite(b)).alias("d")).filter(F.col("d").isNotNull())
    w = _axis(by)
    d = d.select("*", (F.col("d") - F.avg("d").over(w)).alias("e"), F.count(F.lit(1)).over(w).alias("n"))
    ordered = w.orderBy("date")
    lags = d.select("*", *[F.lag("e", k).over(ordered).alias(f"e{k}") for k in range(1, h + 1)])
    sums = lags.groupBy(*by).agg(
        F.max("n").alias("n"), F.avg("d").alias("mean_d"), F.avg(F.col("e") * F.col("e")).alias("g0"), *[F.avg(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, h + 1)]
    )
    used = F.least(F.lit(h), F.col("n") - 1)
    var = F.col("g0") / F.col("n")
    for k in range(1, h + 1):
        weight = 1 - F.lit(k) / (used + 1)
        var = var + F.when(F.lit(k) <= used, 2 * weight * F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / F.col("n")).otherwise(0.0)
    out = sums.filter(F.col("n") >= 5).withColumn("_v", var)
    positive = F.col("_v") > 0
    return out.select(
        *by,
        "mean_d",
        F.when(positive, F.col("_v")).otherwise(0.0).alias("var_mean_d"),
        F.when(positive, F.col("mean_d") / F.sqrt(F.col("_v"))).otherwise(0.0).alias("dm_stat"),
    )


def with_two_sided_p(tests: DataFrame, stat: str = "dm_stat") -> DataFrame:
    """Normal two-sided p-value of finished statistics (H8); 1 where the variance was degenerate."""
    p = 2 * F.least(normal_sf(F.abs(F.col(stat))), F.lit(0.999999999))
    flat = F.col("var_mean_d") == 0 if "var_mean_d" in tests.columns else F.lit(False)
    return tests.withColumn("p_value_two_sided", F.when(flat, F.lit(1.0)).otherwise(p))


def daily_direction_losses(rows: DataFrame, probability: str, ret: str = "ret_1d", by: Sequence[str] = ()) -> DataFrame:
    """Daily log-loss of the mean forecast for an up day, and of a constant 0.5."""
    daily = rows.groupBy(*by, "date").agg(F.avg(ret).alias("_r"), F.avg(probability).alias("_p"))
    up = (F.coalesce(F.col("_r"), F.lit(0.0)) > 0).cast("double")
    p = clip("_p", 0.01, 0.99)
    return daily.select(*by, "date", log_loss(p, up).alias("loss_model"), log_loss(F.lit(0.5), up).alias("loss_constant"))


def block_start(seed: int, rep: Column, block: Column, n: Column) -> Column:
    """Pseudo-random start in [0, n): modular arithmetic, so any engine gives the same draw."""
    m = 2_147_483_647
    s = (rep * 73_856_093 + block * 19_349_663 + F.lit(seed).cast("long") * 83_492_791) % m
    s = (s * s + s * 48_271 + 12_345) % m
    s = (s * s + s * 16_807 + 1) % m
    return s % n


def block_bootstrap(series: DataFrame, value: str, reps: int = 2000, block: int = 5, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """One-sided p-value that the mean exceeds zero by a circular block bootstrap.

    Every daily series (bounded by the calendar) becomes one array of running sums. The sum of a block is the difference of two
    of its entries, so a replicate is n / block differences and no row is drawn, joined or shuffled by position; replicates are spread over the tasks.
    """
    w = _axis(by)
    x = series.filter(finite(value).isNotNull()).select(*by, "date", F.col(value).cast("double").alias("x"))
    # centred on the mean, so that a difference of running sums does not lose digits
    x = x.withColumn("_gap", F.col("x") - F.avg("x").over(w))
    x = x.withColumn("_sum", F.sum("_gap").over(w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("observed_mean"), F.array_sort(F.collect_list(F.struct("date", "_sum"))).alias("_rows"))
    sums = F.concat(F.array(F.lit(0.0)), F.transform("_rows", lambda r: r["_sum"]))
    stats = x.select(*by, "n", "observed_mean")
    enough = x.filter(F.col("n") >= 3 * block).select(*by, "n", "observed_mean", sums.alias("_sums"))
    draws = enough.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block).cast("long"))

    def gained(total: Column, b: Column) -> Column:
        start = block_start(seed, F.col("rep"), b, F.col("n"))
        stop = start + F.least(F.lit(block).cast("long"), F.col("n") - b * block)  # the last block is cut
        at = lambda i: F.get(F.col("_sums"), i.cast("int"))
        wrapped = F.when(stop > F.col("n"), at(F.col("n")) + at(stop - F.col("n"))).otherwise(at(stop))
        return total + wrapped - at(start)

    means = draws.select(*by, (F.col("observed_mean") + F.aggregate(blocks, F.lit(0.0), gained) / F.col("n")).alias("mean"))
    keys = list(by)
    if not keys:
        keys, means, stats = ["_one"], means.withColumn("_one", F.lit(1)), stats.withColumn("_one", F.lit(1))
    joined = means.join(stats, keys)
    boot = joined.groupBy(*keys).agg(
        F.avg((F.col("mean") >= F.col("observed_mean")).cast("double")).alias("p_value_one_sided"),
        F.avg("mean").alias("bootstrap_mean"),
        F.stddev_samp("mean").alias("bootstrap_std"),
    )
    out = stats.join(boot, keys, "left").withColumn("note", F.when(F.col("n") < 3 * block, "too_few_observations"))
    out = out.withColumn("p_value_one_sided", F.coalesce("p_value_one_sided", F.lit(1.0)))
    return out.select(*by, "observed_mean", "p_value_one_sided", "bootstrap_mean", "bootstrap_std", "note")

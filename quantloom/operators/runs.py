"""Model-run and job-run tables: promotion, champions, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.merge import latest_per_key
from quantloom.operators.summaries import is_dead_letter

# promotion policy (fixed values)
MIN_AUC_GAIN = 0.005
MIN_F1_CHANGE = -0.02
MAX_BRIER_RISE = 0.01

METRICS = ("roc_auc", "f1", "brier")


def champions(promotions: DataFrame) -> DataFrame:
    """Current and previous champion of each model from the promotion log.

    The log is cut to two rows per model in each input partition before the shuffle.
    """
    w = Window.partitionBy("model_id").orderBy(F.col("promoted_at").desc(), F.col("run_id").desc())
    two = promotions.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2)
    return two.groupBy("model_id").agg(
        F.max(F.when(F.col("_n") == 1, F.col("run_id"))).alias("champion_run_id"),
        F.max(F.when(F.col("_n") == 1, F.col("promoted_at"))).alias("promoted_at"),
        F.max(F.when(F.col("_n") == 2, F.col("run_id"))).alias("previous_run_id"),
    )


def promotion_decisions(candidates: DataFrame, runs: DataFrame, current: DataFrame, force: Column | None = None) -> DataFrame:
    """Accept or refuse every candidate run against its model's champion.

    ``candidates`` and ``runs`` carry run_id, model_id and the metrics; ``current`` is ``champions``' result.
    """
    side = runs.select(F.col("run_id").alias("champion_run_id"), F.lit(True).alias("_found"), *[F.col(m).alias(f"champion_{m}") for m in METRICS])
    held = current.select("model_id", "champion_run_id").join(side, "champion_run_id", "left")  # one row per model, before the candidates
    out = candidates.join(held, "model_id", "left")
    c = {m: F.col(m) for m in METRICS}
    p = {m: F.col(f"champion_{m}") for m in METRICS}
    none_of = lambda d: F.coalesce(*d.values()).isNull()
    gain, f1_change, brier_rise = c["roc_auc"] - p["roc_auc"], c["f1"] - p["f1"], c["brier"] - p["brier"]
    reason = (
        F.when(none_of(c), "candidate run has no metrics")
        .when(F.col("champion_run_id").isNull(), "no current champion; accept first completed run")
        .when(F.col("_found").isNull() | none_of(p), "current champion metrics unavailable; accept candidate")
        .when(gain.isNull(), "missing roc_auc metric for policy comparison")
        .when(gain < MIN_AUC_GAIN, "roc_auc improvement below threshold")
        .when(f1_change < MIN_F1_CHANGE, "f1 regression exceeds allowed guardrail")
        .when(brier_rise > MAX_BRIER_RISE, "brier increase exceeds allowed guardrail")
        .otherwise("candidate passes promotion policy")
    )
    out = out.select(
        "run_id",
        "model_id",
        "champion_run_id",
        gain.alias("roc_auc_delta"),
        f1_change.alias("f1_delta"),
        brier_rise.alias("brier_increase"),
        reason.alias("reason"),
        (F.lit(False) if force is None else F.coalesce(force, F.lit(False))).alias("_force"),
    )
    passed = F.col("reason").isin(
        "no current champion; accept first completed run", "current champion metrics unavailable; accept candidate", "candidate passes promotion policy"
    )
    forced = F.col("_force") & ~passed
    return out.withColumn("forced", forced).withColumn("accepted", passed | forced).withColumn("reason", F.when(forced, F.concat(F.lit("forced promotion: "), "reason")).otherwise(F.col("reason"))).drop("_force")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest run of each model."""
    return latest_per_key(runs, ["model_id"], ["created_at", "run_id"])


def nightly_summary(models: DataFrame, runs: DataFrame, current: DataFrame) -> DataFrame:
    """Every model with its newest run and its champion."""
    last = latest_runs(runs).select("model_id", F.col("run_id").alias("latest_run_id"), F.col("status").alias("latest_status"), F.col("created_at").alias("latest_created_at"))
    return models.join(last, "model_id", "left").join(current.select("model_id", "champion_run_id"), "model_id", "left")


def resolve_champions(selectors: DataFrame, current: DataFrame, runs: DataFrame, default: str = "model_d") -> DataFrame:
    """Selectors ``champion`` and ``champion:<model>`` to the run that serves them, or the reason they cannot be (T4)."""
    named = F.split("selector", ":", 2)
    out = selectors.withColumn("model_id", F.when(F.size(named) == 2, F.get(named, F.lit(1))).otherwise(F.lit(default)))
    out = out.join(current.select("model_id", "champion_run_id"), "model_id", "left")
    state = runs.select(F.col("run_id").alias("champion_run_id"), F.col("status").alias("_status"))
    out = out.join(state, "champion_run_id", "left")
    error = F.when(F.col("champion_run_id").isNull(), "no champion for model").when(F.col("_status").isNull(), "champion run not found").when(F.col("_status") != "completed", "champion run not completed")
    return out.select("selector", "model_id", "champion_run_id", error.alias("error"))


def _stale(now: Column, stale_after_sec: int) -> Column:
    return (F.col("status") == "running") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(max(1, stale_after_sec))))


def queue_health(jobs: DataFrame, now: Column, stale_after_sec: int = 300) -> DataFrame:
    """Jobs by state, stale and dead-letter counts in one pass."""
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    return jobs.agg(
        *[n(F.col("status") == s).alias(s) for s in ("queued", "running", "completed", "failed")],
        n(_stale(now, stale_after_sec)).alias("stale_running"),
        n(is_dead_letter()).alias("dead_letter"),
    )


def health_summary(health: DataFrame) -> DataFrame:
    """Depth, failure rate and reasons derived from the counts."""
    ended = F.col("failed") + F.col("completed")
    reasons = F.array_compact(F.array(F.when(F.col("stale_running") > 0, F.lit("stale_running_jobs")), F.when(F.col("dead_letter") > 0, F.lit("dead_letter_jobs"))))
    return health.select(
        (F.col("queued") + F.col("running")).alias("queue_depth"),
        F.round(F.coalesce(F.try_divide(F.col("failed"), ended), F.lit(0.0)), 4).alias("failure_rate"),
        "dead_letter",
        "stale_running",
        reasons.alias("unhealthy_reasons"),
    )


def requeue_decisions(jobs: DataFrame, now: Column, stale_after_sec: int = 300) -> DataFrame:
    """What would happen to each stale running job."""
    spent = F.col("attempt_count") >= F.col("max_attempts")
    fallback = F.when(spent, "failed: max delivery attempts reached").otherwise("requeued after stale running heartbeat")
    return jobs.filter(_stale(now, stale_after_sec)).select(
        "run_id", F.when(spent, "failed").otherwise("queued").alias("new_status"), F.coalesce("error", fallback).alias("new_error"), "attempt_count"
    )


def dead_letters(jobs: DataFrame, limit: int = 100) -> DataFrame:
    """Newest dead-letter jobs."""
    return jobs.filter(is_dead_letter()).orderBy(F.col("updated_at").desc(), F.col("run_id").asc()).limit(max(1, limit))


def readiness(asked: DataFrame, have: dict[str, DataFrame]) -> DataFrame:
    """Whether each (ticker, model) can be scored and what to do if not.

    ``have`` maps raw_ohlcv, raw_fundamentals, processed_technical, processed_fundamental, combined_features to tables of tickers, and
    model_artifact to a table of models.
    """
    out = asked
    for name, table in have.items():
        key = "model_id" if name == "model_artifact" else "ticker"
        out = out.join(table.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    ready = F.col("processed_technical") & F.col("model_artifact") & F.col("combined_features")
    action = (
        F.when(ready, "ready_for_predict")
        .when(~F.col("model_artifact"), "train_or_load_model_artifact")
        .when(~F.col("processed_technical"), "run_ensure_ready_with_etl")
        .when(~F.col("raw_ohlcv"), "run_ensure_ready_refresh_raw")
        .otherwise("inspect_checks_and_run_ensure_ready")
    )
    return out.withColumn("ready", ready).withColumn("recommended_action", action)


def filter_payloads(runs: DataFrame, column: str, filters: dict[str, str], order: Sequence[str], limit: int = 50) -> DataFrame:
    """Runs whose JSON payload matches every filter, newest first."""
    for path, value in filters.items():
        runs = runs.filter(F.get_json_object(column, f"$.{path}") == value)
    return runs.orderBy(*[F.col(c).desc() for c in order]).limit(max(1, limit))

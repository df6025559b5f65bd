"""Aggregations over panels and runs (D*)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.safe import div, pearson
from quantloom.functions.tails import student_t_two_sided


def label_distribution(df: DataFrame, by: Sequence[str] = ("split",), y: str = "target") -> DataFrame:
    """Rows, positives, negatives and positive share."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(y) == 1).cast("long")).alias("n_positive"),
        F.sum((F.col(y) == 0).cast("long")).alias("n_negative"),
        F.avg(F.col(y)).alias("frac_positive"),
    )


def _inline(one_row: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*rows)))


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count and percent of the features that have any, most first (D3)."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    out = _inline(one, [F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing"), div(F.col(c) * 100.0, F.col("_n")).alias("pct")) for c in columns])
    return out.filter(F.col("missing") > 0).orderBy(F.col("missing").desc(), "feature")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation, range, and bias-corrected skew and excess kurtosis, all features in one pass."""
    parts = []
    for c in columns:
        parts += [F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_a"), F.stddev_samp(c).alias(f"{c}_s"), F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi")]
        parts += [F.skewness(c).alias(f"{c}_g1"), F.kurtosis(c).alias(f"{c}_g2")]
    one = df.agg(*parts)
    rows = []
    for c in columns:
        n = F.col(f"{c}_n").cast("double")
        skew = F.when(n > 2, F.col(f"{c}_g1") * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, ((n + 1) * F.col(f"{c}_g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
        named = {"count": F.col(f"{c}_n"), "mean": F.col(f"{c}_a"), "std": F.col(f"{c}_s"), "min": F.col(f"{c}_lo"), "max": F.col(f"{c}_hi"), "skew": skew, "kurtosis": kurt}
        rows.append(F.struct(F.lit(c).alias("feature"), *[v.alias(k) for k, v in named.items()]))
    return _inline(one, rows)


def _merged(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and co-moments of all parts, merged pairwise (Chan, Golub and LeVeque)."""
    n, mean, moment = 0, 0.0, 0.0
    for m, other, more in parts:
        if m:
            step = other - mean
            moment = moment + more + np.outer(step, step) * (n * m / (n + m))
            mean, n = mean + step * (m / (n + m)), n + m
    return n, mean, moment


def gram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row over the rows that have all ``columns``: (n, means, moments), the co-moments about the means as a p x p matrix by rows.

    Every task folds its batches into one matrix; the matrices of 64 groups of tasks are merged, then those. Nothing grows with p squared but the matrix itself.
    """
    columns, groups = list(columns), 64
    p, schema = len(columns), "bucket int, n long, means array<double>, moments array<double>"
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()

    def row(bucket: int, n: int, mean, moment) -> pa.RecordBatch:
        if not n:
            mean, moment = np.zeros(p), np.zeros((p, p))
        return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "n": [n], "means": [mean.tolist()], "moments": [moment.ravel().tolist()]})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                mean = x.mean(axis=0) if len(x) else np.zeros(p)
                yield len(x), mean, (x - mean).T @ (x - mean)

        yield row(TaskContext.get().partitionId() % groups, *_merged(parts()))

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        found = _merged((n, np.array(m), np.array(c).reshape(p, p)) for n, m, c in zip(rows["n"], rows["means"], rows["moments"], strict=True))
        return pa.Table.from_batches([row(0, *found)])

    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    none = df.sparkSession.range(1).select(F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("n"), zeros(p).alias("means"), zeros(p * p).alias("moments"))
    some = numbers.mapInArrow(fold, schema).groupBy("bucket").applyInArrow(merge, schema).unionByName(none)  # an empty frame has a row as well
    return some.groupBy("bucket").applyInArrow(merge, schema).drop("bucket")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of the correlation matrix over complete rows, one pass over packed co-moments (D5); NULL beside a constant column."""
    columns = list(columns)
    p, one = len(columns), gram(df, columns)
    names = F.array(*[F.lit(c) for c in columns])
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = one.select("*", F.explode(pairs).alias("_at")) if p > 1 else one.select("*", F.lit(None).cast("struct<i:int,j:int>").alias("_at")).limit(0)
    at = lambda i, j: F.get("moments", F.col(f"_at.{i}") * p + F.col(f"_at.{j}"))
    # a constant column can leave rounding dust in its variance, so compare with its own scale
    flat = lambda i: F.sqrt(at(i, i) / F.col("n")) <= F.lit(1e-14) * F.abs(F.get("means", F.col(f"_at.{i}")))
    r = F.when((F.col("n") > 0) & ~flat("i") & ~flat("j"), div(at("i", "j"), F.sqrt(at("i", "i")) * F.sqrt(at("j", "j"))))
    return rows.select(F.get(names, F.col("_at.i")).alias("feature_a"), F.get(names, F.col("_at.j")).alias("feature_b"), r.alias("r"))


def strong_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Pairs correlated beyond the threshold, strongest first."""
    return correlations(df, columns).filter(F.abs("r") > threshold).orderBy(F.abs("r").desc())


def point_biserial(df: DataFrame, columns: Sequence[str], y: str = "target") -> DataFrame:
    """Correlation of each feature with a 0/1 target, with n and its t statistic, over complete rows."""
    one = df.dropna(subset=[*columns, y]).agg(F.count(F.lit(1)).alias("n"), *[pearson(c, y).alias(c) for c in columns])
    t = lambda c: div(F.col(c) * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col(c) * F.col(c)))
    return _inline(one, [F.struct(F.lit(c).alias("feature"), F.col(c).alias("r"), F.col("n").alias("n"), t(c).alias("t")) for c in columns])


def with_significance(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Two-sided p-value of finished correlations and its flag."""
    out = tests.withColumn("p", student_t_two_sided(F.col("t"), (F.col("n") - 2).cast("double")))
    return out.withColumn("significant", F.col("p") < level)


def bar_summary(bars: DataFrame) -> DataFrame:
    """Rows, first and last date, missing percent and last close of every ticker."""
    fields = ["open", "high", "low", "close", "volume"]
    gaps = sum((F.col(c).isNull().cast("long") for c in fields), F.lit(0).cast("long"))
    return bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.round(F.sum(gaps) * 100.0 / (F.count(F.lit(1)) * len(fields)), 2).alias("missing_pct"),
        F.round(F.max_by("close", "date"), 2).alias("last_close"),
    )


def cv_summary(folds: DataFrame, metric: str = "rank_ic", scheme: str = "split_name") -> DataFrame:
    """Mean and sample deviation of a fold metric per scheme, long format."""
    wide = folds.groupBy(scheme).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    return wide.select(scheme, F.inline(F.array(*[F.struct(F.lit(f"{metric}_{m}").alias("metric"), F.col(m).alias("value")) for m in ("mean", "std")])))


def run_metrics(lineage: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Totals, successes, failures, success rate and duration of refresh runs."""
    done = F.sum((F.col("status") == "completed").cast("long"))
    total = F.count(F.lit(1))
    parts = [total.alias("total"), done.alias("success"), (total - done).alias("failed"), F.round(done / total, 4).alias("success_rate")]
    if {"started_at", "finished_at"} <= set(lineage.columns):
        parts.append((F.unix_timestamp(F.max("finished_at")) - F.unix_timestamp(F.min("started_at"))).alias("duration_sec"))
    return lineage.groupBy(*by).agg(*parts)


def positive_weight(df: DataFrame, y: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Negatives per positive, 1.0 when a class is absent."""
    pos, neg = F.sum((F.col(y) == 1).cast("long")), F.sum((F.col(y) == 0).cast("long"))
    return df.groupBy(*by).agg(F.when((pos < 1) | (neg < 1), 1.0).otherwise(neg / pos).alias("positive_weight"))


def dashboard(metrics: DataFrame, baseline: str, best: str, best_sharpe: float | None) -> DataFrame:
    """Models beside a baseline's rank-IC; the best model carries the strategy's Sharpe.

    The baseline is read from the same rows (one per model), so it never differs from itself in the last bit.
    """
    floor = F.max(F.when(F.col("model") == baseline, F.col("rank_ic_mean"))).over(Window.partitionBy(F.lit(0)))
    beats = F.coalesce(F.col("rank_ic_mean") > floor, F.lit(False)).cast("int")
    sharpe = F.when(F.col("model") == best, F.lit(best_sharpe)).cast("double")
    return metrics.select(
        *metrics.columns, beats.alias("beats_baseline_rank_ic"), (beats * 100.0).alias("beat_baseline_pct"), sharpe.alias("sharpe_ratio")
    )


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def service_levels(lineage: DataFrame, bars: DataFrame, jobs: DataFrame) -> DataFrame:
    """Batch success share, share of tickers at the last market day, dead-letter share (D20); each table is read once, no action before the result."""
    success = lineage.agg(F.avg((F.col("status") == "completed").cast("double")).alias("value")).withColumn("indicator", F.lit("batch_success"))
    last = bars.groupBy("ticker").agg(F.max("date").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))  # tickers by last day
    fresh = last.agg((F.max_by("n", "d") / F.sum("n")).alias("value")).withColumn("indicator", F.lit("bar_freshness"))
    dead = jobs.agg(F.avg(F.coalesce(is_dead_letter(), F.lit(False)).cast("double")).alias("value")).withColumn("indicator", F.lit("dead_letter"))
    return success.unionByName(fresh).unionByName(dead).select("indicator", "value")


def is_dead_letter() -> Column:
    return (F.col("status") == "failed") & F.col("error").like("failed: max delivery attempts%")


def panel_statistics(df: DataFrame, y: str = "target") -> DataFrame:
    """Rows, distinct dates, date range and positive rate."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg(y).alias("positive_rate")
    )


def model_breadth(results: DataFrame) -> DataFrame:
    """Answers, successes and their share for each model."""
    ok = F.sum(F.col("ok").cast("long"))
    return results.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), ok.alias("n_ok"), (ok / F.count(F.lit(1))).alias("share_ok"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows, sorted columns and date range hashed to 16 hex characters.

    The text hashed is JSON with sorted keys, so a dataset keeps its fingerprint across tools.
    """
    names = ", ".join(f'"{c}"' for c in sorted(df.columns))
    aggregates = [F.count(F.lit(1)).alias("rows")]
    if "date" in df.columns:
        stamp = lambda f: F.date_format(f("date"), "yyyy-MM-dd HH:mm:ss")
        aggregates += [stamp(F.max).alias("hi"), stamp(F.min).alias("lo")]
    one = df.agg(*aggregates)
    text = F.concat(F.lit(f'{{"columns": [{names}], '), F.lit(""))
    if "date" in df.columns:
        dates = F.concat(F.lit('"max_date": "'), F.col("hi"), F.lit('", "min_date": "'), F.col("lo"), F.lit('", '))
        text = F.concat(text, F.coalesce(dates, F.lit("")))
    text = F.concat(text, F.lit('"rows": '), F.col("rows").cast("string"), F.lit("}"))
    return one.select(F.col("rows"), F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def best_by(df: DataFrame, metric: str, name: str) -> DataFrame:
    """Name with the highest metric and that metric; equal metrics go to the first name."""
    return df.agg(F.min_by(name, F.struct(-F.col(metric), F.col(name))).alias("best"), F.max(metric).alias("best_value"))


def feature_split(importances: DataFrame) -> DataFrame:
    """Importance carried by cross-sectional ranks and by base features (Q9)."""
    kind = F.when(F.col("feature").endswith("_rank"), "cross_sectional").otherwise("base")
    return importances.groupBy(kind.alias("kind")).agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("n_features"))


def group_lookup(groups: Mapping[str, Sequence[str]]) -> Column:
    """Feature name to its group as a literal map."""
    pairs = [F.lit(x) for group, features in groups.items() for f in features for x in (f, group)]
    return F.create_map(*pairs)

"""Attribution tables in long format (Q1-Q7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.summaries import group_lookup

KEYS = ("ticker", "date")


def linear_attributions(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float], scales: Mapping[str, float] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact attributions of a linear model: coefficient times distance to the background mean (Q1)."""
    parts = [
        F.struct(F.lit(f).alias("feature"), (F.lit(c) * (F.col(f) - means[f]) / (scales[f] if scales else 1.0)).alias("value")) for f, c in coefficients.items()
    ]
    return df.select(*keys, F.inline(F.array(*parts)))


def group_contributions(attributions: DataFrame, groups: Mapping[str, Sequence[str]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum of absolute attributions per feature group (Q4)."""
    out = attributions.withColumn("group", F.try_element_at(group_lookup(groups), F.col("feature"))).filter(F.col("group").isNotNull())
    return out.groupBy(*keys, "group").agg(F.round(F.sum(F.abs("value")), 6).alias("contribution"))


def group_shares(attributions: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Share of the mean absolute attribution each group holds; rank features form their own group (Q4)."""
    group = F.when(F.col("feature").endswith("_rank"), "Cross-sect. ranks").otherwise(F.try_element_at(group_lookup(groups), F.col("feature")))
    means = global_importance(attributions).withColumn("group", group)
    total = F.sum("mean_abs").over(Window.partitionBy(F.lit(0)))  # one row per feature
    shares = means.withColumn("_total", total).filter(F.col("group").isNotNull())
    return shares.groupBy("group").agg(F.coalesce(F.try_divide(F.sum("mean_abs"), F.max("_total")), F.lit(0.0)).alias("share"))


def top_features(attributions: DataFrame, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest absolute attributions of every row (F7, Q5); a row's features are few and bounded."""
    w = Window.partitionBy(*keys).orderBy(F.abs("value").desc(), "feature")
    return attributions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("value", F.round("value", 6))


def deterministic_sample(df: DataFrame, keys: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """``rows`` rows picked by the hash of their key; the same rows on every run (Q6)."""
    order = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.orderBy(order).limit(rows)


def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution of each feature (Q6)."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))


def base_value(background: DataFrame, prediction: Column | str) -> DataFrame:
    """Mean prediction of the background rows (Q7)."""
    return background.agg(F.avg(prediction).alias("base_value"))

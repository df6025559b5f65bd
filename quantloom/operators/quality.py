"""Checks that return rows instead of raising, so one bad ticker never stops the universe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED_BARS = ("date", "open", "high", "low", "close", "volume")


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_BARS) -> list[str]:
    return [c for c in required if c not in df.columns]


def violations(df: DataFrame, required: Sequence[str] = REQUIRED_BARS) -> DataFrame:
    """(column, rule, n_bad) for absent columns, nulls in required columns, unparsable dates and emptiness."""
    absent = missing_columns(df, required)
    present = [c for c in required if c in df.columns]
    checks = [F.struct(F.lit(c).alias("column"), F.lit("missing_column").alias("rule"), F.lit(1).cast("long").alias("n_bad")) for c in absent]
    sums = [F.sum(F.col(c).isNull().cast("long")).alias(f"_null_{c}") for c in present]
    if "date" in present:
        sums.append(F.sum((F.col("date").isNotNull() & F.col("date").try_cast("date").isNull()).cast("long")).alias("_date"))
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *sums)
    for c in present:
        checks.append(F.struct(F.lit(c).alias("column"), F.lit("null_value").alias("rule"), F.col(f"_null_{c}").alias("n_bad")))
    if "date" in present:
        checks.append(F.struct(F.lit("date").alias("column"), F.lit("bad_date").alias("rule"), F.col("_date").alias("n_bad")))
    checks.append(F.struct(F.lit("*").alias("column"), F.lit("empty").alias("rule"), (F.col("_rows") == 0).cast("long").alias("n_bad")))
    return one.select(F.inline(F.array(*checks))).filter(F.col("n_bad") > 0)


def refresh_lineage(universe: DataFrame, raw: DataFrame, run_id: str) -> DataFrame:
    """One lineage row per ticker of the universe: completed, or failed with the reason."""
    bad = F.col("close").isNull() | F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull()
    state = raw.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("long")).alias("bad"), F.max("date").alias("last_date"))
    out = universe.select("ticker").distinct().join(state, "ticker", "left")
    error = F.when(F.col("rows").isNull(), "no bars").when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" rows without prices")))
    return out.select(
        F.lit(run_id).alias("run_id"),
        "ticker",
        F.when(error.isNull(), "completed").otherwise("failed").alias("status"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        "last_date",
        error.alias("error"),
    )


def refresh_universe(universe: DataFrame, raw: DataFrame, run_id: str, store, build) -> DataFrame:
    """Build and store features of the tickers that pass, all in one job, and return the lineage."""
    lineage = refresh_lineage(universe, raw, run_id)
    good = lineage.filter(F.col("status") == "completed").select("ticker")
    store.save("technical", build(raw.join(good, "ticker", "left_semi")))
    return lineage

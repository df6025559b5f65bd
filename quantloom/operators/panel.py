"""Panel joins on (ticker, date), which is unique on each slice, so no side is multiplied or skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.vocabulary import FUNDAMENTAL, SENTIMENT
from quantloom.operators.projections import ordered_columns, with_absent

KEYS = ["ticker", "date"]


def combined(technical: DataFrame, fundamental: DataFrame | None = None, sentiment: DataFrame | None = None) -> DataFrame:
    """Technical rows with fundamentals and sentiment of the same day; an absent slice gives null columns."""
    out = technical
    for other, names in ((fundamental, FUNDAMENTAL), (sentiment, SENTIMENT)):
        out = with_absent(out, names) if other is None else out.join(other.select(*KEYS, *names), KEYS, "left")
    return ordered_columns(out)


def reattach(df: DataFrame, raw: DataFrame, columns: Sequence[str] = ("volume", "close")) -> DataFrame:
    """Raw columns by key where the panel lacks them; its own are kept."""
    wanted = [c for c in columns if c not in df.columns]
    return df.join(raw.select(*KEYS, *wanted), KEYS, "left") if wanted else df


def attach(df: DataFrame, extra: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join of score columns."""
    return df.join(extra.select(*KEYS, *columns), KEYS, "left")


def fill_scores(df: DataFrame, scores: DataFrame, column: str, new: str = "score") -> DataFrame:
    """Write out-of-fold scores into panel rows, keeping what rows already had elsewhere."""
    found = df.join(scores.select(*KEYS, F.col(new).alias("_new")), KEYS, "left")
    old = F.col(column) if column in df.columns else F.lit(None).cast("double")
    return found.withColumn(column, F.coalesce("_new", old)).drop("_new")

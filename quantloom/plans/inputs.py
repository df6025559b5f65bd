"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.models.training import stored
from quantloom.operators.projections import signal
from quantloom.operators.technical import base_indicators, by_date
from quantloom.sources import tables

# words that occur in the generated prose, standing in for a finance lexicon
FIXTURE_POSITIVE = ["with", "that", "is", "ci", "la"]
FIXTURE_NEGATIVE = ["from", "was", "of", "le", "der"]


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_indicators(tables.bars(spark, sf_dir))


_panels: dict[tuple[str, str], DataFrame] = {}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close, score, ret_1d, forward_return, target), written once per session and scale.

    Evaluation looks at its panel several times (large groups, splitters, blocks), so it runs on a stored one, as in ``workflows``.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _panels:
        _panels[key] = stored(_scored(spark, sf_dir), "scored-panel")
    return _panels[key]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = F.lead("returns", 1).over(by_date())
    return (
        indicators(spark, sf_dir)
        .select(
            "ticker",
            "date",
            "close",
            F.round(F.col("rsi") / 100, 6).alias("score"),
            F.col("returns").alias("ret_1d"),
            ahead.alias("forward_return"),
            (ahead > 0).cast("int").alias("target"),
        )
        .filter(F.col("score").isNotNull() & F.col("forward_return").isNotNull())
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two model columns per bar: RSI as probability and its mirror image."""
    p = F.round(F.col("rsi") / 100, 6)
    both = F.explode(
        F.array(
            F.struct(F.lit("momentum").alias("model_id"), p.alias("probability")),
            F.struct(F.lit("reversal").alias("model_id"), F.round(1 - p, 6).alias("probability")),
        )
    )
    return (
        indicators(spark, sf_dir)
        .filter(F.col("rsi").isNotNull())
        .select("ticker", "date", "close", "returns", both.alias("_m"))
        .select("ticker", "date", "close", "returns", "_m.model_id", "_m.probability")
        .withColumn("signal", signal(F.col("probability")))
    )

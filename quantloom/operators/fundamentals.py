"""Fundamental snapshots to ratios and daily features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.safe import col, to_number
from quantloom.functions.vocabulary import FUNDAMENTAL, FUNDAMENTAL_FIELDS, RATIO_KEYS
from quantloom.operators.asof import asof_backward


def parse_number(c: Column | str) -> Column:
    """Vendor number text: blanks and placeholders are NULL; percent, dollar and comma are dropped."""
    text = F.trim(col(c))
    return F.when(~text.isin("", "None", "-", "N/A"), to_number(F.regexp_replace(text, "[%$,]", "")))


def first_key(df: DataFrame, keys: Sequence[str], as_map: str | None = None) -> Column:
    """First non-blank value among alias keys, from columns or from a map column."""
    if as_map:
        found = [F.nullif(F.try_element_at(F.col(as_map), F.lit(k)), F.lit("")) for k in keys]
    else:
        found = [F.nullif(F.col(k), F.lit("")) for k in keys if k in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def ratios(snapshot: DataFrame, as_map: str | None = None) -> DataFrame:
    """The five ratios of each ticker's snapshot."""
    return snapshot.select("ticker", *[parse_number(first_key(snapshot, keys, as_map)).alias(name) for name, keys in RATIO_KEYS.items()])


def daily_static(dates: DataFrame, snapshot_ratios: DataFrame) -> DataFrame:
    """Snapshot spread over all trading dates of its ticker (J2, C6); point-in-time only from the snapshot on."""
    return dates.select("ticker", "date").join(snapshot_ratios, "ticker", "left")


def daily_point_in_time(dates: DataFrame, history: DataFrame) -> DataFrame:
    """Ratios known on each date: as-of on the fetch date (J2, leakage-free option)."""
    known = history.withColumn("date", F.to_date("fetched_at"))
    return asof_backward(dates.select("ticker", "date"), known, ["ticker"], "date", FUNDAMENTAL)


def vendor_record(raw: DataFrame) -> DataFrame:
    """Vendor field names to table columns, with the fetch time."""
    present = [F.col(k).alias(v) if k in raw.columns else F.lit(None).cast("string").alias(v) for k, v in FUNDAMENTAL_FIELDS.items()]
    stamp = F.col("fetched_at") if "fetched_at" in raw.columns else F.current_timestamp().alias("fetched_at")
    return raw.select("ticker", stamp, *present)


def missing_keys(snapshot: DataFrame, required: Sequence[str] = ("Symbol",)) -> DataFrame:
    """One row per (ticker, key) whose mandatory value is blank."""
    checks = [F.when(F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "", F.lit(k)) for k in required]
    return snapshot.select("ticker", F.explode(F.array_compact(F.array(*checks))).alias("missing_key"))

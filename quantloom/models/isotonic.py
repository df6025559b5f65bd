"""Isotonic calibration pooled on the cluster.

Pooling adjacent violators can be merged: the blocks of neighbouring score ranges, pooled again, are the blocks of the whole. So equal scores are summed first
(map-side combined), every range of scores is pooled in its own task, and the blocks of eight neighbouring ranges at a time are pooled until one group is left.
With labels 0 and 1 and n rows that group holds at most about 2 * n ** (2/3) blocks, since the means of the blocks are different fractions that grow; the driver holds none of them.

The fitted curve is that of ``pyspark.ml``'s estimator: constant inside a block, linear between the end of one block and the start of the next, constant outside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.session import scratch_path

FAN = 8  # neighbouring ranges pooled together in one step
STEP = 64  # blocks of one packed row at least, and the width of the searches for it
_BLOCKS = "part int, lo double, hi double, w double, s double"


def pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks with growing means from blocks in score order (ends, weight, weighted sum of labels)."""
    for _ in range(16):  # whole falling runs at once; what is left goes through the stack below
        mean = s / w
        starts = np.flatnonzero(np.r_[True, mean[1:] > mean[:-1]]) if len(w) else np.empty(0, int)
        if len(starts) == len(w):
            return lo, hi, w, s
        ends = np.r_[starts[1:], len(w)] - 1
        lo, hi, w, s = lo[starts], hi[ends], np.add.reduceat(w, starts), np.add.reduceat(s, starts)
    stack: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), w.tolist(), s.tolist(), strict=True):
        a = list(block)
        while stack and stack[-1][3] / stack[-1][2] >= a[3] / a[2]:
            b = stack.pop()
            a = [b[0], a[1], a[2] + b[2], a[3] + b[3]]
        stack.append(a)
    out = np.array(stack)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def _pooled(frame: pd.DataFrame, part: int) -> pd.DataFrame:
    frame = frame.sort_values("lo")
    lo, hi, w, s = pool(*(frame[c].to_numpy() for c in ("lo", "hi", "w", "s")))
    return pd.DataFrame({"part": np.full(len(lo), part, np.int32), "lo": lo, "hi": hi, "w": w, "s": s})


def _pool_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One score range: each batch is pooled into what the earlier ones left."""
    held = None
    for batch in batches:
        if len(batch):
            held = _pooled(batch if held is None else pd.concat([held, batch]), int(batch["part"].iloc[0]))
    if held is not None:
        yield held


def _pool_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    return _pooled(frame, int(key[0]))


def blocks(df: DataFrame, score: str, label: str, weight: Column | None = None) -> DataFrame:
    """(lo, hi, value) of the isotonic fit of ``label`` on ``score``; rows without score, label or a positive weight take no part. Lazy.

    An empty input has no blocks.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(F.col(score).cast("double").alias("lo"), F.col(label).cast("double").alias("_y"), w.alias("w"))
    rows = rows.filter(F.col("lo").isNotNull() & ~F.isnan("lo") & F.col("_y").isNotNull() & (F.col("w") > 0))
    ties = rows.groupBy((F.col("lo") + F.lit(0.0)).alias("lo")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("_y")).alias("s"))
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = ties.repartitionByRange(ranges, "lo").sortWithinPartitions("lo").select(F.spark_partition_id().alias("part"), "lo", F.col("lo").alias("hi"), "w", "s")
    out = placed.mapInPandas(_pool_range, _BLOCKS)
    while ranges > 1:
        out = out.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("_g")).applyInPandas(_pool_group, _BLOCKS)
        ranges = -(-ranges // FAN)
    return out.select("lo", "hi", (F.col("s") / F.col("w")).alias("value"))


def _packed(table: DataFrame) -> DataFrame:
    """Blocks in rows of ``STEP`` or more neighbours (at most STEP * STEP rows), each with the start of its successor."""
    w = Window.partitionBy(F.lit(0)).orderBy("lo")  # the blocks of one curve, which one task has held before
    size = F.greatest(F.lit(STEP), F.ceil(F.col("_n") / F.lit(STEP * STEP))).cast("long")
    rows = table.select(
        "lo", "hi", "value", F.lead("lo").over(w).alias("next_lo"), F.lead("value").over(w).alias("next_value"),
        F.row_number().over(w).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("_n"),
    )
    rows = rows.withColumn("_row", F.floor((F.col("_i") - 1) / size).cast("int"))
    return rows.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "value", "next_lo", "next_value"))).alias("_curve"))


@dataclass
class IsotonicCurve:
    """A fitted curve, kept as a table under the shared folder."""

    table: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, score: str = "probability", label: str = "target", weight: Column | None = None) -> IsotonicCurve:
        path = scratch_path(df.sparkSession, "isotonic")
        blocks(df, score, label, weight).write.parquet(path)
        return cls(df.sparkSession.read.parquet(path))

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> IsotonicCurve:
        return cls(spark.read.parquet(path))

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    def transform(self, df: DataFrame, score: str = "probability", name: str = "_calibrated") -> DataFrame:
        """Add the curve's value at ``score``; NULL where the score is NULL or NaN, or the curve has no blocks.

        A row finds its packed row of blocks in two steps over their starts (one row of at most STEP * STEP numbers) and meets it by an equi-join; Spark
        broadcasts the packed rows after measuring them and splits skewed ranges otherwise.
        """
        packed = _packed(self.table)
        starts = packed.agg(F.sort_array(F.collect_list(F.col("_curve")[0]["lo"])).alias("s")).select(F.struct("s", F.expr(f"filter(s, (e, i) -> i % {STEP} = 0)").alias("steps")).alias("x")).scalar()
        p = F.col(score).cast("double") + F.lit(0.0)  # -0.0 is 0.0
        # how many of sorted, distinct numbers are not above the score
        upto = lambda values: (F.array_position(F.sort_array(F.array_append(values, p)), p) - 1).cast("int") + F.array_contains(values, p).cast("int")
        usable = p.isNotNull() & ~F.isnan(p)
        found = df.withColumn("_step", F.when(usable, F.greatest(upto(starts.getField("steps")), F.lit(1)) - 1))
        found = found.withColumn("_at", F.greatest(F.col("_step") * STEP + upto(F.slice(starts.getField("s"), F.col("_step") * STEP + 1, STEP)) - 1, F.lit(0)))
        both = found.join(packed, F.col("_at") == F.col("_row"), "left")
        b = F.element_at("_curve", F.greatest(F.size(F.filter("_curve", lambda e: e["lo"] <= p)), F.lit(1)))
        between = b["value"] + (b["next_value"] - b["value"]) * (p - b["hi"]) / (b["next_lo"] - b["hi"])
        value = F.when((p <= b["hi"]) | b["next_lo"].isNull(), b["value"]).otherwise(between)
        return both.select(*df.columns, F.when(usable, value).alias(name))

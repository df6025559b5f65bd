"""Leakage-free splits on the axis of distinct trading dates.

Split tables have columns (fold, date, role). They hold dates times folds, never panel rows, and their sizes follow
the calendar; panels meet them through an equi-join on date.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.ordering import MAX_GROUP_ROWS, with_position


def date_axis(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct dates with 0-based index ``i`` and their number ``n``."""
    dates = df.select(*by, F.to_date("date").alias("date")).filter(F.col("date").isNotNull()).distinct()
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return dates.select("*", (F.row_number().over(w.orderBy("date")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))


def _int(c: Column) -> Column:
    return F.floor(c).cast("long")


def chronological(df: DataFrame, train: float = 0.70, val_end: float = 0.85, clamp: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """date -> train / validation / test by share of distinct dates (L1; ``clamp=False`` is L3).

    ``by`` splits every ticker on its own dates. ``require_size`` checks that there is enough to split.
    """
    if not 0.0 < train < val_end < 1.0:
        raise ValueError("need 0 < train < val_end < 1")
    axis, n = date_axis(df, by), F.col("n")
    i_val, i_test = _int(F.lit(train) * n), _int(F.lit(val_end) * n)
    if clamp:
        i_val = F.greatest(F.lit(5), F.least(i_val, n - 10))
        i_test = F.greatest(i_val + 3, F.least(i_test, n - 3))
    role = F.when(F.col("i") < i_val, "train").when(F.col("i") < i_test, "validation").otherwise("test")
    return axis.select(*by, "date", role.alias("role"))


def require_size(df: DataFrame, min_rows: int = 60, min_dates: int = 20) -> None:
    """Refuse panels too small for a chronological split."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("dates")).first()
    if row["rows"] < min_rows:
        raise ValueError(f"need at least {min_rows} rows with valid features and next-day return")
    if row["dates"] < min_dates:
        raise ValueError("not enough unique dates for train/validation/test split")


def order_violations(split: DataFrame) -> DataFrame:
    """Pairs of roles whose date ranges touch; empty when train < validation < test holds."""
    b = split.agg(
        *[f(F.when(F.col("role") == role, F.col("date"))).alias(f"{role}_{n}") for role in ("train", "validation", "test") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    )
    pairs = [("train", "validation"), ("validation", "test"), ("train", "test")]
    bad = [F.when(F.col(f"{x}_hi") >= F.col(f"{y}_lo"), F.lit(f"{x} overlaps {y}")) for x, y in pairs]
    return b.select(F.explode(F.array_compact(F.array(*bad))).alias("violation"))


def row_fraction(df: DataFrame, order: Sequence[str], train: float = 0.70, val_end: float = 0.85, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Role per row when there is no date column, by position under ``order`` (L2)."""
    out = with_position(df, [], [F.col(c) for c in order], "_p", "_n", max_group_rows)
    n = F.col("_n")
    i_val = F.greatest(F.lit(10), F.least(_int(F.lit(train) * n), n - 20))
    i_test = F.greatest(i_val + 5, F.least(_int(F.lit(val_end) * n), n - 5))
    place = F.col("_p") - 1
    return out.withColumn("role", F.when(place < i_val, "train").when(place < i_test, "validation").otherwise("test")).drop("_p", "_n")


def two_way(df: DataFrame, train: float = 0.80, margin: int = 5) -> DataFrame:
    """80/20 by dates, the cut kept ``margin`` dates away from both ends (L4)."""
    cut = F.greatest(F.lit(margin), F.least(_int(F.lit(train) * F.col("n")), F.col("n") - margin))
    return date_axis(df).select("date", F.when(F.col("i") < cut, "train").otherwise("test").alias("role"))


def _folds(axis: DataFrame, folds: Sequence[int], train_end: Column, test_start: Column, test_end: Column, min_train: int = 20, min_test: int = 3) -> DataFrame:
    i, n = F.col("i"), F.col("n")
    out = axis.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in folds])))
    size_train = F.greatest(F.least(train_end, n), F.lit(0))
    size_test = F.least(test_end, n) - F.least(test_start, n)
    out = out.filter((size_train >= min_train) & (size_test >= min_test))
    role = F.when(i < train_end, "train").when((i >= test_start) & (i < test_end), "test")
    return out.select("fold", "date", role.alias("role")).filter(F.col("role").isNotNull())


def walk_forward(df: DataFrame, n_splits: int = 4) -> DataFrame:
    """Expanding windows over n_splits + 1 equal stretches."""
    if n_splits < 1:
        raise ValueError("n_splits must be >= 1")
    edge = lambda k: _int(k / F.lit(float(n_splits + 1)) * F.col("n"))
    k = F.col("fold")
    return _folds(date_axis(df), range(1, n_splits + 1), edge(k), edge(k), edge(k + 1))


def purged_kfold(df: DataFrame, n_splits: int = 5, embargo: int = 5, horizon: int = 0) -> DataFrame:
    """Consecutive test blocks, training strictly before minus embargo and label horizon."""
    if n_splits < 2:
        raise ValueError("n_splits must be >= 2")
    size = F.greatest(F.lit(1), _int(F.col("n") / F.lit(n_splits)))
    start = F.col("fold") * size
    end = F.when(F.col("fold") == n_splits - 1, F.col("n")).otherwise(start + size)
    return _folds(date_axis(df), range(n_splits), start - horizon - embargo, start, end)


def time_series_split(df: DataFrame, n_splits: int = 5, gap: int = 0) -> DataFrame:
    """Equal test blocks at the end of the axis with everything earlier as training."""
    size = _int(F.col("n") / F.lit(n_splits + 1))
    start = F.col("n") - (n_splits - F.col("fold")) * size
    return _folds(date_axis(df), range(n_splits), start - gap, start, start + size, min_train=1, min_test=1)


def block_ranges(axis: DataFrame, groups: int) -> DataFrame:
    """Date axis with the block each date falls in; edges are a truncated even spacing."""
    edges = [_int(F.lit(float(g)) * (F.col("n") / F.lit(float(groups)))) for g in range(groups)]
    block = F.lit(-1)
    for edge in edges:
        block = block + F.when(F.col("i") >= edge, 1).otherwise(0)
    return axis.withColumn("block", block)


def combinations(groups: int, test_groups: int, max_splits: int | None, seed: int) -> list[tuple[int, ...]]:
    """Test-block combinations; of more than ``max_splits`` those with the smallest hashes, which any engine can repeat."""
    every = list(itertools.combinations(range(groups), test_groups))
    if max_splits is None or len(every) <= max_splits:
        return every
    digest = lambda c: hashlib.sha256(f"{seed}:{','.join(map(str, c))}".encode()).hexdigest()
    return sorted(sorted(every, key=digest)[:max_splits])


def combinatorial_purged(
    df: DataFrame,
    groups: int = 8,
    test_groups: int = 2,
    embargo: int = 5,
    horizon: int = 1,
    max_splits: int | None = 24,
    seed: int = 42,
    per_block: bool = False,
) -> DataFrame:
    """Every choice of test blocks; training dates whose label window meets the embargoed test span are dropped.

    The span runs from the first to the last test date. ``per_block`` purges around each test block alone instead.
    """
    if groups < 3:
        raise ValueError("groups must be >= 3")
    if not 1 <= test_groups < groups:
        raise ValueError("test_groups must be in [1, groups-1]")
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    combos = combinations(groups, test_groups, max_splits, seed)
    fold_list = F.array(*[F.struct(F.lit(f).alias("fold"), F.array(*[F.lit(g) for g in c]).alias("tests")) for f, c in enumerate(combos)])
    rows = block_ranges(date_axis(df), groups).withColumn("_f", F.explode(fold_list)).select("date", "i", "n", "block", "_f.fold", "_f.tests")
    rows = rows.withColumn("test", F.array_contains("tests", F.col("block")))
    i, last = F.col("i"), F.col("n") - 1
    label_end = F.least(i + horizon, last)

    def meets(low: Column, high: Column) -> Column:
        return (i <= F.least(last, high + embargo)) & (label_end >= F.greatest(F.lit(0), low - embargo))

    fold = Window.partitionBy("fold")
    if per_block:
        purged = F.lit(False)
        for g in range(groups):
            inside = F.col("test") & (F.col("block") == g)
            low, high = F.min(F.when(inside, i)).over(fold), F.max(F.when(inside, i)).over(fold)
            purged = purged | (low.isNotNull() & meets(low, high))
    else:
        purged = meets(F.min(F.when(F.col("test"), i)).over(fold), F.max(F.when(F.col("test"), i)).over(fold))
    rows = rows.withColumn("role", F.when(F.col("test"), "test").when(~purged, "train")).filter(F.col("role").isNotNull())
    sizes = [F.sum((F.col("role") == role).cast("int")).over(fold) for role in ("train", "test")]
    rows = rows.select("fold", "date", "role", sizes[0].alias("_tr"), sizes[1].alias("_te"))
    return rows.filter((F.col("_tr") >= 30) & (F.col("_te") >= 5)).drop("_tr", "_te")


def research_schemes(df: DataFrame, max_splits: int | None = 24) -> dict[str, DataFrame]:
    """The four schemes of the research study by name."""
    return {
        "walk_forward": walk_forward(df, 4),
        "purged_kfold": purged_kfold(df, 5, embargo=5),
        "purged_kfold_horizon": purged_kfold(df, 5, embargo=5, horizon=1),
        "cpcv": combinatorial_purged(df, 8, 2, embargo=5, horizon=1, max_splits=max_splits),
    }


def rows_on_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Panel rows whose day is in a date set."""
    days = dates.select(F.to_date("date").alias("_day")).distinct()
    return df.join(days, F.to_date(df["date"]) == F.col("_day"), "left_semi")


def rows_off_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Panel rows whose day is not in a date set."""
    days = dates.select(F.to_date("date").alias("_day")).distinct()
    return df.join(days, F.to_date(df["date"]) == F.col("_day"), "left_anti")

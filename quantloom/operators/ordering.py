"""Ordered computations inside groups that may be arbitrarily large, as one lazy plan for every size.

A plain window puts one group into one task. That is fine for groups with a natural bound (the rows of one
ticker are bounded by the trading calendar) but not for a cross-section, a model's scores or a
whole column. Here the plan itself finds the groups above ``max_group_rows`` (a map-side combined count):

* All other groups use an ordinary window.
* The large ones are cut into blocks along (group, order): splitters come from a bounded sample by hash inside the plan, running sums are taken per
  (group, block) and shifted by the totals of the earlier blocks. Splitters depend on the rows' values alone, so a lost executor or a second evaluation gives
  the same blocks.

No action runs while a plan is built. With no large group, adaptive execution drops the second branch after the count. Both ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.image import from_image, image
from quantloom.functions.safe import col

MAX_GROUP_ROWS = 4_000_000
FAN = 64  # splitters are searched in two steps of this width, so there are at most its square
SAMPLE = 16  # sampled rows per block at most
WINDOWED = 3  # columns that are ranked by windows over whole rows; each takes two sorts, which are held in one task
_BLOCK = "_order_block"
_DIGIT = 16  # bits of an image that one pass of the quantile selection settles


def large_groups(df: DataFrame, by: Sequence[str], max_group_rows: int) -> DataFrame:
    """Keys of the groups above ``max_group_rows`` rows; there are fewer than rows / max_group_rows of them."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_group_rows)
    return counts.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)])


def _same(by: Sequence[str]) -> Column:
    match = F.lit(True)
    for i, b in enumerate(by):
        match = match & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return match


def by_size(df: DataFrame, by: Sequence[str], max_group_rows: int, plain: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``plain`` on the rows of ordinary groups and ``split`` on those of large ones, as one plan. A single group over all rows is always split.

    The keys are broadcast; their number is bounded by rows / max_group_rows.
    """
    by = list(by)
    if not by:
        return split(df)
    large = F.broadcast(large_groups(df, by, max_group_rows))
    return plain(df.join(large, _same(by), "left_anti")).unionByName(split(df.join(large, _same(by), "left_semi")))


def _sort_keys(df: DataFrame, order: Sequence[Column]) -> list[Column]:
    """Ascending, comparable images of the leading sort columns: NULLs and NaN where Spark sorts them. Stops before a column it cannot turn round."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    keys = []
    for o in order:
        found = re.fullmatch(r"Column<'(.*?)(?: (ASC|DESC) NULLS (FIRST|LAST))?'>", str(o))
        name = found[1] if found else None
        if name not in kinds:
            raise ValueError(f"order must name columns, not {o}")
        down, nulls_last = found[2] == "DESC", found[3] == "LAST"
        kind, value = kinds[name], F.col(f"`{name}`")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0)  # -0.0 sorts as 0.0
            parts = [F.isnan(value) != F.lit(down), -value if down else value]
        elif down and isinstance(kind, T.IntegralType):
            parts = [F.bitwise_not(value)]
        elif down:
            break
        else:
            parts = [value]
        keys.append(F.struct((value.isNull() if nulls_last else value.isNotNull()).alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]))
    return keys


def _with_blocks(df: DataFrame, by: Sequence[str], order: Sequence[Column], max_group_rows: int) -> DataFrame:
    """``df`` with the number of its block along (group, order).

    The splitters are one row: every so many-th of a bounded sample of the sorted keys, the rows with the smallest hashes.
    """
    names = df.columns
    place = F.struct(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)], *[k.alias(f"o{i}") for i, k in enumerate(_sort_keys(df, order))])
    every = [F.col(f"`{c}`") for c in names]
    base = df.repartition(*every).withColumn("_place", place)  # evaluated once: the sample, the sums and the block totals read this exchange
    most, size = FAN * FAN, SAMPLE * FAN * FAN
    sample = base.select(F.xxhash64(*every).alias("_h"), "_place").orderBy("_h").limit(size).agg(F.sort_array(F.collect_list("_place")).alias("s"), F.max("_h").alias("top"))
    # rows in all: the sample itself, or its size over the share of the hash range that it fills
    rows = F.when(F.size("s") < size, F.size("s").cast("double")).otherwise(F.lit(size * 2.0**64) / (F.col("top").cast("double") + F.lit(2.0**63)))
    blocks = F.greatest(F.least(F.ceil(2 * rows / F.lit(max(1, max_group_rows))), F.lit(most), F.size("s")), F.lit(1)).cast("long")
    ends = sample.withColumn("b", blocks).select(F.expr("array_distinct(transform(slice(sequence(1, b), 1, cast(b - 1 as int)), i -> s[cast(i * size(s) div b as int)]))").alias("ends"))
    x = ends.select(F.struct("ends", F.expr(f"filter(ends, (e, i) -> i % {FAN} = {FAN - 1})").alias("steps")).alias("x")).scalar()  # one row of at most FAN * FAN keys
    here = F.col("_place")
    below = lambda keys: (F.array_position(F.sort_array(F.array_append(keys, here)), here) - 1).cast("int")  # noqa: E731 - keys before this one; they are sorted already
    found = base.withColumn("_step", below(x.getField("steps")))
    return found.select(*every, (F.col("_step") * FAN + below(F.slice(x.getField("ends"), F.col("_step") * FAN + 1, FAN))).alias(_BLOCK))


def _plain_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column | str], totals: Mapping[str, str]) -> DataFrame:
    ordered = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return df.select(
        "*",
        *[F.sum(col(e)).over(ordered).alias(name) for name, e in sums.items()],
        *[F.sum(col(sums[s])).over(whole).alias(name) for name, s in totals.items()],
    )


def _split_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column | str], totals: Mapping[str, str], max_group_rows: int) -> DataFrame:
    blocked = _with_blocks(df, by, order, max_group_rows)
    local = Window.partitionBy(*by, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = blocked.select("*", *[F.sum(col(e)).over(local).alias(f"_in_{n}") for n, e in sums.items()])
    per_block = blocked.groupBy(*by, _BLOCK).agg(*[F.sum(col(e)).alias(f"_blk_{n}") for n, e in sums.items()])
    # rows of the windows below: blocks of a group, at most FAN * FAN
    before = Window.partitionBy(*by).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    offsets = per_block.select(
        *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)],
        F.col(_BLOCK).alias("_kb"),
        *[F.coalesce(F.sum(f"_blk_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.sum(f"_blk_{s}").over(every).alias(name) for name, s in totals.items()],
    )
    return inner.join(offsets, (F.col(_BLOCK) == F.col("_kb")) & _same(by)).select(
        *df.columns,
        *[(F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.col(f"_off_{n}")).alias(n) for n in sums],
        *[F.col(name) for name in totals],
    )


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column | str],
    totals: Mapping[str, str] | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add inclusive running sums ``sums`` (name -> expression) per group, and group ``totals`` (name -> sum name).

    ``order`` names columns, ascending or descending, and must be a total order where single rows matter.
    """
    by, totals = list(by), dict(totals or {})
    return by_size(df, by, max_group_rows, lambda d: _plain_sums(d, by, order, sums, totals), lambda d: _split_sums(d, by, order, sums, totals, max_group_rows))


def with_position(df: DataFrame, by: Sequence[str], order: Sequence[Column], position: str = "position", size: str = "group_size", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """1-based row position in the group under ``order`` (must be a total order) and the group size."""
    return running_sums(df, by, order, {position: F.lit(1).cast("long")}, {size: position}, max_group_rows)


def _plain_ranks(df: DataFrame, by: Sequence[str], columns: Mapping[str, str], pct: bool) -> DataFrame:
    if len(columns) > WINDOWED and len({df.schema[c].dataType for c in columns}) == 1:
        return _narrow_ranks(df, by, columns, pct)
    out = []
    for source, name in columns.items():
        value = F.col(source)
        low = F.rank().over(Window.partitionBy(*by).orderBy(value.asc_nulls_last()))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, source))
        rank = low + (ties - 1) / F.lit(2.0)
        if pct:
            rank = rank / F.count(value).over(Window.partitionBy(*by))
        out.append(F.when(value.isNotNull(), rank).alias(name))
    return df.select("*", *out)


def _narrow_ranks(df: DataFrame, by: Sequence[str], columns: Mapping[str, str], pct: bool) -> DataFrame:
    """Ranks of many columns of one type in one sort of narrow rows, whatever their number; equal rows of (group, values) have equal ranks and meet them by an equi-join."""
    keys = [*by, *columns]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    pairs = [F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)]
    long = counts.select(*keys, "_c", F.explode(F.array(*pairs)).alias("_x")).select(*keys, "_c", F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v")).filter(F.col("_v").isNotNull())
    total = lambda *w: F.sum("_c").over(Window.partitionBy(*by, "_i", *w))
    ties, upto = total("_v"), F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy("_v"))  # its frame ends with the last equal value
    rank = upto - ties + (ties + 1) / F.lit(2.0)
    ranked = long.select(*keys, "_i", (rank / total() if pct else rank).alias("_r"))
    one = ranked.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(*[F.max(F.when(F.col("_i") == i, F.col("_r"))).alias(name) for i, name in enumerate(columns.values())])
    return df.join(one, _same(keys), "left").select(*df.columns, *columns.values())


def _split_ranks(df: DataFrame, by: Sequence[str], columns: Mapping[str, str], pct: bool, max_group_rows: int) -> DataFrame:
    """Ties share one rank, so distinct values are ranked: a hot value collapses before the shuffle. Values keep their own type."""
    out = df
    for source, name in columns.items():
        counts = df.filter(F.col(source).isNotNull()).groupBy(*by, F.col(source).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        ranked = _split_sums(counts, by, [F.col("_v").asc()], {"_cum": F.col("_c")}, {"_all": "_cum"}, max_group_rows)
        rank = F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / F.lit(2.0)
        one = ranked.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col("_v").alias("_kv"), (rank / F.col("_all") if pct else rank).alias(name))
        out = out.join(one, (F.col(source) == F.col("_kv")) & _same(by), "left").drop("_kv", *[f"_k{i}" for i in range(len(by))])
    return out


def average_ranks(df: DataFrame, by: Sequence[str], columns: Mapping[str, str], max_group_rows: int = MAX_GROUP_ROWS, pct: bool = False) -> DataFrame:
    """Average-tie ranks (``columns``: source -> output) inside each group; NULLs get no rank.

    ``pct`` divides by the number of non-null values, which is pandas' ``rank(pct=True)``.
    """
    by = list(by)
    return by_size(df, by, max_group_rows, lambda d: _plain_ranks(d, by, columns, pct), lambda d: _split_ranks(d, by, columns, pct, max_group_rows))


def positions_and_ranks(df: DataFrame, by: Sequence[str], order: Sequence[Column], columns: Mapping[str, str], position: str, size: str, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``with_position`` and ``average_ranks`` together: large groups are looked for once."""
    by, one, totals = list(by), {position: F.lit(1).cast("long")}, {size: position}
    plain = lambda d: _plain_ranks(_plain_sums(d, by, order, one, totals), by, columns, False)
    split = lambda d: _split_ranks(_split_sums(d, by, order, one, totals, max_group_rows), by, columns, False, max_group_rows)
    return by_size(df, by, max_group_rows, plain, split)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float], by: Sequence[str] = (), max_group_rows: int = MAX_GROUP_ROWS, narrow_above: int | None = None) -> DataFrame:
    """Linearly interpolated exact quantiles, one row per (group, feature); NULL and NaN do not count, -0.0 is 0.0.

    Radix selection: values are counted by the digits of their images (``functions.image``), 16 bits a pass. Each pass keeps, for every rank that is asked for, the one
    digit that holds it, and the next counts only values that begin with the digits kept, so four passes settle every column, group and probability
    exactly. Counts are combined on the map side; a pass has at most 2 ** 16 rows per rank, whatever the input. ``max_group_rows`` and ``narrow_above`` no longer matter and are
    accepted for earlier callers.
    """
    by = list(by)
    keys = [*by, "feature"]
    pairs = [F.struct(F.lit(c).alias("feature"), image(F.col(c).cast("double")).alias("_v")) for c in columns]
    long = df.select(*by, F.explode(F.array(*pairs)).alias("_x")).select(*by, "_x.feature", "_x._v").filter(F.col("_v").isNotNull())
    counts = long.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))  # every pass reads this exchange
    names, at = list(probabilities), [F.lit(float(p)) for p in probabilities.values()]
    spot = lambda k: at[k] * (F.col("_n") - 1)  # noqa: E731 - 0-based fractional rank
    rank = lambda i, k, f: F.struct(F.lit(i).alias("i"), f(spot(k)).cast("long").alias("r"))
    asked = F.array(*[rank(2 * k + side, k, f) for k in range(len(names)) for side, f in ((0, F.floor), (1, F.ceil))])
    state, keep = None, (1 << _DIGIT) - 1
    for k in range(64 // _DIGIT):
        digit = F.shiftright("_v", 64 - _DIGIT * (k + 1))
        if state is None:  # the first digit has the sign
            seen = counts.groupBy(*keys, digit.alias("_prefix")).agg(F.sum("_c").alias("_c"))
            inside = Window.partitionBy(*keys)
            seen = seen.withColumn("_n", F.sum("_c").over(inside)).withColumn("_asked", asked)
        else:
            lead = counts.withColumn("_lead", F.shiftright("_v", 64 - _DIGIT * k))
            left = state.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_prefix").alias("_kept"), "_n", "_asked")
            found = lead.join(left, _same(keys) & (F.col("_lead") == F.col("_kept")))
            seen = found.groupBy(*keys, "_n", "_asked", "_lead", digit.alias("_prefix")).agg(F.sum("_c").alias("_c"))
            inside = Window.partitionBy(*keys, "_lead")
        seen = seen.withColumn("_upto", F.sum("_c").over(inside.orderBy(F.col("_prefix").bitwiseAND(F.lit(keep)) if k else F.col("_prefix")).rowsBetween(Window.unboundedPreceding, 0)))
        hit = F.expr("transform(filter(_asked, x -> _upto - _c <= x.r and x.r < _upto), x -> struct(x.i as i, x.r - _upto + _c as r))")
        state = seen.withColumn("_asked", hit).filter(F.size("_asked") > 0).select(*keys, "_n", "_prefix", "_asked")
    value = state.select(*keys, "_n", from_image(F.col("_prefix")).alias("_value"), F.explode("_asked.i").alias("_i"))
    out = []
    for k, name in enumerate(names):
        low, high = (F.max(F.when(F.col("_i") == 2 * k + side, F.col("_value"))) for side in (0, 1))
        out.append((low + F.when(high > low, (high - low) * F.max(spot(k) - F.floor(spot(k)))).otherwise(F.lit(0.0))).alias(name))
    return value.groupBy(*keys).agg(*out)

"""Both ways through a group, the plain window and the checkpointed blocks, give the same result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import ordering
from quantloom.operators.ordering import average_ranks, exact_quantiles, running_sums, with_position
from quantloom.operators.splits import row_fraction
from quantloom.operators.metrics import ranking_quality, strategy_evaluation


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value holds a third of them."""
    rng = np.random.default_rng(7)
    n = 900
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b"], n)),
            "x": np.where(rng.random(n) < 0.35, 0.5, rng.random(n).round(3)),
            "k": np.arange(n),
            "v": rng.integers(0, 9, n),
        }
    )
    return spark.createDataFrame(pdf), pdf


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("limit", [10**6, 50])
def test_running_sums(skewed, limit):
    df, pdf = skewed
    out = running_sums(df, ["g"], [F.col("x").desc(), F.col("k")], {"cum": F.col("v")}, {"total": "cum"}, limit).toPandas().sort_values("k")
    ordered = pdf.sort_values(["x", "k"], ascending=[False, True])
    want = ordered.assign(cum=ordered.groupby("g")["v"].cumsum(), total=ordered.groupby("g")["v"].transform("sum")).sort_values("k")
    assert out["cum"].tolist() == want["cum"].tolist()
    assert out["total"].tolist() == want["total"].tolist()


@pytest.mark.parametrize("limit", [10**6, 50])
def test_positions_and_global_group(skewed, limit):
    df, pdf = skewed
    out = with_position(df, [], [F.col("x"), F.col("k")], max_group_rows=limit).orderBy("position").toPandas()
    want = pdf.sort_values(["x", "k"])
    assert out["k"].tolist() == want["k"].tolist()
    assert set(out["group_size"]) == {len(pdf)}


@pytest.mark.parametrize("limit", [10**6, 50])
def test_average_ranks(skewed, limit):
    df, pdf = skewed
    holes = df.withColumn("x", F.when(F.col("k") % 10 != 0, F.col("x")))
    out = average_ranks(holes, ["g"], {"x": "r"}, limit, pct=True).toPandas().sort_values("k")
    pdf = pdf.assign(x=pdf["x"].where(pdf["k"] % 10 != 0))
    want = pdf.groupby("g")["x"].rank(pct=True)
    assert np.allclose(out["r"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("limit", [10**6, 50])
def test_exact_quantiles(skewed, limit):
    df, pdf = skewed
    got = {r["g"]: (r["lo"], r["mid"]) for r in exact_quantiles(df, ["x"], {"lo": 0.01, "mid": 0.5}, ["g"], limit).collect()}
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], [part["x"].quantile(0.01), part["x"].quantile(0.5)])


@pytest.mark.parametrize("narrow", [10**9, 100])
def test_quantiles_from_brackets(spark, narrow):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 60_000), "b": np.where(rng.random(60_000) < 0.4, 1.0, rng.random(60_000))})
    got = {r["feature"]: r for r in exact_quantiles(spark.createDataFrame(pdf), ["a", "b"], {"lo": 0.01, "mid": 0.5, "hi": 0.99}, narrow_above=narrow).collect()}
    for c in pdf:
        assert np.allclose([got[c]["lo"], got[c]["mid"], got[c]["hi"]], pdf[c].quantile([0.01, 0.5, 0.99]), atol=0, rtol=1e-14)


def test_metrics_do_not_depend_on_the_way(spark, skewed):
    df, _ = skewed
    labelled = df.withColumn("target", (F.col("v") > 4).cast("int"))
    plain, split = (ranking_quality(labelled, ["g"], "x", "target", m).orderBy("g").toPandas() for m in (10**6, 40))
    assert np.allclose(plain[["roc_auc", "pr_auc"]], split[["roc_auc", "pr_auc"]])
    panel = labelled.select(F.col("k").cast("string").alias("ticker"), F.lit("2024-01-01").alias("date"), F.col("x").alias("score"), (F.col("v") - 4.5).alias("forward_return"), "target")
    one, two = (strategy_evaluation(panel, max_group_rows=m).toPandas() for m in (10**6, 40))
    assert np.allclose(one.drop(columns="sharpe").to_numpy(dtype=float), two[one.columns].drop(columns="sharpe").to_numpy(dtype=float))


@pytest.mark.parametrize("limit", [10**6, 50])
def test_row_fraction(skewed, limit):
    df, pdf = skewed
    out = {r["role"]: r["count"] for r in row_fraction(df, ["k"], max_group_rows=limit).groupBy("role").count().collect()}
    assert out == {"train": 630, "validation": 135, "test": 135}


def test_auc_by_brute_force(skewed):
    df, pdf = skewed
    labelled = df.withColumn("target", (F.col("v") > 4).cast("int"))
    got = ranking_quality(labelled, [], "x", "target").first()
    pos, neg = pdf[pdf["v"] > 4]["x"].to_numpy(), pdf[pdf["v"] <= 4]["x"].to_numpy()
    pairs = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert abs(got["roc_auc"] - pairs / (len(pos) * len(neg))) < 1e-12


def jobs_started(spark, build):
    """Spark jobs that run while ``build`` makes its DataFrames."""
    tracker, group = spark.sparkContext.statusTracker(), f"build-{id(build)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_no_action_runs_while_a_query_is_built(spark, skewed):
    from quantloom.operators import crosssection, labels, metrics

    df, _ = skewed
    panel = df.select(F.col("k").cast("string").alias("ticker"), F.lit("2024-01-01").alias("date"), F.col("x").alias("score"), (F.col("v") - 4.5).alias("forward_return"), (F.col("v") > 4).cast("int").alias("target"))
    by = ["date"]
    builds = [
        lambda: metrics.ranking_quality(panel, by),
        lambda: metrics.roc_points(panel, by),
        lambda: metrics.precision_recall_at(panel, by, F.lit(5), ["ticker"]),
        lambda: metrics.selection_metrics(panel),
        lambda: metrics.information_coefficients(panel),
        lambda: metrics.strategy_evaluation(panel),
        lambda: metrics.quantile_returns(panel),
        lambda: crosssection.selected_flag(panel, 3),
        lambda: labels.top_share_target(panel, "forward_return"),
        lambda: average_ranks(panel, by, {"score": "r"}),
        lambda: exact_quantiles(panel, ["score"], {"m": 0.5}),
        lambda: row_fraction(panel, ["ticker"]),
    ]
    assert [jobs_started(spark, b) for b in builds] == [0] * len(builds)


@pytest.mark.parametrize("limit", [10**6, 60])
def test_null_groups_nan_and_large_numbers(spark, limit):
    """A NULL key is a group; NaN sorts as Spark sorts it; whole numbers beyond 2 ** 53 are not rounded."""
    rng = np.random.default_rng(12)
    n, base = 600, 2**60
    big = [base + int(i) for i in rng.permutation(n)]
    rows = [(None if i % 3 == 0 else "a", float("nan") if i % 50 == 0 else None if i % 70 == 1 else -0.0 if i % 9 == 0 else float(rng.integers(-3, 3)), big[i], i) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, big long, k long")
    for order in ([F.col("x").desc(), F.col("k")], [F.col("x").asc(), F.col("k").desc()], [F.col("big").desc()]):
        got = with_position(df, ["g"], order, max_group_rows=limit).orderBy("g", "position").select("g", "k", "position", "group_size").collect()
        want = {g: [r.k for r in df.filter(F.col("g").eqNullSafe(F.lit(g))).orderBy(*order).collect()] for g in (None, "a")}
        for g, keys in want.items():
            assert [(r.k, r.position, r.group_size) for r in got if r.g == g] == [(k, i + 1, len(keys)) for i, k in enumerate(keys)]
    ranks = {(r.g, r.big): r.r for r in average_ranks(df, ["g"], {"big": "r"}, limit).collect()}
    for g in (None, "a"):
        mine = sorted(r[2] for r in rows if r[0] == g)
        assert [ranks[g, b] for b in mine] == [i + 1.0 for i in range(len(mine))]


def test_splitters_are_bounded_and_even(spark):
    from quantloom.operators.ordering import _BLOCK, _with_blocks

    df = spark.range(20_000).select(F.lit(None).cast("string").alias("g"), (F.col("id") * 7919 % 20_000).cast("double").alias("x"), "id")
    sizes = [r["count"] for r in _with_blocks(df, ["g"], [F.col("x").desc()], 1000).groupBy(_BLOCK).count().collect()]
    assert 30 <= len(sizes) <= 41 and max(sizes) < 1500


def test_images_keep_the_order_of_doubles(spark):
    import struct

    from quantloom.functions.image import from_image, image

    rng = np.random.default_rng(3)
    xs = [struct.unpack("<d", rng.bytes(8))[0] for _ in range(3000)] + [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1]
    xs += [2.0**k for k in range(-1074, 1024, 3)] + [float(np.nextafter(2.0**k, 0)) for k in range(-1073, 1024, 3)]
    xs = [x for x in xs if x == x] + [None, float("nan")]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", image(F.col("x")).alias("i")).withColumn("y", from_image(F.col("i"))).collect()
    for r in out:
        if r.x is None or r.x != r.x:
            assert r.i is None and r.y is None
        else:
            bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
            assert (r.i, r.y) == (-bits if r.x < 0 else bits, r.x)


def test_quantiles_of_ties_signs_nan_and_null_groups(spark):
    rng = np.random.default_rng(6)
    values = np.where(rng.random(900) < 0.34, 0.25, rng.normal(0, 1e-3, 900))
    values[:40], values[40:60], values[60:70] = -0.0, 0.0, np.nan
    pdf = pd.DataFrame({"g": np.where(np.arange(900) % 5 == 0, None, "a"), "x": values, "y": np.float64(2.0**60) + np.arange(900) * 256.0, "z": 1.5})
    rows = [tuple(None if isinstance(v, float) and v != v and k % 2 else v for v in r) for k, r in enumerate(pdf.itertuples(index=False))]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    probabilities = {"least": 0.0, "low": 0.01, "mid": 0.5, "odd": 0.337, "high": 0.99, "most": 1.0}
    got = {(r["g"], r["feature"]): r for r in exact_quantiles(df, ["x", "y", "z"], probabilities, ["g"]).collect()}
    for g in (None, "a"):
        part = pdf[pdf["g"].isna()] if g is None else pdf[pdf["g"] == g]
        for c in ("x", "y", "z"):
            assert np.allclose([got[g, c][p] for p in probabilities], part[c].astype(float).quantile(list(probabilities.values())), rtol=1e-15, atol=0)
    assert exact_quantiles(df.limit(0), ["x"], {"m": 0.5}).count() == 0


def test_quantile_passes_do_not_depend_on_columns_and_probabilities(spark):
    """Radix selection: the same four passes for one column and one probability as for many."""
    df = spark.range(500).select(*[F.rand(k).alias(f"c{k}") for k in range(6)])
    windows = lambda d: d._jdf.queryExecution().sparkPlan().toString().count("- Window [")
    one = exact_quantiles(df, ["c0"], {"m": 0.5})
    many = exact_quantiles(df, [f"c{k}" for k in range(6)], {f"p{i}": i / 40 for i in range(41)})
    assert windows(one) == windows(many) == 5  # one for the size of the group


@pytest.mark.parametrize("pct", [False, True])
def test_ranks_of_many_columns(spark, pct):
    """Ranked together, columns get what each gets alone: with repeated rows, NULL, NaN, signed zeros and a NULL group."""
    rng = np.random.default_rng(5)
    pick = lambda: [None, float("nan"), -0.0, 0.0, 1.0, 2.5][rng.integers(0, 6)]
    names = [f"c{i}" for i in range(5)]
    data = [(None if k % 9 == 0 else "ab"[k % 2], *[pick() for _ in names], k // 2) for k in range(60)]
    data += data[:7] + [("a", *[None] * 5, 99)] * 2
    df = spark.createDataFrame(data, "g string, " + ", ".join(f"{c} double" for c in names) + ", k int")
    together = average_ranks(df, ["g"], {c: f"{c}_r" for c in names}, pct=pct).collect()
    assert list(together[0].asDict()) == [*df.columns, *[f"{c}_r" for c in names]]
    plain = lambda rows, c: sorted(str((*r[: len(df.columns)], r[f"{c}_r"])).replace("-0.0", "0.0") for r in rows)
    for c in names:
        assert plain(together, c) == plain(ordering._plain_ranks(df, ["g"], {c: f"{c}_r"}, pct).collect(), c)


def test_sorts_do_not_follow_the_number_of_ranked_columns(spark):
    names = [f"c{i}" for i in range(12)]
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), *[((F.col("id") * (i + 3)) % 7).cast("double").alias(c) for i, c in enumerate(names)])
    sorts = []
    for n in (4, 12):
        out = ordering._plain_ranks(df, ["g"], {c: f"{c}_r" for c in names[:n]}, True)
        sorts.append(out._jdf.queryExecution().executedPlan().toString().count("Sort ["))
    assert sorts[0] == sorts[1] <= 4, sorts

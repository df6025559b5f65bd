"""Correlations over packed co-moments, block bootstrap by running sums, hash-ordered splits."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import inference, splits, summaries


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_correlations_of_many_columns_and_large_means(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (900, 12))
    base[:, 1] = base[:, 0] * 2 + rng.normal(0, 1e-3, 900)
    base += np.arange(12) * 1e7  # means far above the spread
    pdf = pd.DataFrame(base, columns=[f"f.{i}" for i in range(12)])
    pdf["flat"] = 0.1
    holes = pdf.mask(rng.random(pdf.shape) < 0.01)
    rows = [tuple(None if x != x else float(x) for x in r) for r in holes.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(7)
    out = summaries.correlations(df, list(pdf.columns))
    x = holes.dropna().drop(columns="flat").to_numpy(np.longdouble)
    x -= x.mean(axis=0)
    want = pd.DataFrame((x.T @ x / np.sqrt(np.outer((x * x).sum(0), (x * x).sum(0)))).astype(float), list(pdf.columns[:-1]), list(pdf.columns[:-1]))
    got = {(r.feature_a, r.feature_b): r.r for r in out.collect()}
    assert len(got) == 13 * 12 // 2
    for (a, b), r in got.items():
        assert (r is None) if "flat" in (a, b) else abs(r - want.loc[a, b]) < 1e-8, (a, b, r)  # means are 1e8 times the spread
    text = plan(out)
    assert "corr(" not in text and text.count("FlatMapGroupsInArrow") == 2


def test_correlations_of_empty_and_single_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert summaries.correlations(df, ["a"]).count() == 0
    assert [r.r for r in summaries.correlations(df.limit(0), ["a", "b"]).collect()] == [None]
    assert [r.r for r in summaries.correlations(df, ["a", "b"]).collect()] == [None]


def brute_bootstrap(x, reps, block, seed):
    n, m = len(x), 2_147_483_647
    means = []
    for rep in range(reps):
        picked = []
        for i in range(n):
            s = (rep * 73_856_093 + (i // block) * 19_349_663 + seed * 83_492_791) % m
            s = (s * s + s * 48_271 + 12_345) % m
            s = (s * s + s * 16_807 + 1) % m
            picked.append(x[(s % n + i % block) % n])
        means.append(np.mean(picked))
    return np.array(means)


@pytest.mark.parametrize("n", [15, 23, 101])
def test_bootstrap_by_running_sums(spark, n):
    rng = np.random.default_rng(n)
    series = {g: rng.normal(0.01, 0.1, n) + shift for g, shift in (("a", 0.0), ("b", 1e6))}
    rows = [(g, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for g, x in series.items() for i, v in enumerate(x)]
    rows += [("short", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2019, 1, 1), float("nan")), ("b", dt.date(2019, 1, 1), None)]
    out = inference.block_bootstrap(spark.createDataFrame(rows, "g string, date date, x double"), "x", reps=60, block=5, seed=7, by=["g"])
    got = {r.g: r for r in out.collect()}
    for g, x in series.items():
        means = brute_bootstrap(x.tolist(), 60, 5, 7)
        assert got[g].bootstrap_mean == pytest.approx(means.mean(), rel=1e-10) and got[g].bootstrap_std == pytest.approx(means.std(ddof=1), rel=1e-6)
        assert got[g].p_value_one_sided == pytest.approx((means >= x.mean()).mean(), abs=1 / 60) and got[g].observed_mean == pytest.approx(x.mean())
    assert got["short"].note == "too_few_observations" and got["short"].p_value_one_sided == 1.0


def test_bootstrap_has_no_join_on_positions(spark):
    df = spark.range(40).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.rand(1).alias("x"))
    text = plan(inference.block_bootstrap(df, "x"))
    assert "pos#" not in text and text.count("Generate explode") == 1


def test_sampled_combinations_are_a_hash_ordered_pick():
    every = splits.combinations(8, 2, None, 42)
    some = splits.combinations(8, 2, 10, 42)
    assert some == sorted(some) and set(some) <= set(every) and some != every[:10] and splits.combinations(8, 2, 10, 43) != some
    assert set(splits.combinations(8, 2, 9, 42)) < set(some)  # a smaller sample is part of a larger one

"""Isotonic calibration against a pooling by the max-min formula and against Spark's own estimator."""

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from quantloom.models.isotonic import IsotonicCurve, blocks, pool


def max_min(y, w):
    """The isotonic fit by its definition: the largest over starts of the least mean over ends."""
    n, out = len(y), []
    for i in range(n):
        out.append(max(min((y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)))
    return np.array(out)


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "late_drop", "ties"])
def test_pool_by_definition(kind):
    rng = np.random.default_rng(7)
    y = {"noise": rng.integers(0, 2, 60).astype(float), "falling": np.arange(30.0)[::-1], "rising": np.arange(30.0), "late_drop": np.r_[np.arange(40.0), -900.0], "ties": np.repeat([1.0, 0.0, 1.0], 9)}[kind]
    w = rng.integers(1, 5, len(y)).astype(float)
    x = np.arange(len(y), dtype=float)
    lo, hi, ww, s = pool(x, x, w, w * y)
    fitted = (s / ww)[np.searchsorted(hi, x)]
    assert np.allclose(fitted, max_min(y, w)) and (np.diff(s / ww) > 0).all()


def panel(spark, n=4000, hot=0.4):
    """A rising chance with noise; ``hot`` of all rows share one score."""
    rng = np.random.default_rng(3)
    p = np.where(rng.random(n) < hot, 0.5, np.round(rng.random(n), 4))
    y = (rng.random(n) < p**2).astype(float)
    return spark.createDataFrame(list(zip(range(n), p.tolist(), y.tolist(), strict=True)), "id int, probability double, target double").repartition(5)


def test_same_curve_as_the_estimator(spark):
    rows = panel(spark)
    curve = IsotonicCurve.fit(rows)
    probes = spark.createDataFrame([(float(x),) for x in np.linspace(-0.2, 1.2, 701)], "probability double").unionByName(rows.select("probability"))
    ours = curve.transform(probes).orderBy("probability").toPandas()["_calibrated"].to_numpy()
    model = IsotonicRegression(featuresCol="probability", labelCol="target", predictionCol="q").fit(rows)
    theirs = model.transform(probes).orderBy("probability").toPandas()["q"].to_numpy()
    assert np.allclose(ours, theirs, atol=1e-9) and (np.diff(ours) >= -1e-12).all()


def test_many_ranges_and_packed_rows(spark):
    """More blocks than one packed row holds, pooled over several levels of ranges."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        rows = spark.range(20_000).select((F.col("id") / 20_000).alias("probability"), (F.col("id") - (F.col("id") % 10) * 3).cast("double").alias("target"))
        curve = IsotonicCurve.fit(rows)
        got = curve.transform(rows).orderBy("probability").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    i = np.arange(20_000)
    lo, hi, w, s = pool(i / 20_000, i / 20_000, np.ones(20_000), (i - (i % 10) * 3).astype(float))
    assert curve.table.count() == len(lo) > 1000
    assert np.allclose(got["_calibrated"], (s / w)[np.searchsorted(hi, i / 20_000)])


def test_nulls_empty_tables_weights_and_one_score(spark):
    rows = spark.createDataFrame([(0.1, 1.0), (0.1, 0.0), (None, 1.0), (0.9, None), (float("nan"), 1.0)], "probability double, target double")
    curve = IsotonicCurve.fit(rows)
    assert [tuple(r) for r in curve.table.collect()] == [(0.1, 0.1, 0.5)]
    assert {r["probability"]: r["_calibrated"] for r in curve.transform(rows).filter("probability = 0.1 or probability is null or probability = 0.9").collect()} == {0.1: 0.5, None: None, 0.9: 0.5}
    weighted = blocks(rows, "probability", "target", F.when(F.col("target") == 1, 3.0).otherwise(1.0))
    assert weighted.first()["value"] == 0.75
    empty = IsotonicCurve.fit(rows.limit(0))
    assert empty.table.count() == 0 and all(r["_calibrated"] is None for r in empty.transform(rows).collect())

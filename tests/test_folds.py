"""The shared fold matrix against folds cut and fitted one by one."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.models import folds, research
from quantloom.models.specs import Spec
from quantloom.models.training import fit
from quantloom.operators import splits

GBT = Spec("small", ("a", "b"), (("gbt", {"maxIter": 2, "maxDepth": 2}),))


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = [(f"T{t}", dt.date(2020, 1, 1) + dt.timedelta(d), float(rng.integers(0, 6)), float(rng.integers(0, 5)), None if (t + d) % 9 == 0 else float(rng.normal())) for d in range(150) for t in range(6)]
    pdf = pd.DataFrame(rows, columns=["ticker", "date", "a", "b", "c"])
    pdf["forward_return"] = pdf["a"] - 2.5 + rng.normal(0, 1.5, len(pdf))
    pdf["target"] = (pdf["forward_return"] > 0).astype(int)
    out = spark.createDataFrame(pdf.assign(extra="x"))
    return out.withColumn("c", F.when(~F.isnan("c"), F.col("c"))), pdf


def test_bins_follow_the_split_points(spark):
    rows = spark.createDataFrame([(-1.0,), (0.5,), (0.7,), (9.0,), (None,), (float("nan"),)], "v double")
    got = [r["v"] for r in folds.binned(rows, ["v"], {"v": [0.5, 2.0]}).collect()]
    assert got == [0, 1, 1, 2, None, None]


def test_sizes_fills_and_weights_by_brute_force(panel):
    rows, pdf = panel
    schemes = splits.research_schemes(rows.select("date"), max_splits=3)
    m = folds.build(rows, ["a", "b", "c"], schemes)
    table = m.rows.select("ticker", "date", "c").toPandas()
    for name, fold_rows in schemes.items():
        for fold, f in fold_rows.toPandas().groupby("fold"):
            key = f"{name}#{fold}"
            days = {role: set(f[f["role"] == role]["date"]) for role in ("train", "test")}
            train, test = (pdf[pdf["date"].isin(days[role])] for role in ("train", "test"))
            assert m.sizes[key] == (len(train), len(test))
            assert abs(m.weights[key] - (train["target"] == 0).sum() / train["target"].sum()) < 1e-12
            bins = np.sort(table[table["date"].isin(days["train"])]["c"].dropna())
            assert m.fills[(key, "c")] == bins[(len(bins) - 1) // 2]


def test_same_scores_as_a_fit_of_its_own(panel):
    """The features hold few values, so bins lose nothing and both fits see the same split points."""
    rows, _ = panel
    walk = splits.walk_forward(rows.select("date"), 2)
    scored = folds.scores(folds.build(rows, ["a", "b"], {"walk": walk}), {"both": ["a", "b"], "swapped": ["b", "a"]}, GBT)
    got = scored.filter("ablation = 'both'").toPandas().sort_values(["fold", "ticker", "date"])
    want = []
    for fold in (1, 2):
        train, test = research.fold_frames(rows, walk, fold)
        want.append(fit(GBT, train).score(test).withColumn("fold", F.lit(fold)).toPandas())
    want = pd.concat(want).sort_values(["fold", "ticker", "date"])
    assert len(got) == len(want) and np.allclose(got["score"], want["probability"], atol=1e-6)
    sizes = {(r["ablation"], r["fold"]): (r["n_train"], r["n_test"], r["n_scored"]) for r in folds.fold_sizes(scored).collect()}
    assert sizes == {(g, f): (300 * f, 300, 300) for g in ("both", "swapped") for f in (1, 2)} and folds.fold_metrics(scored).count() == 4


def test_schemes_limits_and_errors(panel):
    rows, _ = panel
    two = splits.two_way(rows).withColumn("fold", F.lit(0))
    m = folds.build(rows, ["a", "b", "c"], {"holdout": two, "again": two})
    scored = folds.scores(m, {"A": ["a", "b"], "B": ["a", "b", "c"], "single": ["a"]}, GBT, only={"again": ["A"]}, with_train=True)
    assert {(r[0], r[1]) for r in scored.select("split_name", "ablation").distinct().collect()} == {("holdout", "A"), ("holdout", "B"), ("again", "A")}
    auc = folds.ablation_auc(scored.filter("split_name = 'holdout'")).orderBy("ablation").collect()
    assert [r["ablation"] for r in auc] == ["A", "B"] and auc[0]["gain"] is None and all(0.5 < r["auc_train"] <= 1 for r in auc)
    with pytest.raises(ValueError, match="no fold is large enough"):
        folds.scores(m, {"A": ["a", "b"]}, GBT, min_train=10**6)
    with pytest.raises(ValueError, match="absent"):
        folds.build(rows, ["a", "gone"], {"holdout": two})
    with pytest.raises(ValueError, match="tree learners"):
        m.fit(Spec("x", ("a",), (("logistic", {"C": 1.0}),)), "holdout#0")


def test_a_fold_is_learnt_in_tasks_of_its_size(spark, monkeypatch):
    """Nine files of rows make one task for a small fold, and more when the fold is larger; no row goes."""
    rows = spark.range(900).repartition(9).selectExpr("id as ticker", "id as date", "cast(id % 2 as int) as target", "cast(id % 7 as short) as a", "array('s#0') as _train", "array('s#1') as _test")
    m = folds.FoldMatrix(rows, "target", ("a",), {"s#0": (900, 0), "s#1": (0, 900)}, {"s#0": 1.0, "s#1": 1.0}, {})
    assert m.part("train", "s#0", ["a"]).rdd.getNumPartitions() == 1
    monkeypatch.setattr(folds, "TASK_ROWS", 300)
    part = m.part("test", "s#1", ["a"])
    assert part.rdd.getNumPartitions() == 3 and part.count() == 900

"""Exact tree attributions beside all subsets, and their sums."""

import datetime as dt
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.models import attribution, training
from quantloom.models.specs import Spec

FEATURES = ("a", "b", "c", "d")
SETTINGS = {"forest": {"numTrees": 4, "maxDepth": 5}, "gbt": {"maxIter": 4, "maxDepth": 4, "stepSize": 0.3}, "ranker": {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}}


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(21)
    n = 300
    x = rng.normal(0, 1, (n, 4)).round(1)  # many equal values
    y = ((x[:, 0] * x[:, 1] + x[:, 2] > 0.1) ^ (rng.random(n) < 0.1)).astype(int)
    rows = [(f"T{i % 20}", dt.date(2024, 1, 1) + dt.timedelta(i // 20), *[None if i % 11 == k else float(v) for k, v in enumerate(x[i])], int(y[i]), float(x[i, 0])) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, a double, b double, c double, d double, target int, forward_return double").cache()


@pytest.mark.parametrize("kind", list(SETTINGS))
def test_equal_to_all_subsets(spark, panel, kind):
    model = training.fit(Spec("m", FEATURES, ((kind, SETTINGS[kind]),)), panel)
    rows, background = panel.filter("ticker in ('T1', 'T7') and date <= '2024-01-03'"), panel.filter("ticker = 'T3'")
    got = {(r.ticker, r.date, r.feature): r.value for r in attribution.tree_attributions(model, rows, background).collect()}
    sample = [[r[f] for f in FEATURES] for r in background.collect()]
    mixed, subsets = [], [s for k in range(5) for s in combinations(range(4), k)]
    own = rows.collect()
    for i, r in enumerate(own):
        for s in subsets:
            for b in sample:
                mixed.append((i, "".join(map(str, s)), *[r[f] if k in s else b[k] for k, f in enumerate(FEATURES)]))
    scored = attribution.explained(model, spark.createDataFrame(mixed, "i int, s string, a double, b double, c double, d double"))
    worth = {(r.i, r.s): r.v for r in scored.groupBy("i", "s").agg(F.avg("explained").alias("v")).collect()}
    at = lambda i, s: worth[i, "".join(map(str, sorted(s)))]
    for i, r in enumerate(own):
        for k, f in enumerate(FEATURES):
            rest = [s for s in subsets if k not in s]
            value = sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (at(i, {*s, k}) - at(i, s)) for s in rest)
            assert got[r.ticker, r.date, f] == pytest.approx(value, abs=1e-12)
    assert len(got) == 4 * len(own)


@pytest.mark.parametrize("kind", list(SETTINGS))
def test_sum_to_prediction_less_base(panel, kind):
    model = training.fit(Spec("m", FEATURES, ((kind, SETTINGS[kind]),)), panel)
    parts = attribution.tree_attributions(model, panel, panel).groupBy("ticker", "date").agg(F.sum("value").alias("total"))
    base = attribution.tree_base(model, panel).first()
    both = attribution.explained(model, panel).join(parts, ["ticker", "date"]).select("explained", "total").collect()
    assert base["rows"] == 100 and len(both) == 300 and all(abs(r["explained"] - base["base_value"] - r["total"]) < 1e-9 for r in both)


def test_explained_is_on_the_scale_of_the_probability(panel):
    for kind in SETTINGS:
        model = training.fit(Spec("m", FEATURES, ((kind, SETTINGS[kind]),)), panel)
        both = model.score(attribution.explained(model, panel)).select("explained", "probability").collect()
        for r in both:
            assert r["probability"] == pytest.approx(r["explained"] if kind == "forest" else 1 / (1 + np.exp(-r["explained"])), abs=1e-9)


def test_other_models_are_refused(panel):
    model = training.fit(Spec("m", FEATURES, (("logistic", {"maxIter": 5, "C": 1.0}),)), panel)
    with pytest.raises(ValueError, match="one tree part"):
        attribution.tree_attributions(model, panel, panel)

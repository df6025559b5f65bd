"""Stores, vendor payloads, merge, plans, models and streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.models import attribution, training
from quantloom.models.specs import SPECS, Spec, spec_of
from quantloom.operators import crosssection, merge, runs, technical
from quantloom.session import scratch_path
from quantloom.sources import store, vendor
from quantloom.streaming import jobs, sources

BAR = "ticker string, date date, open double, high double, low double, close double, volume long"


def bar(ticker, day, close):
    return (ticker, dt.date(2024, 1, day), close, close, close, close, 10)


def test_merge_new_row_wins_and_is_idempotent(spark):
    old = spark.createDataFrame([bar("A", 1, 1.0), bar("A", 2, 2.0)], BAR)
    new = spark.createDataFrame([bar("A", 2, 9.0), bar("A", 3, 3.0)], BAR)
    once = merge.merge_history(old, new)
    assert [r["close"] for r in once.orderBy("date").collect()] == [1.0, 9.0, 3.0]
    assert merge.merge_history(once, new).exceptAll(once).count() == 0
    assert merge.merge_history(None, new).count() == 2 and merge.merge_history(old, None).count() == 2
    with pytest.raises(ValueError):
        merge.merge_history(None, None)


def test_store_rules(spark):
    s = store.SliceStore(spark, scratch_path(spark, "t"), buckets=4)
    assert s.load("bars") is None and not s.exists("bars")
    with pytest.raises(ValueError, match="unknown slice"):
        s.load("prices")
    with pytest.raises(ValueError, match="empty"):
        s.save("bars", spark.createDataFrame([], BAR))
    with pytest.raises(ValueError, match="derived"):
        s.save("combined", spark.createDataFrame([bar("A", 1, 1.0)], BAR))
    s.save("bars", spark.createDataFrame([bar(t, d, 1.0) for t in "ABCDEFGH" for d in (1, 2)], BAR))
    s.merge("bars", spark.createDataFrame([bar("A", 2, 5.0), bar("Z", 1, 7.0)], BAR))
    assert s.load("bars").count() == 17 and s.exists("bars", "z")
    assert [r["close"] for r in s.load("bars", " a ").orderBy("date").collect()] == [1.0, 5.0]
    plan = s.load("bars", "A")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker_bucket" in plan and "EqualTo(ticker,A)" in plan


def test_news_reader_of_an_absent_folder_is_empty(spark):
    assert store.read_news(spark, scratch_path(spark, "nothing")).count() == 0


def test_news_payload_defaults(spark):
    payload = json.dumps([{"headline": "h", "datetime": 0, "summary": "s" * 5000}, {"source": "w"}])
    out = vendor.parse_news(spark.createDataFrame([("A", payload)], "ticker string, payload string"), "feed").orderBy("position").collect()
    assert out[0]["source"] == "unknown" and out[0]["published_at"] == "1970-01-01T00:00:00+00:00" and len(out[0]["content"]) == 5000
    assert out[1]["published_at"] == "" and out[1]["title"] == ""


def test_normalise_errors_and_prefixed_names(spark):
    with pytest.raises(ValueError, match="cannot map"):
        vendor.normalize_bars(spark.createDataFrame([("2024-01-01", "1")], "date string, close string"))
    raw = spark.createDataFrame([("2024-01-01", "1", "2", "1", "NaN", "7")], "`X.Date` string, `AAPL.Open` string, `AAPL.High` string, `AAPL.Low` string, `AAPL.Close` string, `AAPL.Volume` string")
    assert vendor.normalize_bars(raw, "aapl").count() == 0


def test_universe_text(spark):
    lines = spark.createDataFrame([("# c",), (" aapl, msft ,",), ("",), ("MSFT",)], "value string")
    assert [r[0] for r in vendor.universe_from_text(lines).collect()] == ["AAPL", "MSFT"]


def test_promotion_rules(spark):
    metric = "run_id string, model_id string, roc_auc double, f1 double, brier double"
    table = spark.createDataFrame(
        [
            ("champ", "m", 0.60, 0.50, 0.20), ("ok", "m", 0.61, 0.50, 0.20), ("flat", "m", 0.602, 0.9, 0.1), ("f1", "m", 0.70, 0.40, 0.20),
            ("brier", "m", 0.70, 0.50, 0.30), ("none", "m", None, None, None), ("half", "m", None, 0.5, None), ("new", "n", 0.5, 0.5, 0.5),
        ],
        metric,
    )
    now = runs.champions(spark.createDataFrame([("old", "m", 1), ("champ", "m", 2)], "run_id string, model_id string, promoted_at int"))
    assert now.first()["previous_run_id"] == "old"
    out = {r["run_id"]: (r["accepted"], r["reason"]) for r in runs.promotion_decisions(table, table, now).collect()}
    assert out["ok"] == (True, "candidate passes promotion policy")
    assert out["new"] == (True, "no current champion; accept first completed run")
    assert out["flat"][1].startswith("roc_auc improvement") and out["f1"][1].startswith("f1 regression") and out["brier"][1].startswith("brier increase")
    assert out["none"] == (False, "candidate run has no metrics") and out["half"] == (False, "missing roc_auc metric for policy comparison")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_panel_needs_one_exchange_for_all_features(spark, walk):
    path = scratch_path(spark, "bars")
    walk[0].write.parquet(path)
    features = technical.price_patterns(technical.technical(spark.read.parquet(path)))
    assert plan(features).count("Exchange hashpartitioning") == 1
    assert "ArrowEvalPython" not in plan(features) and "BatchEvalPython" not in plan(features)


def test_fixed_k_is_cut_before_the_shuffle(spark, walk):
    rows = walk[0].withColumn("score", F.col("close"))
    text = plan(crosssection.top_k(rows, ["date"], 3))
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_date_filter_and_columns_reach_the_scan(spark, sf_dir):
    from quantloom.plans.catalog import ENTRIES

    text = plan(ENTRIES["bars_between"].run(spark, sf_dir))
    assert "GreaterThanOrEqual(l_shipdate" in text and "l_tax" not in text


# --- models --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    n = 400
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    y = (a + 0.3 * b + rng.normal(0, 0.5, n) > 0.4).astype(int)
    rows = [(f"T{i % 20}", dt.date(2024, 1, 1) + dt.timedelta(i // 20), float(a[i]), float(b[i]) if i % 9 else None, int(y[i]), float(a[i])) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, a double, b double, target int, forward_return double").cache()


LIGHT = {"logistic": {"maxIter": 30, "C": 1.0}, "gbt": {"maxIter": 3, "maxDepth": 3, "stepSize": 0.1}, "forest": {"numTrees": 5, "maxDepth": 3}, "ranker": {"maxIter": 3, "maxDepth": 3, "stepSize": 0.1}}


@pytest.mark.parametrize("kind", list(LIGHT))
def test_models_score_in_range_and_separate(panel, kind):
    model = training.fit(Spec("m", ("a", "b"), ((kind, LIGHT[kind]),)), panel)
    out = model.score(panel).groupBy("target").agg(F.avg("probability").alias("p"), F.min("probability").alias("lo"), F.max("probability").alias("hi")).orderBy("target").collect()
    assert out[0]["p"] < out[1]["p"] and min(r["lo"] for r in out) >= 0 and max(r["hi"] for r in out) <= 1


def test_vote_is_the_mean_and_saving_keeps_scores(spark, panel):
    spec = Spec("vote", ("a", "b"), (("forest", LIGHT["forest"]), ("logistic", LIGHT["logistic"])))
    model = training.fit(spec, panel)
    singles = [training.FittedModel(Spec("x", spec.features, (part,)), [fitted]) for part, fitted in zip(spec.parts, model.parts, strict=True)]
    key = ["ticker", "date"]
    got = [m.score(panel).orderBy(*key).toPandas()["probability"].to_numpy() for m in (model, *singles)]
    assert np.allclose(got[0], (got[1] + got[2]) / 2)
    path = scratch_path(spark, "vote")
    model.save(path, spark)
    again = training.load_model(path, spark)
    assert again.spec.features == spec.features
    assert np.allclose(again.score(panel).orderBy(*key).toPandas()["probability"], got[0])


def test_calibration_statuses(panel):
    model = training.fit(Spec("m", ("a", "b"), (("logistic", LIGHT["logistic"]),)), panel)
    assert training.calibrate(model, panel).status["calibration"] == "isotonic_applied"
    assert training.calibrate(model, panel.limit(10)).status["calibration"] == "skipped_val_lt_50"
    assert training.calibrate(model, panel.filter("target = 1")).status["calibration"] == "skipped_single_class_in_val"


def test_missing_feature_and_unknown_model(panel):
    with pytest.raises(ValueError, match="lacks model features"):
        training.fit(Spec("m", ("zzz",), (("logistic", LIGHT["logistic"]),)), panel)
    with pytest.raises(ValueError, match="unknown model id"):
        spec_of("model_z")
    assert len(SPECS) == 8


def test_attributions_add_up(panel):
    model = training.fit(Spec("m", ("a", "b"), (("forest", LIGHT["forest"]),)), panel)
    rows = panel.filter("ticker = 'T1'")
    parts = attribution.permutation_attributions(model, rows, panel, permutations=5).groupBy("ticker", "date").agg(F.sum("value").alias("total"))
    base = attribution.background_mean(model, panel, permutations=5).first()["base_value"]
    both = model.score(rows).join(parts, ["ticker", "date"]).select("probability", "total").collect()
    assert both and all(abs(r["probability"] - base - r["total"]) < 1e-9 for r in both)


# --- streams -------------------------------------------------------------------------------------------------


def test_late_bar_replaces_and_replay_changes_nothing(spark):
    folder, s = scratch_path(spark, "ticks"), store.SliceStore(spark, scratch_path(spark, "s"), buckets=2)
    checkpoint = scratch_path(spark, "c")
    schema = "ts timestamp, ticker string, value double, event_id long"
    t = lambda day, hour: dt.datetime(2024, 1, day, hour)
    for rows in ([(t(1, 9), "A", 1.0, 1), (t(2, 9), "A", 2.0, 2)], [(t(1, 20), "A", 5.0, 3), (t(2, 10), "A", 3.0, 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.daily_bars(sources.file_stream(spark, folder, "*.parquet", schema), "3 days")
        jobs.merge_into_store(stream, s, checkpoint).awaitTermination()
    got = [(r["date"].day, r["open"], r["close"], r["volume"]) for r in s.load("bars").orderBy("date").collect()]
    assert got == [(1, 1.0, 5.0, 2), (2, 2.0, 3.0, 2)]
    before = s.load("bars").collect()
    s.merge("bars", s.load("bars"))
    assert sorted(map(str, s.load("bars").collect())) == sorted(map(str, before))


def test_a_table_in_many_files_streams_whole(spark):
    """A directory of files, newest event first: no row is late, and a single file gives the same."""
    rows = [(d, dt.datetime(2024, 1, 30 - d, 9), f"u{d % 5}") for d in range(20)]
    schema = "doc_id long, ts timestamp, url string"
    many, one = scratch_path(spark, "many"), scratch_path(spark, "one")
    for r in rows[:3], rows[3:]:
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{many}/news.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{one}/news")
    hadoop, path = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.hadoop.fs.Path
    fs = path(one).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(path(f"{one}/news")) if x.getPath().getName().startswith("part-"))
    hadoop.FileUtil.copy(fs, part, fs, path(f"{one}/news.parquet"), False, spark._jsc.hadoopConfiguration())
    for folder in (many, one):
        stream = sources.table_stream(spark, folder, "news.parquet", schema)
        kept = spark.read.parquet(sources.run_keyed(stream.withWatermark("ts", "3 days"), "whole", "append"))
        assert {r["doc_id"] for r in kept.collect()} == set(range(20))
        unique = jobs.drop_duplicate_articles(sources.table_stream(spark, folder, "news.parquet", schema))
        assert spark.read.parquet(sources.run_keyed(unique, "unique", "append")).count() == 5

"""Incremental refresh beside a whole rebuild, and commits that stop or collide."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.vocabulary import FUNDAMENTAL
from quantloom.operators import incremental, technical
from quantloom.plans import workflows
from quantloom.session import scratch_path
from quantloom.sources import manifest
from quantloom.sources.store import SliceStore

BAR = "ticker string, date date, open double, high double, low double, close double, volume long"
NEWS = "ticker string, day date, url string, score double, label string"
START = dt.date(2023, 1, 2)


def bars_of(spark, tickers, days, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        rows += [(t, START + dt.timedelta(days=i), float(c), float(c * 1.01), float(c * 0.99), float(c), int(v)) for i, (c, v) in enumerate(zip(close, rng.integers(1, 10**6, days), strict=True))]
    return spark.createDataFrame(rows, BAR)


def news_of(spark, rows):
    return spark.createDataFrame([(t, START + dt.timedelta(days=d), f"u{t}{d}{k}", s, "positive" if s > 0 else "negative") for k, (t, d, s) in enumerate(rows)], NEWS)


def snapshot_of(spark, **eps):
    return spark.createDataFrame([(t, e, None) for t, e in eps.items()], "ticker string, EPS string, PERatio string")


@pytest.fixture()
def store(spark):
    return SliceStore(spark, scratch_path(spark, "refresh-test"), buckets=4)


def day(i):
    return F.lit(START + dt.timedelta(days=i))


def same_rows(got, want):
    columns = sorted(want.columns)
    a, b = (df.select(*columns).orderBy("ticker", "date").toPandas() for df in (got, want))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c], rtol=1e-9, atol=1e-9, equal_nan=True), c
        else:
            assert a[c].tolist() == b[c].tolist(), c


def test_partial_refresh_equals_a_rebuild(spark, store):
    bars = bars_of(spark, ["A", "B", "C", "D"], 420)
    universe = bars.select("ticker").distinct()
    wrong = bars.withColumn("close", F.when((F.col("ticker") == "B") & (F.col("date") == day(310)), 1.0).otherwise(F.col("close")))
    workflows.refresh(store, universe, wrong.filter(F.col("date") < day(400)), snapshot_of(spark, A="1.0", B="2.0"), news_of(spark, [("A", 397, 0.5), ("C", 100, -0.5)]), "one")
    files = {n: set(store._manifests(n).latest()[1]["buckets"].items()) for n in ("bars", "technical", "state", "sentiment")}
    # B is corrected and continued, A continued, C sent again unchanged, D absent
    increment = bars.filter(((F.col("ticker") == "A") & (F.col("date") >= day(398))) | ((F.col("ticker") == "B") & (F.col("date") >= day(300))) | ((F.col("ticker") == "C") & (F.col("date") < day(400)) & (F.col("date") > day(390))))
    lineage = workflows.refresh(store, universe, increment, snapshot_of(spark, B="3.5"), news_of(spark, [("A", 397, 0.5), ("A", 399, -0.2)]), "two")
    assert {(r.ticker, r.status) for r in lineage.collect()} == {("A", "completed"), ("B", "completed"), ("C", "completed"), ("D", "failed")}
    known = bars.filter((F.col("date") < day(400)) | F.col("ticker").isin("A", "B"))
    same_rows(store.load("bars"), known)
    same_rows(store.load("technical"), technical.technical(known))
    ratios = {r.ticker: (r.lo, r.hi, r.n) for r in store.load("fundamental").groupBy("ticker").agg(F.min("eps").alias("lo"), F.max("eps").alias("hi"), F.count("eps").alias("n")).collect()}
    assert ratios["A"] == (1.0, 1.0, 420) and ratios["B"] == (3.5, 3.5, 420) and ratios["C"] == (None, None, 0)
    news = {(r.date - START).days: r for r in store.load("sentiment").filter("ticker = 'A' and news_count > 0").collect()}
    assert {d: r.news_count for d, r in news.items()} == {397: 1, 398: 1, 399: 2, 400: 1, 401: 1} and news[399].sentiment_score == pytest.approx(0.15)
    assert store.load("sentiment").filter("ticker = 'C' and news_count > 0").count() == 3  # old news stays
    touched = {str(b[0]) for b in spark.createDataFrame([("A",), ("B",)], "ticker string").select(store._bucket(F.col("ticker"))).collect()}
    for n in ("bars", "technical", "state"):
        kept = {b: v for b, v in store._manifests(n).latest()[1]["buckets"].items() if b not in touched}
        assert set(kept.items()) <= files[n] and len(kept) == len([b for b, _ in files[n] if b not in touched])


def test_untouched_buckets_are_not_read(spark, store):
    store.merge("bars", bars_of(spark, list("ABCDEFGH"), 3))
    some = spark.createDataFrame([("A",)], "ticker string")
    bucket = some.select(store._bucket(F.col("ticker"))).first()[0]
    assert {f.split("ticker_bucket=")[1].split("/")[0] for f in store.load_tickers("bars", some).inputFiles()} == {str(bucket)}


def test_same_bars_again_change_nothing(spark, store):
    bars = bars_of(spark, ["A", "B"], 40)
    args = (bars.select("ticker").distinct(), bars, snapshot_of(spark, A="1.0"), news_of(spark, [("A", 3, 0.1)]))
    workflows.refresh(store, *args, "one")
    before = {n: store._manifests(n).latest() for n in ("bars", "technical", "state", "articles", "fundamental")}
    workflows.refresh(store, *args, "two")
    assert {n: store._manifests(n).latest() for n in before} == before


def test_exponential_means_go_on_from_stored_state(spark):
    """One ticker per first changed day: before, at and after state rows, and far behind the last one."""
    cuts = {f"T{c}": c for c in (1, 63, 64, 65, 128, 250)}
    bars = bars_of(spark, list(cuts), 260, seed=3)
    whole = technical.technical(bars)
    start = spark.createDataFrame([(t, START) for t in cuts], "ticker string, first date")
    state = incremental.split_state(incremental.technical_from(bars, start, None))[1].cache()
    first = spark.createDataFrame([(t, START + dt.timedelta(days=c)) for t, c in cuts.items()], "ticker string, first date")
    rows, again = incremental.split_state(incremental.technical_from(bars, first, state))
    later = F.col("date") >= F.col("first")
    same_rows(rows, whole.join(first, "ticker").filter(later).drop("first"))
    assert {r.bars for r in state.collect()} == {64, 128, 192, 256, 260}
    assert {(r.ticker, r.bars, r.date) for r in again.collect()} == {(r.ticker, r.bars, r.date) for r in state.join(first, "ticker").filter(later).collect()}


def test_first_changes(spark):
    old = spark.createDataFrame([("A", START, 1.0, None), ("A", START + dt.timedelta(1), 2.0, 5), ("B", START, 1.0, 1)], "ticker string, date date, close double, volume long")
    new = spark.createDataFrame(
        [("A", START, 1.0, None), ("A", START + dt.timedelta(1), 2.0, 6), ("A", START + dt.timedelta(2), 2.0, 6), ("B", START, 1.0, 1), ("C", START, None, None)],
        "ticker string, date date, close double, volume int",
    )
    got = {r.ticker: (r["first"] - START).days for r in incremental.first_changes(old, new).collect()}
    assert got == {"A": 1, "C": 0}
    assert {r.ticker for r in incremental.first_changes(None, new).collect()} == {"A", "B", "C"}
    assert incremental.first_changes(old, new.limit(0)).count() == 0


def test_a_writer_that_stops_before_the_commit_changes_nothing(spark, store, monkeypatch):
    store.save("bars", bars_of(spark, ["A", "B"], 2))
    before = sorted(map(str, store.load("bars").collect()))

    def stop(self, number, content):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(manifest.Manifests, "add", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            store.merge("bars", bars_of(spark, ["A", "Z"], 9, seed=2))
    assert sorted(map(str, store.load("bars").collect())) == before
    assert store.drop_old_versions("bars") == 1 and sorted(map(str, store.load("bars").collect())) == before
    store.merge("bars", bars_of(spark, ["Z"], 1))
    assert {r.ticker for r in store.tickers().collect()} == {"A", "B", "Z"}


def test_two_savers_lose_no_rows(spark, store, monkeypatch):
    """The second writer has read its base when the first one commits."""
    store.save("bars", bars_of(spark, ["A"], 2))
    add, other = manifest.Manifests.add, SliceStore(spark, store.root, store.buckets)
    started = []

    def slow(self, number, content):
        if not started:
            started.append(number)
            other.merge("bars", bars_of(spark, ["A", "E"], 3, seed=5))
        add(self, number, content)

    monkeypatch.setattr(manifest.Manifests, "add", slow)
    store.merge("bars", bars_of(spark, ["I", "M"], 4, seed=6))
    assert {(r.ticker, r["count"]) for r in store.load("bars").groupBy("ticker").count().collect()} == {("A", 3), ("E", 3), ("I", 4), ("M", 4)}
    folder = manifest.Manifests(spark, f"{store.path('bars')}/manifest")
    with pytest.raises(manifest.CommitConflict):
        folder.add(1, {})


def test_a_column_added_later_reads_null_in_older_rows(spark, store):
    store.merge("bars", bars_of(spark, ["A"], 2))
    store.merge("bars", bars_of(spark, ["Z"], 1).withColumn("adjusted", F.lit(1.0)))
    assert {(r.ticker, r.adjusted) for r in store.load("bars").collect()} == {("A", None), ("Z", 1.0)}


def test_snapshot_without_a_ratio_keeps_the_stored_one(spark):
    dates = spark.createDataFrame([("A", START), ("A", START + dt.timedelta(1)), ("B", START)], "ticker string, date date")
    first = spark.createDataFrame([("A", START + dt.timedelta(1))], "ticker string, first date")
    blank = [F.lit(None).cast("double").alias(c) for c in FUNDAMENTAL if c not in ("eps", "roe")]
    stored = spark.createDataFrame([("A", START, 1.0, 0.5), ("B", START, 2.0, 0.1)], "ticker string, date date, eps double, roe double").select("*", *blank)
    ratios = spark.createDataFrame([("A", None, 0.7)], "ticker string, eps double, roe double").select("*", *blank)
    got = {(r.ticker, (r.date - START).days): (r.eps, r.roe) for r in incremental.fundamental_changes(dates, stored, ratios, first).collect()}
    assert got == {("A", 0): (1.0, 0.7), ("A", 1): (1.0, 0.7)}
    carried = incremental.fundamental_changes(dates, stored, ratios.limit(0), first).collect()
    assert [(r.ticker, r.eps, r.roe) for r in carried] == [("A", 1.0, 0.5)]

"""Edge rows: partial saves, first merges, missing scores, infinite losses, NULL group keys."""

import datetime as dt

import pytest

from quantloom.operators import inference, metrics, ordering
from quantloom.session import scratch_path
from quantloom.sources.store import SliceStore

DAY = dt.date(2024, 1, 2)


def test_saving_some_tickers_keeps_the_others(spark):
    store = SliceStore(spark, scratch_path(spark, "edge-store"), buckets=1)
    rows = lambda *t: spark.createDataFrame([(x, DAY, v) for x, v in t], "ticker string, date date, close double")
    store.save("bars", rows(("A", 1.0), ("B", 2.0)))
    store.save("bars", rows(("A", 3.0)))
    assert {(r.ticker, r.close) for r in store.load("bars").collect()} == {("A", 3.0), ("B", 2.0)}


def test_first_merge_keeps_one_row_per_day(spark):
    store = SliceStore(spark, scratch_path(spark, "edge-merge"), buckets=1)
    store.merge("bars", spark.createDataFrame([("A", DAY, 1.0), ("A", DAY, 2.0)], "ticker string, date date, close double"))
    assert store.load("bars").count() == 1


def test_rows_without_score_do_not_count(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (None, 1), (None, 0)], "score double, target int")
    assert metrics.classification(df, []).first()["accuracy"] == 0.5
    assert sum(r["count"] for r in metrics.reliability(df, []).collect()) == 2


def test_infinite_losses_are_left_out(spark):
    rows = [(DAY + dt.timedelta(days=k), float(k % 3), 1.0) for k in range(10)] + [(DAY + dt.timedelta(days=20), float("inf"), 1.0)]
    row = inference.diebold_mariano(spark.createDataFrame(rows, "date date, a double, b double"), "a", "b").first()
    assert row["mean_d"] == pytest.approx(sum(k % 3 - 1 for k in range(10)) / 10)


def test_null_keys_rank_alike_in_both_ways(spark):
    df = spark.createDataFrame([(None if k < 5 else "g", float(k)) for k in range(12)], "g string, v double")
    small = ordering.average_ranks(df, ["g"], {"v": "r"}).collect()
    large = ordering.average_ranks(df, ["g"], {"v": "r"}, max_group_rows=2).collect()
    assert sorted((r.v, r.r) for r in small) == sorted((r.v, r.r) for r in large)

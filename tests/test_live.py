"""Live indicators: corrections, late bars, replays and expiry beside the batch result."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quantloom.session import scratch_path
from quantloom.streaming import jobs, sources

SCHEMA = "ticker string, date date, close double"
START = dt.date(2024, 1, 1)


def fed(spark, batches, **options):
    """Rows that the stream gives, batch by batch, from one checkpoint."""
    folder, checkpoint = scratch_path(spark, "live"), scratch_path(spark, "live-checkpoint")
    out = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.live_indicators(sources.file_stream(spark, folder, "*.parquet", SCHEMA), **options)
        got = []
        query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _, got=got: got.extend(df.collect())).start()
        query.awaitTermination()
        out.append({r.ticker: r for r in got})
    return out


def expected(closes):
    s = pd.Series(closes)
    fast, slow = (s.ewm(span=k, adjust=False).mean().iloc[-1] for k in (12, 26))
    return closes[-1], fast, slow, fast - slow


def bar(t, d, x):
    return (t, START + dt.timedelta(days=d), x)


def test_corrections_and_late_bars_equal_the_batch_result(spark):
    rng = np.random.default_rng(4)
    closes = {t: (50 * np.exp(np.cumsum(rng.normal(0, 0.02, 40)))).tolist() for t in "AB"}
    first = [bar(t, d, x) for t in "AB" for d, x in enumerate(closes[t][:30]) if not (t == "A" and d == 27)]  # one bar of A is late
    wrong = [bar("A", 25, 1.0) if r == bar("A", 25, closes["A"][25]) else r for r in first]
    later = [bar("A", 25, closes["A"][25]), bar("A", 27, closes["A"][27]), *[bar("A", d, closes["A"][d]) for d in range(30, 40)], bar("B", 3, 999.0), bar("B", 29, closes["B"][29]), bar("B", 30, None)]
    one, two = fed(spark, [wrong, later], ring=8)
    assert one["A"].n == 29 and one["B"].n == 30
    a, b = two["A"], two["B"]
    assert (a.last, a.ema12, a.ema26, a.macd) == pytest.approx(expected(closes["A"])) and a.n == 40 and a.date == START + dt.timedelta(days=39)
    # too late for the ring, a replay and a missing close change nothing
    assert (b.last, b.ema12, b.ema26, b.macd) == pytest.approx(expected(closes["B"][:30])) and b.n == 30


def test_ring_of_one_bar(spark):
    one, two = fed(spark, [[bar("A", 0, 10.0), bar("A", 1, 11.0)], [bar("A", 1, 12.0), bar("A", 0, 99.0)]], ring=1)
    assert one["A"].n == two["A"].n == 2
    assert (two["A"].last, two["A"].ema12, two["A"].ema26, two["A"].macd) == pytest.approx(expected([10.0, 12.0]))


class State:
    """A stand-in for the engine's state of one ticker."""

    def __init__(self, timed_out=False):
        self.hasTimedOut, self.exists, self.get, self.timeout = timed_out, False, None, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_state_is_bounded_and_expires():
    state = State()
    for d in range(100):
        rows = list(jobs._advance(4, 86_400_000, ("A",), iter([pd.DataFrame({"date": [START + dt.timedelta(days=d)], "close": [float(d)]})]), state))
    assert rows[0]["n"].item() == 100 and len(state.get[4]) == len(state.get[5]) == 4 and state.timeout == 86_400_000
    state.hasTimedOut = True
    assert list(jobs._advance(4, 86_400_000, ("A",), iter([]), state)) == [] and not state.exists
    assert list(jobs._advance(4, 0, ("B",), iter([pd.DataFrame({"date": [START], "close": [np.nan]})]), State())) == []

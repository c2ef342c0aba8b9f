"""Streams whose keys share calls and states by buckets, against folds of one key at a time."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.plans import catalog
from shelfmark.streaming import keyed as K


class Handle:
    """A value and a timer, and how often they were asked for."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def test_a_bucket_of_jobs_is_one_call():
    rng = np.random.default_rng(1)
    processor, handle = started(K._Admitted(60, ["job_id", "n"]))
    active, want, got = {}, set(), set()
    for part in range(4):
        rows = [(f"j{j}", 1000 * part + i, None, int(s), bool(r), bool(a), int(ms), f"=j{j}", 3) for i, (j, s, r, a, ms) in enumerate(zip(rng.integers(0, 40, 300), rng.integers(0, 9, 300), rng.integers(0, 2, 300), rng.integers(0, 2, 300), rng.integers(900 * part, 900 * part + 1000, 300), strict=True))]
        rows = [r[:5] + (r[5] and not r[4],) + r[6:] for r in rows]
        for job, n, _, seq, request, runs, ms, *_ in sorted(rows, key=lambda r: (r[6], r[3])):
            last = active.get(job)
            if request and not (last and ms - last[0] <= 60):
                want.add(n)
            if last is None or (ms, seq) >= last:
                active[job] = (ms, seq)
                if not (request or runs):
                    active[job] = None
        active = {j: x for j, x in active.items() if x}
        pdf = pd.DataFrame(rows, columns=["job_id", "n", "_time", "_seq", "_request", "_runs", "_ms", "_key", "_bucket"])
        for out in processor.handleInputRows((3,), iter([pdf[:100], pdf[100:100], pdf[100:]]), None):
            got |= set(out["n"])
        assert handle.timers == ([min(x[0] for x in active.values()) + 61] if active else [])
    assert got == want and handle.calls <= 2 * 4
    end = max(x[0] for x in active.values()) + 62
    assert list(processor.handleExpiredTimer((3,), At(end), At(handle.timers[0]))) == [] and handle.value is None and not handle.timers


def test_a_bucket_of_ids_is_one_call():
    rng = np.random.default_rng(2)
    processor, handle = started(K._After(["id", "n"]))
    rows = lambda n, m: pd.DataFrame({"_key": [f"=i{k}" for k in rng.integers(0, 30, m)], "_us": rng.integers(n, n + 50, m), "_seq": rng.integers(0, 5, m), "_bucket": 1})
    last = {}
    start = rows(0, 60)
    for some in (start[:40], start[40:]):
        processor.handleInitialState((1,), some, None)
    for k, us, seq, _ in start.itertuples(index=False):
        last[k] = max(last.get(k, (K.NEVER, K.NEVER)), (us, seq))
    got, want = [], []
    for part in range(3):
        pdf = rows(20 * part, 200)
        pdf = pd.concat([pd.DataFrame({"id": pdf["_key"].str[1:], "n": 1000 * part + np.arange(200)}), pdf[["_us", "_seq", "_key", "_bucket"]]], axis=1)
        want += [r.n for r in pdf.itertuples() if (r._3, r._4) > last.get(r._5, (K.NEVER, K.NEVER))]
        for r in pdf.itertuples():
            last[r._5] = max(last.get(r._5, (K.NEVER, K.NEVER)), (r._3, r._4))
        for out in processor.handleInputRows((1,), iter([pdf[:80], pdf[80:]]), None):
            assert list(out.columns) == ["id", "n"]
            got += out["n"].tolist()
    assert got == want and len(want) > 50 and handle.calls <= 4 + 2 * 3


def test_a_bucket_of_feeds_is_told_by_one_timer():
    processor, handle = started(K._Silent(10))
    rows = pd.DataFrame([("a", None, 0, "=a", 0), ("a", None, 20, "=a", 0), ("b", None, 5, "=b", 0), (None, None, 30, "", 0)], columns=["feed", "_time", "_ms", "_key", "_bucket"])
    flat = lambda frames: sorted((k, t) for x in frames for k, t in zip(x["_key"], x["last_ms"], strict=True))
    assert flat(processor.handleInputRows((0,), iter([rows]), None)) == [("=a", 0)] and handle.timers == [15]
    handle.timers = []  # Spark drops a timer that fires
    assert flat(processor.handleExpiredTimer((0,), At(16), At(15))) == [("=b", 5)] and handle.timers == [30]
    more = pd.DataFrame([("b", None, 4, "=b", 0), ("b", None, 40, "=b", 0), ("a", None, 29, "=a", 0)], columns=rows.columns)
    assert flat(processor.handleInputRows((0,), iter([more]), None)) == [] and handle.timers == [39]
    handle.timers = []
    assert flat(processor.handleExpiredTimer((0,), At(60), At(39))) == [("", 30), ("=a", 29), ("=b", 40)] and handle.timers == []


@pytest.mark.parametrize("first", [0, 1 << 60])
def test_no_event_is_late_where_numbers_do_not_follow_the_time(spark, tmp_path, first):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(first + 40 * k + i, t0 + dt.timedelta(hours=18 * i + k), k * 3 + i % 3, ["view", "click", "purchase", "error"][i % 4], 1.5, "") for k in range(3) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    for stream, batch in (("admitted_stream", "admitted_requests"), ("silent_stream", "silent_feeds")):
        got, want = (sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect())) for name in (stream, batch))
        assert got == want and len(want) > 30


def test_keys_come_back_from_their_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("=",), ("x y",)], "feed string")
    dealt = K._dealt(df, F.col("feed"))
    assert all(r.feed == r.back for r in dealt.withColumn("back", K._undealt(F.col("_key"))).collect())
    assert dealt.filter("_key IS NULL OR _bucket < 0").count() == 0 and dealt.select("_key").distinct().count() == 4

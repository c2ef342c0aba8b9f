"""Streams against their batch twins."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators.logs import collapse_logs
from shelfmark.operators.sequences import numbered_runs, spaced, with_before
from shelfmark.streaming import jobs as SJ
from shelfmark.streaming import keyed as K
from shelfmark.streaming import state as S
from shelfmark.streaming.versions import VersionedTable

T0 = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path, df, parts):
    """A file stream of df, a file a micro-batch, in order of seq."""
    folder = str(tmp_path / "in")
    for i in range(parts):
        df.filter(F.col("seq") % parts == i).coalesce(1).write.mode("append").parquet(folder) if parts == 1 else df.filter((F.col("seq") >= i * 10) & (F.col("seq") < (i + 1) * 10)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, tmp_path, mode):
    name = f"t{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_alert_cooldown(spark, tmp_path):
    minutes = [0, 29, 30, 45, 60, 95]
    df = spark.createDataFrame([("h", T0 + dt.timedelta(minutes=m), i, 480, 500) for i, m in enumerate(minutes)] + [("h", T0, 9, 100, 500)], "host string, ts timestamp, seq long, heap_used_mb long, heap_total_mb long")
    want = {0, 2, 4, 5}
    assert {r.seq for r in S.alerts(df).collect()} == want
    assert {r.seq for r in drain(S.alerts(feed(spark, tmp_path, df, 1)), tmp_path, "append")} == want


def test_collapse(spark, tmp_path):
    words, sources = "a a b a a a c a a b b".split(), "s s s s t t s s s s s".split()
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), "info", s, w, None) for i, (w, s) in enumerate(zip(words, sources, strict=True))], "seq long, time timestamp, level string, source string, message string, job_id string")
    want = [("a", "s", 2), ("b", "s", 1), ("a", "s", 1), ("a", "t", 2), ("c", "s", 1), ("a", "s", 2), ("b", "s", 2)]
    assert [(r.message, r.source, r.repeats) for r in sorted(collapse_logs(df).collect(), key=lambda r: r.seq)] == want
    path = str(tmp_path / "runs")
    S.collapse_into(feed(spark, tmp_path, df, 2), path, str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.message, r.source, r.repeats) for r in sorted(S.read_runs(spark, path).collect(), key=lambda r: r.seq)] == want


def test_latest(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i % 3), "running" if i < 6 else "completed", i, T0 + dt.timedelta(seconds=i)) for i in range(9)], "seq long, id string, status string, images long, updated_at timestamp")
    want = {(r.id, r.status, r.images) for r in SJ.latest(df).collect()}
    assert want == {(str(k), "completed", 6 + k) for k in range(3)}
    seen = []
    q = S.upsert_latest(feed(spark, tmp_path, df, 1), str(tmp_path / "table"), str(tmp_path / "cp"), lambda t: seen.append(SJ.live_overview(t).first().completed))
    q.awaitTermination(120)
    assert seen[-1] == 3
    assert {(r.id, r.status, r.images) for r in S.read_latest(spark, str(tmp_path / "table")).collect()} == want
    snapshot = SJ.latest(df.filter("seq < 7"))
    assert {(r.id, r.images, r.origin) for r in SJ.snapshot_then(snapshot, df).collect()} == {("0", 6, 0), ("1", 7, 1), ("2", 8, 1)}


def test_overdue(spark, tmp_path):
    m = 60_000
    df = spark.createDataFrame([("a", "running", 0, 0), ("a", "running", 50 * m, 1), ("a", "completed", 60 * m, 2), ("b", "running", 0, 3), ("b", "completed", 40 * m, 4), ("b", "running", 50 * m, 5)], "id string, status string, ms long, seq long")
    want = {("a", 0, 45 * m)}
    assert {tuple(r) for r in S.overdue_stream(df).collect()} == want
    assert {tuple(r) for r in S.overdue_stream(df, now_ms=96 * m).collect()} == want | {("b", 50 * m, 95 * m)}
    assert {tuple(r) for r in drain(S.overdue_stream(feed(spark, tmp_path, df, 1)), tmp_path, "append")} == want


def test_log_tail_and_dedup(spark, tmp_path):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), "info", "s", str(i), None) for i in range(30)], "seq long, time timestamp, level string, source string, message string, job_id string")
    S.log_tail(feed(spark, tmp_path, df, 3), str(tmp_path / "tail"), str(tmp_path / "cp"), 12).awaitTermination(120)
    assert {r.seq for r in S.read_tail(spark, str(tmp_path / "tail"), 12).collect()} == set(range(18, 30))
    table = VersionedTable(spark, str(tmp_path / "tail"), "ring").read()
    assert table.groupBy("ring").count().agg(F.max("count")).first()[0] <= 12
    r = spark.createDataFrame([(0, "x", T0), (1, "x", T0), (2, "y", T0)], "seq long, job_id string, requested_at timestamp")
    assert {x.seq for x in K.requests_once(r).collect()} == {0, 2}


def spaced_fold(rows, gap):
    last, out = {}, set()
    for k, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            out.add(i)
    return out


@pytest.mark.parametrize("gap", [7, 1000])
def test_spaced_is_the_fold(spark, gap):
    rng = np.random.default_rng(gap)
    rows = [([None, "a", "b", "hot", "hot"][k], int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 5, 500), rng.integers(-200, 1500, 500), strict=True))]
    rows += [("hot", t, 1000 + t) for t in range(0, 200)] + [("a", None, 9000), ("one", 5, 9001), ("tie", 5, 9002), ("tie", 5, 9003)]
    df = spark.createDataFrame(rows, "key string, ms long, seq long").repartition(3)
    got = spaced(df, "key", "ms", "seq", gap)
    assert got.columns == df.columns and sorted(r.seq for r in got.collect()) == sorted(spaced_fold(rows, gap))
    assert {r.seq for r in S.throttle(df, gap).collect()} == spaced_fold(rows, gap)
    assert spaced(df.limit(0), "key", "ms", "seq", gap).count() == 0


def test_throttle_on_a_stream_has_null_keys_too(spark, tmp_path):
    rows = [(None if i % 3 else "k", i * 4 % 50, i) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, ms long, seq long")
    assert {r.seq for r in drain(S.throttle(feed(spark, tmp_path, df, 1), 13), tmp_path, "append")} == spaced_fold(rows, 13) == {r.seq for r in S.throttle(df, 13).collect()}


def test_rows_before_and_runs_with_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("b", 5)], "k string, i long").repartition(3)
    assert [(r.i, r._before and r._before.i) for r in sorted(with_before(df, ["k", "i"]).collect(), key=lambda r: r.i)] == [(1, None), (2, 1), (3, 2), (4, 3), (5, 4)]
    runs = numbered_runs(df, ["k", "i"], lambda before: ~F.col("k").eqNullSafe(before["k"]))
    assert [(r.i, r.run) for r in sorted(runs.collect(), key=lambda r: r.i)] == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]
    assert numbered_runs(df.limit(0), ["k", "i"], lambda before: F.lit(True)).count() == 0


UPDATE = "id string, updated_at timestamp, seq long, status string, images long, products array<string>, deleted boolean"


def partial(lines, folder, name):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(x) for x in lines))


def test_fields_merge_by_presence(spark, tmp_path):
    at = lambda s: f"2024-01-01T00:00:{s:02d}Z"
    batches = [
        [{"id": "a", "updated_at": at(1), "seq": 1, "status": "queued", "images": 4, "products": ["p"]}, {"id": "b", "updated_at": at(1), "seq": 2, "status": "running"}, {"id": "c", "updated_at": at(1), "seq": 3, "images": 1}],
        [{"id": "a", "updated_at": at(5), "seq": 4, "images": None}, {"id": "a", "updated_at": at(5), "seq": 5, "products": None}, {"id": "b", "updated_at": at(2), "seq": 6, "deleted": True}],
        [{"id": "a", "updated_at": at(3), "seq": 7, "status": "running", "images": 9}, {"id": "b", "updated_at": at(9), "seq": 8, "status": "completed"}, {"id": "c", "updated_at": at(1), "seq": 2, "images": 7, "status": "late"}],
        [{"id": None, "updated_at": at(1), "seq": 9, "status": "x"}, {"updated_at": at(1), "seq": 10, "images": 2}],
    ]
    want = {("a", "running", None, ("p",)), ("c", "late", 1, None), (None, "x", 2, None)}
    rows = lambda df: {(r.id, r.status, r.images, tuple(r.products) if r.products else None) for r in df.collect()}
    for i, lines in enumerate(batches):
        partial(lines, tmp_path / "in", f"{i}.json")
    every = SJ.read_partial_updates(spark, str(tmp_path / "in"), UPDATE)
    assert rows(SJ.latest_fields(every)) == want and SJ.latest_fields(every.limit(0)).count() == 0
    table, checkpoint, seen = str(tmp_path / "table"), str(tmp_path / "cp"), []
    assert S.read_latest(spark, table).count() == 0
    for i, lines in enumerate(batches):
        partial(lines, tmp_path / "live", f"{i}.json")
        S.upsert_latest(SJ.read_partial_updates(spark, str(tmp_path / "live"), UPDATE, stream=True), table, checkpoint, lambda t: seen.append(t.count()), buckets=2).awaitTermination(120)
    assert rows(S.read_latest(spark, table)) == want and seen == [3, 2, 2, 3]


def test_versions_grow_and_repeat(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "id", 2, bucket_rows=10)
    most = lambda df: df.groupBy("id").agg(F.max("n").alias("n"))
    rows = lambda n, v: spark.range(n).select(F.col("id"), F.lit(v).alias("n"))
    for number, (n, v) in enumerate([(30, 1), (5, 2), (5, 0), (1, 9), (0, 0)]):
        table.merge(rows(n, v), number, most)
        if number == 3:
            table.merge(rows(n, v), number, most)  # again, as after a failure
    assert {(r.id, r.n) for r in table.read().collect()} == {(0, 9), *((i, 2) for i in range(1, 5)), *((i, 1) for i in range(5, 30))}
    assert table.version()["buckets"] == 4
    assert len(list((tmp_path / "t").glob("batch-*/bucket=*"))) <= 2 * 4
    assert len(list((tmp_path / "t").glob("version-*.json"))) == 2


def test_catching_up_repeats_nothing(spark, tmp_path):
    row = lambda i, t, seq: (i, T0 + dt.timedelta(seconds=t) if t is not None else None, seq, f"s{seq}")
    schema = "id string, updated_at timestamp, seq long, status string"
    snapshot = spark.createDataFrame([row("a", 5, 5), row("b", 1, 1), row(None, 3, 3)], schema)
    parts = [[row("a", 4, 4), row("a", 5, 5), row("a", 6, 6), row("c", 0, 0)], [row("a", 6, 6), row("b", 1, 2), row(None, 2, 9), row(None, 3, 4)], [row("a", None, 7), row("c", 0, 0), row("c", 0, 1), row("d", None, 8)]]
    out, folder = str(tmp_path / "out"), str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        live = spark.readStream.schema(snapshot.schema).parquet(folder)
        SJ.catch_up(snapshot, live, out, str(tmp_path / "cp")).awaitTermination(120)
    got = [(r.id, r.seq, r.origin) for r in SJ.caught_up(spark, out, snapshot.schema).collect()]
    assert sorted(got, key=str) == sorted([("a", 5, 0), ("b", 1, 0), (None, 3, 0), ("a", 6, 1), ("c", 0, 1), ("b", 2, 1), (None, 4, 1), ("c", 1, 1), ("d", 8, 1)], key=str)


def test_requests_pass_again_when_the_job_is_done(spark, tmp_path):
    minute = lambda m: T0 + dt.timedelta(minutes=m) if m is not None else None
    asked = [("a", 0, 0), ("a", 2, 1), ("a", 4, 12), ("a", 6, 13), ("b", 8, 20), ("b", 10, 90), ("c", 12, 95), (None, 14, 96), (None, 16, 97), ("d", 18, None), ("b", 20, 151)]
    told = [("a", 3, 10, "completed"), ("a", 5, 13, "paused"), ("c", 11, 94, "running"), ("b", 19, 100, None), ("e", 21, 152, "failed")]
    requests = spark.createDataFrame([(j, s, minute(m)) for j, s, m in asked], "job_id string, seq long, requested_at timestamp")
    updates = spark.createDataFrame([(j, s, minute(m), x) for j, s, m, x in told], "id string, seq long, updated_at timestamp, status string")
    want = {0, 4, 8, 10, 14, 20}
    assert {r.seq for r in K.admitted_requests(requests, updates, 60).collect()} == want
    streams = []
    for name, df in (("r", requests), ("u", updates)):
        for lo in range(0, 24, 8):
            df.filter(f"seq >= {lo} AND seq < {lo + 8}").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    out = K.admitted_requests(*streams, 60, "1 day")
    assert out.columns == requests.columns and {r.seq for r in drain(out, tmp_path, "append")} == want


def test_a_silent_feed_is_told_each_time(spark, tmp_path):
    rows = [(0, "a", 0), (1, "b", 0), (2, "b", 5), (10, "b", 12), (11, "b", 18), (20, "a", 20), (21, "b", 24), (22, None, 24), (23, "b", 30), (24, "b", 36), (25, "b", 33)]
    df = spark.createDataFrame([(s, f, T0 + dt.timedelta(seconds=t)) for s, f, t in rows] + [(26, "z", None)], "seq long, feed string, time timestamp")
    ms = int(T0.replace(tzinfo=dt.UTC).timestamp()) * 1000
    want = {("a", 0), ("a", 20), (None, 24)}
    twin = lambda rows: sorted(((r.feed, (r.last_ms - ms) // 1000) for r in rows), key=str)
    assert twin(K.silent_feeds(df, 7).collect()) == sorted(want, key=str)
    assert twin(drain(K.silent_feeds(feed(spark, tmp_path, df, 3), 7), tmp_path, "append")) == sorted(want, key=str)
    assert K.silent_feeds(df.limit(0), 7).count() == 0
    assert {r.feed for r in K.silent_feeds(df, 7, now_ms=ms + 60_000).collect()} == {"a", "b", None}

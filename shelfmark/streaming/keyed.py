"""Streams with a state for each key: events after a snapshot, requests of jobs that aren't active, feeds that fall silent, rings of the last entries.

Each takes a batch too, with the same rows. Null keys are one key. State is kept in RocksDB, below the query's checkpoint, in a table for each bucket of keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType

from shelfmark.functions.values import ACTIVE
from shelfmark.operators.sequences import with_before
from shelfmark.shared import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = -(1 << 62)
#: Keys of a stream share so many calls and states; a checkpoint holds for one number only.
BUCKETS = 256


def _named(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The chunks that have rows, under the names of their columns: from the second micro-batch on computed columns come without."""
    return (pdf.set_axis(columns, axis=1) for pdf in rows if len(pdf))


def _stateful(df: DataFrame) -> None:
    """Queries of this session that start from now on keep their state in RocksDB, as keyed processors need it. The processors are sent whole: what sets them up on the driver may not find this package."""
    ship(df.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _us(time: Column) -> Column:
    return F.coalesce(F.unix_micros(time.cast("timestamp")), F.lit(NEVER))


def _dealt(df: DataFrame, key: Column) -> DataFrame:
    """df with `_key`, the key as a text that is never null (see _undealt), and `_bucket`, its hash among BUCKETS."""
    return df.withColumn("_key", F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int"))


def _undealt(key: Column) -> Column:
    """The key, as a string, that _dealt made a text of."""
    return F.when(key != "", key.substr(F.lit(2), F.length(key)))


def _as_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the longs among columns as texts: in pandas a column that has nulls is one of doubles, which round them."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns if df.schema[c].dataType == LongType()})


def _as_before(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType) if f.dataType == LongType() else F.col(f.name) for f in schema])


class _Bucketed(StatefulProcessor):
    """What is known of all keys of a bucket, as one table in one value.

    A call for each key costs milliseconds, whatever it has to do. So keys share BUCKETS of them, and a bucket's rows are folded as columns."""

    known_of: dict[str, type]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "rows binary")

    def held(self) -> pd.DataFrame:
        found = self.known.get()
        if found is None:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in self.known_of.items()})
        return pa.ipc.open_stream(bytes(found[0])).read_pandas()

    def hold(self, rows: pd.DataFrame) -> None:
        if not len(rows):
            self.known.clear()
            return
        sink, data = pa.BufferOutputStream(), pa.Table.from_pandas(rows[list(self.known_of)], preserve_index=False)
        with pa.ipc.new_stream(sink, data.schema) as out:
            out.write_table(data)
        self.known.update((sink.getvalue().to_pybytes(),))

    def wake(self, times: np.ndarray) -> None:
        """The bucket's only timer, at the first of times."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(times):
            self.handle.registerTimer(int(times.min()))

    def close(self) -> None:
        pass


def _due(times: np.ndarray, timerValues, expiredTimerInfo) -> np.ndarray:
    """Which of times have passed, now that a timer has fired."""
    return times <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)


class _After(_Bucketed):
    """Rows that come after all earlier ones of their key; known is the last (us, seq) of each."""

    known_of = {"_key": object, "_us": np.int64, "_seq": np.int64}

    def __init__(self, columns: list[str]):
        self.columns = columns

    def _newest(self, *rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([r[list(self.known_of)] for r in rows if len(r)]).sort_values(["_us", "_seq"]).drop_duplicates("_key", keep="last")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.hold(self._newest(self.held(), initialState))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = last = self.held()
        index, us0, seq0 = pd.Index(before["_key"]), np.append(before["_us"].to_numpy(np.int64), NEVER), np.append(before["_seq"].to_numpy(np.int64), NEVER)
        for pdf in _named(rows, [*self.columns, "_us", "_seq", "_key", "_bucket"]):
            at = index.get_indexer(pdf["_key"])  # -1, the last: NEVER
            us, seq = pdf["_us"].to_numpy(), pdf["_seq"].to_numpy()
            last = self._newest(last, pdf)
            yield pdf[(us > us0[at]) | ((us == us0[at]) & (seq > seq0[at]))][self.columns]
        if last is not before:
            self.hold(last)


def later_rows(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """live, a stream (id, updated_at, seq, ...), without the rows that do not come after the snapshot's row of their id, or after what a micro-batch before has had.

    The state of each id begins with the snapshot's newest (updated_at, seq), so that what was sent while the snapshot was taken
    passes once. A null updated_at comes before all times."""
    _stateful(live)
    order = {"_us": _us(F.col("updated_at")), "_seq": F.coalesce(F.col("seq").cast("long"), F.lit(NEVER))}
    start = _dealt(snapshot.select("id", "updated_at", "seq").withColumns(order), F.col("id")).select("_key", "_us", "_seq", "_bucket")
    rows = _as_texts(_dealt(live.withColumns(order), F.col("id")), live.columns)
    out = rows.groupBy("_bucket").transformWithStateInPandas(_After(live.columns), _as_texts(live, live.columns).schema, "append", "none", initialState=start.groupBy("_bucket"))
    return _as_before(out, live.schema)


class _Admitted(_Bucketed):
    """Requests of jobs that aren't active; known are the active jobs, and since when nothing was heard of each."""

    known_of = {"_key": object, "_ms": np.int64, "_seq": np.int64}

    def __init__(self, expiry_ms: int, columns: list[str]):
        self.expiry_ms, self.columns = expiry_ms, columns

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(_named(rows, [*self.columns, "_time", "_seq", "_request", "_runs", "_ms", "_key", "_bucket"]), ignore_index=True)
        held = self.held()
        n = len(held)
        both = lambda c: np.concatenate((held[c].to_numpy(np.int64), pdf[c].to_numpy(np.int64)))
        ms, seq, own = both("_ms"), both("_seq"), np.arange(n + len(pdf)) < n  # own: what is known of a job
        request = np.append(np.zeros(n, bool), pdf["_request"].to_numpy(bool))
        active = own | request | np.append(np.zeros(n, bool), pdf["_runs"].to_numpy(bool))
        job, keys = pd.factorize(np.concatenate((held["_key"].to_numpy(object), pdf["_key"].to_numpy(object))))
        # each job's events in order, what is known of it before those of the same time and seq
        order = np.lexsort((~own, seq, ms, job))
        ms, seq, own, request, active, job = (x[order] for x in (ms, seq, own, request, active, job))
        first = np.append(True, job[1:] != job[:-1])
        passed = np.cumsum(own)
        passed -= np.maximum.accumulate(np.where(first, passed - own, 0))
        late = np.isin(job, job[own]) & (passed == 0)  # events before what is known of the job change nothing
        busy = ~first & np.append(False, active[:-1]) & (np.diff(ms, prepend=ms[:1]) <= self.expiry_ms)
        stays = np.append(job[1:] != job[:-1], True) & active
        self.hold(pd.DataFrame({"_key": keys[job[stays]], "_ms": ms[stays], "_seq": seq[stays]}))
        self.wake(ms[stays] + self.expiry_ms + 1)
        yield pdf.iloc[order[request & ~busy & ~late] - n][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        stays = held[~_due(held["_ms"].to_numpy() + self.expiry_ms + 1, timerValues, expiredTimerInfo)]
        self.hold(stays)
        self.wake(stays["_ms"].to_numpy() + self.expiry_ms + 1)
        return iter([])


def _with_updates(requests: DataFrame, updates: DataFrame) -> DataFrame:
    """Both as rows of one table: the columns of requests, _time, _ms, _seq, _request, _runs (an update with an active status)."""
    time = F.col("requested_at").cast("timestamp")
    asked = requests.select("*", time.alias("_time"), F.col("seq").cast("long").alias("_seq"), F.lit(True).alias("_request"), F.lit(False).alias("_runs"))
    told = updates.select(F.col("id").cast(requests.schema["job_id"].dataType).alias("job_id"), F.col("updated_at").cast("timestamp").alias("_time"), F.col("seq").cast("long").alias("_seq"), F.lit(False).alias("_request"), F.coalesce(F.col("status").isin(*ACTIVE), F.lit(False)).alias("_runs"))
    return asked.unionByName(told, allowMissingColumns=True).withColumn("_ms", F.unix_millis("_time"))


def admitted_requests(requests: DataFrame, updates: DataFrame, expiry_minutes: int = 24 * 60, watermark: str = "10 minutes") -> DataFrame:
    """requests (job_id, seq, requested_at, ...) without those whose job is active; updates (id, seq, updated_at, status) tell of the jobs. Both batches or both streams.

    A job is active from a request of it, or an update with an active status, until an update with another one, or until nothing was heard of it for
    expiry_minutes; then a request passes again. Events of a job count in the order of time and seq. A stream forgets a job that isn't
    active, or once the watermark passes its expiry; it takes the events of a micro-batch in order, and drops those later than the watermark. Rows
    without a time are left out."""
    both = _with_updates(requests, updates).filter("_time IS NOT NULL")
    expiry = expiry_minutes * 60_000
    if not both.isStreaming:
        marked = with_before(both, ["job_id", "_ms", "_seq"])
        before = F.col("_before")
        same = F.coalesce(before["job_id"].eqNullSafe(F.col("job_id")), F.lit(False))
        active = same & (before["_request"] | before["_runs"]) & (F.col("_ms") - before["_ms"] <= expiry)
        return marked.filter(F.col("_request") & ~F.coalesce(active, F.lit(False))).select(requests.columns)
    _stateful(both)
    both = both.withColumn("_seq", F.coalesce("_seq", F.lit(NEVER)))  # as the batch has it: nulls first
    rows = _as_texts(_dealt(both, F.col("job_id")), requests.columns).withWatermark("_time", watermark)
    out = rows.groupBy("_bucket").transformWithStateInPandas(_Admitted(expiry, requests.columns), _as_texts(requests, requests.columns).schema, "append", "eventTime")
    return _as_before(out, requests.schema)


class _Silent(_Bucketed):
    """A row for each time that nothing came for longer than the gap, by a timer where no event tells; known is the last time of each feed, and whether its silence was told."""

    known_of = {"_key": object, "_ms": np.int64, "_told": bool}

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def _rows(self, feeds: np.ndarray, times: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"_key": feeds, "last_ms": times, "stale_ms": times + self.gap_ms})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held()
        came = [pdf[["_key", "_ms"]] for pdf in _named(rows, ["feed", "_time", "_ms", "_key", "_bucket"])]
        every = pd.concat([held[["_key", "_ms"]], *came]) if len(held) else pd.concat(came)
        own, ms = np.arange(len(every)) < len(held), every["_ms"].to_numpy(np.int64)
        told = np.zeros(len(every), bool)
        told[: len(held)] = held["_told"].to_numpy(bool)
        feed, keys = pd.factorize(every["_key"].to_numpy(object))
        least = np.full(len(keys), 2 * NEVER)
        least[feed[own]] = ms[own]
        counts = np.flatnonzero(own | (ms > least[feed]))  # events that are older than the last one change nothing
        counts = counts[np.lexsort((ms[counts], feed[counts]))]
        feed, ms, told = feed[counts], ms[counts], told[counts]
        ends = np.append(feed[1:] != feed[:-1], True)
        silent = np.append(np.diff(ms) > self.gap_ms, False) & ~ends & ~told
        self.hold(pd.DataFrame({"_key": keys[feed[ends]], "_ms": ms[ends], "_told": told[ends]}))
        self.wake(ms[ends & ~told] + self.gap_ms)
        yield self._rows(keys[feed[silent]], ms[silent])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        told, ms = held["_told"].to_numpy(bool), held["_ms"].to_numpy()
        new = ~told & _due(ms + self.gap_ms, timerValues, expiredTimerInfo)
        self.hold(held.assign(_told=told | new))
        self.wake(ms[~told & ~new] + self.gap_ms)
        yield self._rows(held["_key"].to_numpy(object)[new], ms[new])


def silent_feeds(events: DataFrame, gap_seconds: int = 7, watermark: str = "0 seconds", now_ms: Column | int | None = None) -> DataFrame:
    """events (feed, time, ...) -> (feed, last_ms, stale_ms): a row for each time that a feed had no event for more than gap_seconds.

    On a stream the row comes with the feed's next event, or without one when the watermark, which other feeds drive, passes
    last_ms + gap. A feed that speaks again can fall silent again. Events that are older than the last one of their feed change
    nothing. A batch looks up to now_ms, by default its latest event. Rows without a time are left out."""
    gap = gap_seconds * 1000
    timed = events.select("feed", F.col("time").cast("timestamp").alias("_time")).withColumn("_ms", F.unix_millis("_time")).filter("_time IS NOT NULL")
    if not events.isStreaming:
        end = timed.agg(F.max("_ms")).first()[0] if now_ms is None else now_ms
        rows = timed.select("feed", "_ms").unionByName(timed.select("feed").distinct().select("feed", F.lit(end).cast("long").alias("_ms")))
        marked = with_before(rows, ["feed", "_ms"])
        before = F.col("_before")
        silent = before["feed"].eqNullSafe(F.col("feed")) & (F.col("_ms") - before["_ms"] > gap)
        return marked.filter(F.coalesce(silent, F.lit(False))).select("feed", before["_ms"].alias("last_ms"), (before["_ms"] + gap).alias("stale_ms"))
    _stateful(events)
    rows = _dealt(timed, F.col("feed")).withWatermark("_time", watermark).groupBy("_bucket").transformWithStateInPandas(_Silent(gap), "_key string, last_ms long, stale_ms long", "append", "eventTime")
    return rows.select(_undealt(F.col("_key")).cast(timed.schema["feed"].dataType).alias("feed"), "last_ms", "stale_ms")


class _Ring(StatefulProcessor):
    """The last n rows of a key, in list state; the ring is put out whenever it changes."""

    def __init__(self, n: int, schema: StructType):
        self.n, self.schema = n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [*self.schema.names]
        ring = [tuple(r) for r in self.rows.get()]
        at, seq = names.index("_us"), names.index("seq")
        for pdf in _named(rows, ["ring", *names]):
            plain = pdf[names].astype(object).where(pdf[names].notna(), None)
            ring = sorted([*ring, *plain.itertuples(index=False, name=None)], key=lambda r: (r[at], r[seq]))[-self.n :]
        self.rows.put(ring)
        yield pd.DataFrame({"ring": [key[0]] * len(ring), **{c: pd.Series([r[i] for r in ring], dtype=object) for i, c in enumerate(names)}})

    def close(self) -> None:
        pass


def log_rings(logs: DataFrame, n: int = 200, rings: int = 8) -> DataFrame:
    """A stream of logs (seq, time, level, source, message, job_id) -> after each micro-batch the rings that it changed, whole: (ring, _us, seq, level, source, message, job_id), in update mode.

    Entries are dealt to rings by the hash of seq, so that no source is one task; the last n of all rings are among the last n of
    each. State: n entries for each ring."""
    _stateful(logs)
    rows = logs.select(F.pmod(F.xxhash64("seq"), F.lit(rings)).cast("int").alias("ring"), _us(F.col("time")).alias("_us"), "seq", "level", "source", "message", "job_id")
    schema = StructType([f for f in rows.schema if f.name != "ring"])
    return rows.groupBy("ring").transformWithStateInPandas(_Ring(n, schema), rows.schema, "update", "none")


def last_of_rings(rings: DataFrame, n: int = 200) -> DataFrame:
    """The last n entries of rings (as log_rings gives them, the newest form of each ring only), with their time."""
    return rings.orderBy(F.col("_us").desc(), F.col("seq").desc()).limit(n).select("seq", F.when(F.col("_us") > NEVER, F.timestamp_micros("_us")).alias("time"), "level", "source", "message", "job_id")


def requests_once(requests: DataFrame) -> DataFrame:
    """The first request of each job_id, whatever became of the job."""
    return requests.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy("requested_at", "seq"))).filter("_r = 1").drop("_r")

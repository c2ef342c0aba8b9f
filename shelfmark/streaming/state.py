"""Streams that fold events: alerts with a cooldown, throttled events, runs of equal log entries, log tails, overdue jobs, tables of latest states.

Most take a batch too; where a stream knows less than a batch its docstring says so. State is bounded by the number of keys; rows of a key are folded in
the order of time and seq within a micro-batch, and micro-batches follow each other as the source delivers them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from shelfmark.functions.values import memory_high
from shelfmark.operators.logs import numbered_log_runs
from shelfmark.operators.sequences import spaced
from shelfmark.shared import written
from shelfmark.streaming.jobs import field_states, fold_fields, shown_fields
from shelfmark.streaming.keyed import last_of_rings, log_rings
from shelfmark.streaming.versions import VersionedTable


def throttle(events: DataFrame, gap_ms: int, key: str = "key") -> DataFrame:
    """events (key, ms, seq) without those that come sooner than gap_ms after the last one kept of their key. They are dropped, not put off. Batch or stream.

    Null keys are one key; events without a time are dropped. A batch goes by sequences.spaced, so that a hot key is no single task."""
    if not events.isStreaming:
        return spaced(events, key, "ms", "seq", gap_ms)

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["ms", "seq"])
        last, keep = int(state.get[0]) if state.exists else None, []
        for t in pdf["ms"].tolist():
            keep.append(last is None or t - last >= gap_ms)
            last = t if keep[-1] else last
        if last is not None:
            state.update((last,))
        yield pdf[keep]

    return events.filter("ms IS NOT NULL").groupBy(key).applyInPandasWithState(step, events.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def alerts(metrics: DataFrame, cooldown_minutes: int = 30) -> DataFrame:
    """metrics (host, ts, seq, heap_used_mb, heap_total_mb) of high memory, at most one each `cooldown_minutes` of a host."""
    high = metrics.filter(memory_high(F.col("heap_used_mb"), F.col("heap_total_mb"))).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return throttle(high, cooldown_minutes * 60_000, "host")


def collapse_into(logs: DataFrame, table_path: str, checkpoint: str):
    """A started query that writes the runs of equal entries of a stream of logs, as collapse_logs has them: those that have ended, once, at table_path/runs/batch-{n}, and the one still open at table_path/open-{n}.

    A micro-batch's runs are found by ranges; the state is the open run, one row, which the next batch's first run goes on with if
    their entries are equal. Entries of a later batch are taken to be later ones. A batch run again finds the open run before it."""
    spark = logs.sparkSession
    same = ["level", "source", "message", "job_id"]

    def merge(batch: DataFrame, number: int) -> None:
        runs = written(numbered_log_runs(batch), "runs")
        ends = runs.agg(F.min("run").alias("first"), F.max("run").alias("last")).first()
        held = spark.read.schema(runs.schema).parquet(f"{table_path}/open-{number - 1}").collect() if number > 0 else []  # one row at most
        before = spark.createDataFrame(held, runs.schema)
        if ends.first is not None and held:
            goes_on = F.lit(True)
            for c in same:
                goes_on = goes_on & F.col(c).eqNullSafe(F.lit(held[0][c]))
            goes_on = (F.col("run") == ends.first) & goes_on
            if not runs.filter(goes_on).isEmpty():
                runs = runs.withColumns({"seq": F.when(goes_on, F.lit(held[0].seq)).otherwise(F.col("seq")), "repeats": F.col("repeats") + F.when(goes_on, held[0].repeats).otherwise(0)})
                before = before.limit(0)
        last = F.col("run") == ends.last if ends.last is not None else F.lit(False)
        ended = before.unionByName(runs.filter(~last)) if ends.last is not None else before.limit(0)
        ended.write.mode("overwrite").parquet(f"{table_path}/runs/batch-{number}")
        (runs.filter(last) if ends.last is not None else before).coalesce(1).write.mode("overwrite").parquet(f"{table_path}/open-{number}")
        if number > 1:
            _drop(spark, f"{table_path}/open-{number - 2}")

    return logs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_runs(spark: SparkSession, table_path: str) -> DataFrame:
    """The runs that collapse_into has written so far, with the open one."""
    newest = max(_numbers(spark, table_path, "open-"))
    return spark.read.parquet(f"{table_path}/runs/*").unionByName(spark.read.parquet(f"{table_path}/open-{newest}")).drop("run")


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return [int(x.removeprefix(prefix)) for x in names if x.startswith(prefix)]


def log_tail(logs: DataFrame, table_path: str, checkpoint: str, n: int = 200, rings: int = 8):
    """A started query that keeps the last n entries of a stream of logs: rings in keyed state (keyed.log_rings), each of whose newest form a table at table_path has. read_tail gives the entries."""
    spark = logs.sparkSession
    table = VersionedTable(spark, table_path, "ring", rings)

    def newest(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_last", F.max("batch").over(Window.partitionBy("ring"))).filter("batch = _last").drop("_last")  # n rows of a ring, twice

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch.withColumn("batch", F.lit(number).cast("long")), number, newest)

    return log_rings(logs, n, rings).writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_tail(spark: SparkSession, table_path: str, n: int = 200) -> DataFrame:
    """The last n entries that log_tail has kept."""
    return last_of_rings(VersionedTable(spark, table_path, "ring").read(), n)


def overdue_stream(updates: DataFrame, minutes: int = 45, now_ms: Column | int | None = None) -> DataFrame:
    """updates (id, status, ms, seq) -> (id, started_ms, overdue_ms): once for each run of a job that lasts over `minutes`.

    now_ms: the time up to which a batch looks; a job that still runs then counts as running so far. Without it its last update
    is the end. A job that stops running in time gives nothing. On a stream the row comes with the first update that shows the time to be over, or when the
    processing-time timer of `minutes` after its first running update fires."""
    limit = minutes * 60_000
    if not updates.isStreaming:
        order = Window.partitionBy("id").orderBy("ms", "seq")
        runs = updates.withColumn("new", F.coalesce(((F.col("status") == "running") != (F.lag("status").over(order) == "running")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
        spans = runs.withColumn("until", F.lead("ms").over(order)).groupBy("id", "run").agg(F.first("status").alias("status"), F.min("ms").alias("started_ms"), F.max(F.coalesce("until", F.greatest(F.col("ms"), F.lit(now_ms) if now_ms is not None else F.col("ms")))).alias("until"))
        return spans.filter((F.col("status") == "running") & (F.col("until") - F.col("started_ms") > limit)).select("id", "started_ms", (F.col("started_ms") + limit).alias("overdue_ms"))

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        started, told = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            if started is not None and not told:
                out.append((key[0], started, started + limit))
            state.update((started, True))
        else:
            for r in pd.concat(list(frames)).sort_values(["ms", "seq"]).itertuples():
                if started is not None and not told and r.ms - started > limit:
                    out.append((key[0], started, started + limit))
                    told = True
                if r.status != "running":
                    started, told = None, False
                elif started is None:
                    started = int(r.ms)
            if started is None:
                if state.exists:
                    state.remove()
            else:
                state.update((started, told))
                if not told:
                    state.setTimeoutDuration(limit)
        yield pd.DataFrame(out, columns=["id", "started_ms", "overdue_ms"])

    return updates.groupBy("id").applyInPandasWithState(step, "id string, started_ms long, overdue_ms long", "started long, told boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stale_feeds(updates: DataFrame, now, gap_seconds: int = 7) -> DataFrame:
    """(feed, last, stale): feeds by the time since their last event, as of `now`. keyed.silent_feeds tells of each silence, on a stream as it comes."""
    last = updates.groupBy("feed").agg(F.max("time").alias("last"))
    return last.withColumn("stale", F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("last").cast("timestamp")) > gap_seconds * 1000)


def upsert_latest(updates: DataFrame, table_path: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None, buckets: int = 8):
    """A started query that folds a stream of updates into a table of the latest state of each id, field by field (see jobs.latest_fields), and hands that state to `then`.

    The table has states that can be folded on, in buckets by the hash of the id (see versions.VersionedTable): a micro-batch
    rewrites only those that it touches, in one write. read_latest reads the state; what it gives before the stream starts is the
    snapshot to catch up from."""
    table = VersionedTable(updates.sparkSession, table_path, "id", buckets)

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(fold_fields(field_states(batch)), number, fold_fields)
        if then is not None:
            then(shown_fields(table.read()))

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, table_path: str) -> DataFrame:
    """The latest fields of each id that upsert_latest has kept so far, without deleted ones; before its first batch a table without rows."""
    return shown_fields(VersionedTable(spark, table_path, "id").read(StructType().add("id", "string").add("deleted", "boolean")))

"""Latest state and live figures of job updates; events after a snapshot; continuous page extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.jobs import job_stats
from shelfmark.operators.pages import page_candidates
from shelfmark.shared import exists
from shelfmark.streaming.keyed import later_rows

#: Columns of an update that aren't fields of its job.
EVENT = ("id", "updated_at", "seq", "present", "deleted")


def latest(updates: DataFrame) -> DataFrame:
    """updates (id, updated_at, seq, ...), batch or stream -> the newest row of each id, whole (on a stream in update mode)."""
    rest = [c for c in updates.columns if c != "id"]
    return updates.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "seq")).alias("s")).select("id", "s.*")


def read_partial_updates(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """JSON lines of updates by `schema`, with present: the names of the fields that a line has, be their values null or not."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select(F.from_json("value", schema).alias("u"), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")).alias("present")).select("u.*", "present")


def field_states(updates: DataFrame) -> DataFrame:
    """updates (id, updated_at, seq, fields, and if need be present, deleted) -> (id, deleted, each field as {at, v}): of fields that an update doesn't have, the struct is null.

    present: the names of the fields that an update has; without this column each has all. Products count as present only if they are an array."""
    fields = [c for c in updates.columns if c not in EVENT]
    has = (lambda c: F.array_contains("present", c)) if "present" in updates.columns else (lambda c: F.lit(True))
    given = lambda c: has(c) & F.col(c).isNotNull() if c == "products" else has(c)
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in updates.columns else F.lit(False)
    return updates.select("id", deleted.alias("deleted"), *[F.when(given(c), F.struct(F.struct("updated_at", "seq").alias("at"), F.col(c).alias("v"))).alias(c) for c in fields])


def fold_fields(states: DataFrame) -> DataFrame:
    """States of several updates, or of several such folds, as one for each id: of each field the newest, and deleted if any is. The order in which they are folded doesn't matter."""
    fields = [c for c in states.columns if c not in ("id", "deleted")]
    return states.groupBy("id").agg(F.bool_or("deleted").alias("deleted"), *[F.max_by(c, F.col(c)["at"]).alias(c) for c in fields])


def shown_fields(states: DataFrame) -> DataFrame:
    """(id, fields) of folded states, without deleted ids. Fields that no update has are null."""
    return states.filter(~F.col("deleted")).select("id", *[F.col(c)["v"].alias(c) for c in states.columns if c not in ("id", "deleted")])


def latest_fields(updates: DataFrame) -> DataFrame:
    """updates, as field_states has them, -> (id, fields): of each field the value of the newest update that has it, null if that is null.

    A field that an update doesn't have stays as it was; a late update fills only fields that no newer one has; products stay where an update has none. Once an
    id is deleted it stays so, whatever comes after. Updates of the same updated_at go by seq; null ids are one id. Batch, or a
    stream in update mode, on which an id deleted simply gives no more rows."""
    return shown_fields(fold_fields(field_states(updates)))


def live_overview(snapshot: DataFrame) -> DataFrame:
    """Counts and success rate over a table of latest states: what state.read_latest gives, after each micro-batch of state.upsert_latest."""
    return job_stats(snapshot)


def snapshot_then(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """The state so far, and live updates (id, updated_at, seq, ...) after it.

    Batches: the latest row of each id, with origin 0 from the snapshot and 1 from live. A live row counts only if it comes
    after the snapshot's row of its id, so that rows sent twice while a client catches up change nothing. Null ids are one id.
    A stream: the live rows that count, each once (see keyed.later_rows); catch_up also gives the snapshot's."""
    if live.isStreaming:
        return later_rows(snapshot, live)
    both = snapshot.withColumn("origin", F.lit(0)).unionByName(live.withColumn("origin", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c != "id"]
    return both.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "seq", -F.col("origin"))).alias("s")).select("id", "s.*")


def catch_up(snapshot: DataFrame, live: DataFrame, path: str, checkpoint: str):
    """A started query that writes what a client gets who joins now: first the snapshot, at path/origin=0, then the rows of the stream live that come after it, at path/origin=1.

    The snapshot is written once. A query that starts again from its checkpoint goes on after the last row: nothing is repeated."""
    spark = live.sparkSession
    if not exists(spark, f"{path}/origin=0/_SUCCESS"):
        snapshot.select(live.columns).write.mode("overwrite").parquet(f"{path}/origin=0")
    rows = later_rows(spark.read.schema(live.schema).parquet(f"{path}/origin=0"), live)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(f"{path}/origin=1")


def caught_up(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that catch_up has written so far, with their origin."""
    parts = [spark.read.schema(schema).parquet(f"{path}/origin={k}").withColumn("origin", F.lit(k)) for k in (0, 1) if exists(spark, f"{path}/origin={k}")]
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def extract_stream(pages: DataFrame) -> DataFrame:
    """pages, batch or stream -> (page_id, url, seq, candidate): gated candidates or the source scan. Stateless, for append mode."""
    return page_candidates(pages)

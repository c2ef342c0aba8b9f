"""Job records: projections, state changes, lists, counts, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.urls import model_name
from shelfmark.functions.values import filled, finite, is_active, percent, trimmed
from shelfmark.operators.sequences import positions

COUNTS = ("images", "total_items", "processed_items")
STOPPED = "Stopped by user"


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def summarize_jobs(jobs: DataFrame, include_products: bool = False) -> DataFrame:
    """The public view: text defaults, finite counts, empty errors as null. Without products that column isn't read."""
    text = lambda c, other="": filled(F.col(c).cast("string"), F.lit(other))
    out = [F.col("id").cast("string").alias("id"), text("url").alias("url"), text("status", "queued").alias("status"), text("model").alias("model"), *[finite(F.col(c)).cast("bigint").alias(c) for c in COUNTS], F.nullif("error", F.lit("")).alias("error"), "created_at", "updated_at"]
    return jobs.select(*out, *(["products"] if include_products and _has(jobs, "products") else []))


def normalize_jobs(jobs: DataFrame) -> DataFrame:
    """Stored jobs as the client reads them: a count that is no number falls back to what the products tell; none is below 0; an empty model comes from the url.

    Nulls count as 0, as an explicit null does in stored records."""
    n_products = F.coalesce(F.size("products"), F.lit(0)) if _has(jobs, "products") else F.lit(0)
    n_images = F.coalesce(F.aggregate("products", F.lit(0), lambda a, p: a + F.coalesce(F.size(p["images"]), F.lit(0))), F.lit(0)) if _has(jobs, "products") else F.lit(0)
    status = filled(F.col("status"), F.lit("queued"))
    done = F.when(status == "completed", n_products).otherwise(F.lit(0)).cast("double")
    count = lambda c, other: F.greatest(F.lit(0), finite(F.col(c), other)).cast("bigint")
    url = trimmed(F.coalesce("url", F.lit("")))
    keep = [c for c in jobs.columns if c not in {"id", "url", "status", "model", *COUNTS, "error"}]
    return jobs.select(F.col("id").cast("string").alias("id"), url.alias("url"), status.alias("status"), filled(F.col("model"), model_name(F.col("url"), "Scrape Result", "Category")).alias("model"), count("images", n_images.cast("double")).alias("images"), count("total_items", done).alias("total_items"), count("processed_items", done).alias("processed_items"), F.nullif("error", F.lit("")).alias("error"), *keep)


def ui_jobs(jobs: DataFrame) -> DataFrame:
    return normalize_jobs(jobs).select("id", "url", "status", "model", *COUNTS, "error")


def without(jobs: DataFrame, ids: DataFrame | None, column: str = "id") -> DataFrame:
    """jobs whose id is not in ids (id)."""
    return jobs if ids is None else jobs.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")


def get_job(jobs: DataFrame, job_id: str, deleted: DataFrame | None = None) -> DataFrame:
    return without(jobs.filter(F.col("id") == job_id), deleted)


def filter_jobs(jobs: DataFrame, status: str = "all") -> DataFrame:
    return jobs if status == "all" else jobs.filter(F.col("status") == status)


def search_jobs(jobs: DataFrame, query: str) -> DataFrame:
    """Jobs with the trimmed query in model or url, in any case; all for a blank query."""
    q = query.strip().lower()
    if not q:
        return jobs
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    return jobs.filter(has("model") | has("url"))


def list_jobs(jobs: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Newest first; equal times by id."""
    return without(jobs, deleted).orderBy(F.col("updated_at").desc_nulls_last(), "id")


def client_order(jobs: DataFrame) -> DataFrame:
    """By updated_at, else created_at, else 1970, newest first; equal times by id."""
    return jobs.orderBy(F.coalesce("updated_at", "created_at", F.lit("1970-01-01").cast("timestamp")).desc(), "id")


def newest_finished(jobs: DataFrame, n: int = 100) -> DataFrame:
    return jobs.filter(F.col("status").isin("completed", "failed")).orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(n)


def _moved(jobs: DataFrame, before: str, after: str) -> DataFrame:
    hit = F.coalesce(F.col("status") == before, F.lit(False))
    return jobs.withColumns({"status": F.when(hit, after).otherwise(F.col("status")), "changed": hit})


def pause_all(jobs: DataFrame) -> DataFrame:
    """running -> paused; changed tells which."""
    return _moved(jobs, "running", "paused")


def resume_all(jobs: DataFrame) -> DataFrame:
    return _moved(jobs, "paused", "running")


def expire_overdue(jobs: DataFrame, now: Column, minutes: int = 45) -> DataFrame:
    """Running jobs (started_at, not the time in the queue) of over `minutes` become failed. minutes: 5 to 1440."""
    minutes = min(1440, max(5, minutes))
    late = F.coalesce((F.col("status") == "running") & (F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp")) > minutes * 60_000), F.lit(False))
    return jobs.withColumns({"error": F.when(late, F.lit(f"Job timed out after {minutes} minutes")).otherwise(F.col("error")), "status": F.when(late, "failed").otherwise(F.col("status"))})


def stop_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs of ids (id) become failed, whatever their status."""
    hit = F.col("_stop").isNotNull()
    out = jobs.join(ids.select("id").distinct().withColumn("_stop", F.lit(True)), "id", "left")
    return out.withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "error": F.when(hit, STOPPED).otherwise(F.col("error"))}).drop("_stop")


def finalize_jobs(jobs: DataFrame, products: DataFrame) -> DataFrame:
    """jobs (…, stop_requested) after their run: failed if stopped, else completed; counts from products (job_id, n_images)."""
    done = products.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("_n"), F.sum("n_images").cast("bigint").alias("_images"))
    stopped = F.coalesce("stop_requested", F.lit(False))
    n = F.coalesce("_n", F.lit(0))
    out = jobs.join(done, "id", "left")
    return out.withColumns({"status": F.when(stopped, "failed").otherwise("completed"), "error": F.when(stopped, STOPPED), "total_items": n, "processed_items": n, "images": F.coalesce("_images", F.lit(0)).cast("bigint")}).drop("_n", "_images")


def delete_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return without(jobs, ids)


def reset_user(jobs: DataFrame, user_id: str) -> DataFrame:
    """jobs left once those of a user are gone. Null user ids match no user."""
    return jobs.filter(F.coalesce("user_id", F.lit("")) != user_id)


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False))).cast("bigint")


def overview(jobs: DataFrame) -> DataFrame:
    """One row: jobs by status, images and jobs in all. Other statuses count in total only."""
    return jobs.agg(*[_count(F.col("status") == s).alias(s) for s in ("queued", "running", "paused", "completed", "failed")], F.coalesce(F.sum("images"), F.lit(0)).cast("bigint").alias("total_images"), F.count("*").alias("total"))


def job_stats(jobs: DataFrame) -> DataFrame:
    """One row: overview with the success rate in percent of finished jobs, 0 if none is finished."""
    return overview(jobs).withColumn("success_rate", percent(F.col("completed"), F.col("completed") + F.col("failed")))


def health(jobs: DataFrame) -> DataFrame:
    """One row: total, active (running or paused: both hold a slot), queued."""
    return jobs.agg(F.count("*").alias("total"), _count(F.col("status").isin("running", "paused")).alias("active"), _count(F.col("status") == "queued").alias("queued"))


def queue_positions(jobs: DataFrame, buckets: int = 64) -> DataFrame:
    """(id, position) of queued jobs, from 1, by created_at and id.

    Jobs are dealt to ranges of created_at (by quantiles); a position is the rank in the range plus the jobs in those before, so
    that no single task sorts the queue."""
    queued = jobs.filter(F.col("status") == "queued").select("id", "created_at")
    edges = queued.agg(F.percentile_approx(F.unix_micros(F.col("created_at").cast("timestamp")), [i / buckets for i in range(1, buckets)], 10_000).alias("edges"))
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    placed = queued.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(F.filter(F.coalesce("edges", F.array().cast("array<bigint>")), lambda e: e < at))).drop("edges")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "before")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("created_at").asc_nulls_first(), "id"))
    return placed.withColumn("rank", rank).join(F.broadcast(before), "bucket").select("id", (F.col("before") + F.col("rank")).cast("bigint").alias("position"))


def merge_jobs(server: DataFrame, local: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Server jobs over local ones, field by field; local-only jobs stay; deleted ids go. Newest first.

    A server row's null overrides too. Products, where both have the column, stay the local ones if the server sends none."""
    fields = [c for c in server.columns if c != "id"]
    s = server.select("id", F.lit(True).alias("_server"), *[F.col(c).alias(f"_s_{c}") for c in fields])
    both = local.join(s, "id", "full_outer")
    known = F.coalesce("_server", F.lit(False))
    pick = lambda c: F.coalesce(f"_s_{c}", c) if c == "products" else F.when(known, F.col(f"_s_{c}")).otherwise(F.col(c))
    merged = both.select("id", *[pick(c).alias(c) if c in local.columns else F.col(f"_s_{c}").alias(c) for c in fields], *[c for c in local.columns if c not in {"id", *fields}])
    return client_order(normalize_jobs(without(merged, deleted)))


def signature(jobs: DataFrame, *more: str) -> DataFrame:
    return jobs.select("id", "status", *more, F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "status", "images", "processed_items", "total_items", "model")]).alias("signature"))


def list_signature(jobs: DataFrame, block: int = 1000) -> DataFrame:
    """(n, signature): one row that changes if any job of the list or their order does; the order is client_order's.

    An MD5 over the signatures of each block of rows, one over those of each `block` blocks, and one over these, each in order: blocks
    are digested where they lie, and only digests meet. An empty list has the MD5 of an empty text."""
    at = -F.unix_micros(F.coalesce(F.col("updated_at").cast("timestamp"), F.col("created_at").cast("timestamp"), F.timestamp_micros(F.lit(0))))
    rows = positions(signature(jobs.withColumn("_at", at), "_at").select("signature", "_at", "id"), ["_at", "id"])
    joined = lambda of: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", of))), lambda x: x[of]), "\n"))
    blocks = rows.select(F.col("position").alias("at"), F.expr(f"position div {block}").alias("to"), "signature").groupBy("to").agg(F.count("*").alias("n"), joined("signature").alias("signature"))
    above = blocks.select(F.col("to").alias("at"), F.expr(f"to div {block}").alias("to"), "n", "signature").groupBy("to").agg(F.sum("n").alias("n"), joined("signature").alias("signature"))
    return above.select(F.col("to").alias("at"), "n", "signature").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), joined("signature").alias("signature"))


def diff_jobs(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(id, change, completed_now) of jobs that came, went or changed between two snapshots."""
    a, b = signature(prev).alias("a"), signature(cur).alias("b")
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    change = F.when(F.col("a.id").isNull(), "added").when(F.col("b.id").isNull(), "removed").when(F.col("a.signature") != F.col("b.signature"), "changed")
    now = F.coalesce((F.col("a.status") == "running") & (F.col("b.status") == "completed"), F.lit(False))
    return both.select(F.coalesce("a.id", "b.id").alias("id"), change.alias("change"), now.alias("completed_now")).filter("change IS NOT NULL")


def transitions(updates: DataFrame) -> DataFrame:
    """updates (id, status, updated_at, seq) -> the rows where a job's status changes: id, seq, updated_at, before (null at first), status."""
    before = F.lag("status").over(Window.partitionBy("id").orderBy("updated_at", "seq"))
    return updates.withColumn("before", before).filter("before IS NULL OR before <> status").select("id", "seq", "updated_at", "before", "status")


def elapsed(updates: DataFrame, now: Column) -> DataFrame:
    """(id, started_at, seconds) of jobs running since their last completion: the first running time after it, and the time from there to now."""
    last = updates.groupBy("id").agg(F.max(F.when(F.col("status") == "completed", F.struct("updated_at", "seq"))).alias("done"))
    after = updates.join(last, "id").filter((F.col("status") == "running") & (F.col("done").isNull() | (F.struct("updated_at", "seq") > F.col("done"))))
    first = after.groupBy("id").agg(F.min("updated_at").alias("started_at"))
    return first.withColumn("seconds", F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))) / 1000).cast("bigint"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(is_active(F.col("status")))

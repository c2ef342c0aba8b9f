"""Requests for new jobs: admission, decisions, retries, recent URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.values import is_active, trimmed


def admit_urls(urls: DataFrame, jobs: DataFrame) -> DataFrame:
    """urls (seq, url) with decision: duplicate if a job that hasn't failed has the url or an earlier row of the batch does, else started."""
    taken = jobs.filter("status IS NULL OR status <> 'failed'").select("url").distinct().withColumn("_taken", F.lit(True))
    first = F.row_number().over(Window.partitionBy("url").orderBy("seq")) == 1
    out = urls.withColumn("_first", first).join(taken, "url", "left")
    return out.select("seq", "url", F.when(F.col("_taken").isNotNull() | ~F.col("_first"), "duplicate").otherwise("started").alias("decision"))


def admission_counts(admitted: DataFrame) -> DataFrame:
    return admitted.groupBy("decision").agg(F.count("*").alias("n"))


def decide_requests(requests: DataFrame, jobs: DataFrame, stopping: DataFrame) -> DataFrame:
    """requests (seq, job_id, url) with a decision, the first that applies: missing_url, duplicate (the job is active), cached (completed with
    the same url), stopping (id in stopping), accepted. A second request of an id accepted in the batch is a duplicate."""
    j = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("_status"), F.col("url").alias("_url"))
    s = stopping.select(F.col("id").alias("job_id")).distinct().withColumn("_stopping", F.lit(True))
    same = trimmed(F.coalesce("_url", F.lit(""))) == trimmed(F.coalesce("url", F.lit("")))
    decision = F.when(F.coalesce("url", F.lit("")) == "", "missing_url").when(is_active(F.col("_status")), "duplicate").when((F.col("_status") == "completed") & same, "cached").when(F.col("_stopping").isNotNull(), "stopping").otherwise("accepted")
    out = requests.join(j, "job_id", "left").join(s, "job_id", "left").select("seq", "job_id", "url", decision.alias("decision"))
    before = F.count_if(F.col("decision") == "accepted").over(Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("decision", F.when((F.col("decision") != "missing_url") & (F.col("_before") > 0) & F.col("decision").isin("accepted", "cached", "stopping"), "duplicate").otherwise(F.col("decision"))).drop("_before")


def retry_failed(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs without the failed ones, requests (job_id, url) for their urls under new ids)"""
    failed = jobs.filter("status = 'failed'")
    return jobs.filter("status IS NULL OR status <> 'failed'"), failed.select(F.uuid().alias("job_id"), "url")


def recent_urls(requests: DataFrame, keep: int = 20) -> DataFrame:
    """(user_id, rank, url): the distinct urls of each user, most recent first."""
    last = requests.filter("url IS NOT NULL AND url <> ''").groupBy("user_id", "url").agg(F.max(F.struct("requested_at", "seq")).alias("last"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("last").desc()))
    return last.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= keep).select("user_id", "rank", "url")

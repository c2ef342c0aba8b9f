"""Log entries: levels, tails, runs of equal entries, counts; memory alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.values import filled, log_key, log_level, log_text, memory_high
from shelfmark.operators.sequences import numbered_runs


def normalize_logs(logs: DataFrame) -> DataFrame:
    return logs.select("seq", "time", log_level(F.col("level")).alias("level"), filled(F.col("source"), F.lit("server")).alias("source"), F.coalesce("message", F.lit("")).alias("message"), F.nullif("job_id", F.lit("")).alias("job_id")).withColumn("text", log_text(F.col("message"), F.col("job_id")))


def numbered_log_runs(logs: DataFrame) -> DataFrame:
    """As collapse_logs, with the number of each run from 1."""
    keyed = normalize_logs(logs).withColumn("key", log_key(F.col("level"), F.col("source"), F.col("message"), F.col("job_id")))
    runs = numbered_runs(keyed, ["time", "seq"], lambda before: F.col("key") != before["key"])
    return runs.groupBy("run").agg(F.min("source").alias("source"), F.min("seq").alias("seq"), F.first("level").alias("level"), F.first("message").alias("message"), F.first("job_id").alias("job_id"), F.count("*").alias("repeats"), F.max("time").alias("time"))


def collapse_logs(logs: DataFrame) -> DataFrame:
    """Normalised entries in order of time and seq, with runs of equal ones (level, source, message, job) as one row: its first seq, their number and the last time.

    The whole log is one sequence, as in a log panel. Entries are dealt to ranges of it; runs are found inside a range, and those
    that go on across its end by the last key of the range before, so that no task sees more than its range."""
    return numbered_log_runs(logs).drop("run")


def recent_logs(logs: DataFrame, n: int = 100) -> DataFrame:
    """The last n entries (1 to 200), oldest first."""
    n = min(200, max(1, n))
    return logs.orderBy(F.col("time").desc(), F.col("seq").desc()).limit(n).orderBy("time", "seq")


def log_counts(logs: DataFrame) -> DataFrame:
    return normalize_logs(logs).groupBy("level", "source", "job_id").agg(F.count("*").alias("n"))


def memory_alerts(metrics: DataFrame) -> DataFrame:
    return metrics.filter(memory_high(F.col("heap_used_mb"), F.col("heap_total_mb")))

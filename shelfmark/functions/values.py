"""Lenient value rules: blanks, defaults, numbers, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming takes off, as a Java character class.
SPACES = r"[\t\n\x0B\f\r    -     　﻿]+"
ACTIVE, TERMINAL = ("queued", "running", "paused"), ("completed", "failed")


def trimmed(c: Column) -> Column:
    """Without white space of any kind, or byte order marks, at both ends."""
    return F.regexp_replace(c, rf"\A{SPACES}|{SPACES}\z", "")


def filled(c: Column, *others) -> Column:
    """The first of the texts that is neither null nor empty; else the last."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (c, *others[:-1])], others[-1])


def finite(c: Column, other: Column | None = None) -> Column:
    """c as a finite number; null and blank count as 0, anything else that is no number as `other` (0)."""
    text = trimmed(c.cast("string"))
    number = text.try_cast("double")
    ok = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(c.isNull() | (text == ""), F.lit(0.0)).when(ok, number).otherwise(other if other is not None else F.lit(0.0))


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, rounded; 0 where whole is null or 0."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0).cast("bigint")).otherwise(rounded(F.lit(100.0) * F.coalesce(part, F.lit(0)) / whole))


def is_active(status: Column) -> Column:
    return F.coalesce(status.isin(*ACTIVE), F.lit(False))


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def log_level(c: Column) -> Column:
    low = F.lower(filled(c, F.lit("info")))
    return F.when(low == "warn", "warning").when(low == "ok", "success").when(low.isin("info", "warning", "error", "success"), low).otherwise("info")


def log_text(message: Column, job_id: Column) -> Column:
    return F.when(F.coalesce(job_id, F.lit("")) != "", F.concat(F.coalesce(message, F.lit("")), F.lit(" ("), job_id, F.lit(")"))).otherwise(F.coalesce(message, F.lit("")))


def log_key(level: Column, source: Column, message: Column, job_id: Column) -> Column:
    """What makes two entries equal. Nulls are empty."""
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (level, source, message, job_id)])


def image_id(job_id: Column, product_index: Column, i: Column) -> Column:
    return F.concat_ws("_", job_id, product_index.cast("string"), i.cast("string"))


def split_image_id(c: Column) -> Column:
    """struct(job_id, product_index, i), split from the right, as job ids may have underscores; null if it isn't one."""
    part = lambda n: F.regexp_extract(c, r"\A(.*)_([0-9]+)_([0-9]+)\z", n)
    return F.when(c.rlike(r"\A.*_[0-9]+_[0-9]+\z"), F.struct(part(1).alias("job_id"), part(2).cast("bigint").alias("product_index"), part(3).cast("bigint").alias("i")))


def error_kind(c: Column) -> Column:
    """session_lost, timeout, blocked, stopped, other; null for no error."""
    low = F.lower(c)
    lost = F.lit(False)
    for text in ("invalid session id", "session deleted", "not connected to devtools", "disconnected", "no such window"):
        lost = lost | low.contains(text)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("string")).when(lost, "session_lost").when(low.contains("timeout") | low.contains("timed out"), "timeout").when(low.contains("403") | low.contains("429"), "blocked").when(low.contains("stopped by user"), "stopped").otherwise("other")


def memory_high(used_mb: Column, total_mb: Column, least_total: int = 256, least_used: int = 192, least_percent: int = 90) -> Column:
    return ((total_mb >= least_total) | (used_mb >= least_used)) & (percent(used_mb, total_mb) >= least_percent)

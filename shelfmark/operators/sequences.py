"""Rows in one total order, without a task that sees them all. Nulls come first and are equal to each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.shared import drop_written, width, written


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df in written ranges of the order, numbered in `_part`."""
    return written(df.repartitionByRange(width(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _marked(parts: DataFrame, order: list[str]) -> DataFrame:
    """parts with `_before`, the row before each as a struct (null for the first): inside a range the one before, at its start the last of the ranges before."""
    row = F.struct(*[c for c in parts.columns if c != "_part"])
    inside, whole = Window.partitionBy("_part").orderBy(*order), Window.partitionBy().orderBy("_part")  # whole: a row for each range
    ends = parts.groupBy("_part").agg(F.max_by(row, F.struct(*order)).alias("_end")).select("_part", F.lag("_end").over(whole).alias("_end"))
    return parts.join(F.broadcast(ends), "_part").withColumn("_before", F.coalesce(F.lag(row).over(inside), F.col("_end"))).drop("_end")


def with_before(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `_before`: the row before each in the order of the columns `order`, as a struct; null for the first row."""
    return _marked(_ranges(df, order), order).drop("_part")


def numbered_runs(df: DataFrame, order: list[str], starts: Callable[[Column], Column]) -> DataFrame:
    """df with `run`: how many runs have begun up to each row, in the order of the columns `order`.

    starts tells, from the row before as a struct, whether a row begins a run; the first row does, and so does one for which starts is
    null: it should compare columns that may be null by eqNullSafe. An empty table stays empty. Rows are dealt to ranges of the order; rows are compared
    inside a range, and across its end with the last row of the range before."""
    parts = _ranges(df, order)
    marked = _marked(parts, order).withColumn("_new", (F.col("_before").isNull() | F.coalesce(starts(F.col("_before")), F.lit(True))).cast("long")).drop("_before")
    inside, whole = Window.partitionBy("_part").orderBy(*order), Window.partitionBy().orderBy("_part")
    begun = marked.groupBy("_part").agg(F.sum("_new").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begun"))
    own = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_own", own).join(F.broadcast(begun), "_part").select(*df.columns, (F.col("_begun") + F.col("_own")).alias("run"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df, written, with `_i`: numbers that ascend in the order of the columns `order`."""
    return written(df.repartitionByRange(width(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()), "numbered")


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """df, written, with `position`: 0, 1, 2, ... in the order of the columns `order`. Ranges are numbered apart, and the rows of the ranges before are added, from a row for each range."""
    rows, row = numbered(df, order), F.col("_i").bitwiseAND((1 << 33) - 1)
    whole = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.shiftright("_i", 33).alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", F.shiftright("_i", 33)).join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_before") + row).alias("position"))


def _next(rows: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """rows (key, time, _i, _start) -> (a, b): each row's number and that of the first one of its key that comes gap or more later, if that begins no stretch.

    A probe at time + gap stands for each row among the rows in one order; the row after it is the one. Probes that end a range take the first row of the ranges after."""
    places = rows.select(key, F.col(time).alias("_t"), F.lit(1).alias("_kind"), "_i", "_start").unionByName(rows.select(key, (F.col(time) + gap).alias("_t"), F.lit(0).alias("_kind"), "_i", "_start"))
    order = [key, "_t", "_kind", "_i"]
    parts = _ranges(places, order)
    row = F.when(F.col("_kind") == 1, F.struct(F.col(key).alias("key"), "_i", "_start"))
    back = Window.partitionBy("_part").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy().orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    firsts = parts.groupBy("_part").agg(F.min_by(row, F.when(F.col("_kind") == 1, F.struct(*order))).alias("_f")).select("_part", F.last("_f", ignorenulls=True).over(after).alias("_first"))
    found = parts.join(F.broadcast(firsts), "_part").withColumn("_to", F.coalesce(F.last(row, ignorenulls=True).over(back), F.col("_first"))).filter("_kind = 0")
    found = found.filter(F.col("_to.key").eqNullSafe(F.col(key)) & ~F.col("_to._start")).select(F.col("_i").alias("a"), F.col("_to._i").alias("b"))
    out = written(found, "jumps")
    drop_written(parts)
    return out


def spaced(df: DataFrame, key: str, time: str, seq: str, gap: int) -> DataFrame:
    """df without the rows that come sooner than gap after the last one kept of their key, in the order of time and seq.

    The first row of a stretch, before which nothing comes for gap, is kept. Inside a stretch each row points to the first one that comes gap later; the
    kept ones are those on the chain from its first. Jumps double in each round: the rows reached so far jump on, then each jump is joined with the one from
    where it ends. So a key, however hot, takes as many rounds as the logarithm of the rows kept of its longest stretch, and no task
    sees more than a range. A null time is kept out; null keys are one key."""
    rows = numbered(df.filter(F.col(time).isNotNull()).withColumn("_time", F.col(time).cast("long")), [key, "_time", seq])
    before = F.col("_before")
    start = ~F.coalesce(before[key].eqNullSafe(F.col(key)) & (F.col("_time") - before["_time"] < gap), F.lit(False))
    parts = rows.select(key, "_time", "_i", F.shiftright("_i", 33).alias("_part"))
    marked = written(_marked(parts, ["_i"]).select(key, "_time", "_i", start.alias("_start")), "stretches")
    kept = written(marked.filter("_start").select("_i"), "kept")
    jumps = _next(marked, key, "_time", gap)
    while not jumps.isEmpty():
        reached = written(kept.union(jumps.join(kept, jumps.a == kept["_i"]).select("b")).distinct(), "kept")
        longer = written(jumps.alias("x").join(jumps.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b"), "jumps")
        for old in (kept, jumps):
            drop_written(old)
        kept, jumps = reached, longer
    drop_written(marked)
    return rows.join(kept, "_i", "left_semi").select(df.columns)

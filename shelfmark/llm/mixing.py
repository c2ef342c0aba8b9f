"""Mixing sources to target weights: hash-random order within each source, cut at an exact word budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.shared import table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, BUCKET_ROWS, SEED = (3, 1, 2), 1.5, 2.0, 2_000, "mix"


def n_words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also target: by weight, at most `most` times the size, the excess reshared by weight.

    One row for each source. Sources in order of code points, null last, take the weights in turn. The level of words per
    unit of weight is found in closed form: sources sorted by cap / weight fill up one after the other, and the level is
    the first at which the next source doesn't fill.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    s = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", most * F.col("source_size")).withColumn("_full", F.col("_cap") / F.col("_w"))
    order = Window.partitionBy().orderBy("_full", F.col("source").asc_nulls_last())
    s = s.withColumn("_rank", F.row_number().over(order)).withColumn("_total", share * F.sum("source_size").over(everything))
    s = s.withColumn("_caps", F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"))
    s = s.withColumn("_left", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_total") - F.col("_caps")) / F.col("_left"))
    s = s.withColumn("_level", F.min_by(F.when(F.col("_full") >= F.col("_level"), F.col("_level")), F.when(F.col("_full") >= F.col("_level"), F.col("_rank"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("_level").isNull() | (F.col("_full") <= F.col("_level")), F.col("_cap")).otherwise(F.col("_w") * F.col("_level")).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, buckets: int | None = None, seed: str = SEED) -> DataFrame:
    """docs (doc_id, source, size, ...) with source_size, target and taken: the words that the mix takes of each row.

    Each row has a random key, the MD5 of the seed and its doc_id. Rows of a source are taken in the order of their keys, whole
    epochs first, until the source's budget (its target, rounded) is spent; the last row is cut at the exact word.
    The keys are uniform, so a bucket of their leading digits is a range of about 1 / buckets of any source, however hot: the
    words before a bucket come from sums by bucket, those before a row from a window inside its bucket. buckets: by default one for
    each BUCKET_ROWS rows; the result is the same for any number.

    Null sources are one source, after all others. Null doc_ids and repeated rows are rows like others: the key of a row without a
    doc_id is made of its size and of what the row holds, so that such rows spread over the buckets (ties go by size; equal rows are
    interchangeable, and share a bucket). Rows of size 0 take 0. An empty table gives an empty table. Columns of docs named
    source_size, target or taken are replaced; all others are kept, whatever their names.
    """
    docs = docs.drop("source_size", "target", "taken")
    if buckets is None:
        buckets = max(1, docs.count() // BUCKET_ROWS)
    held = F.concat_ws(":", F.lit("null"), F.col("size").cast("string"), F.xxhash64(F.struct("*").cast("string")).cast("string"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), held)))
    # the row is one column here, so that no name in it can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), F.col("size").alias("size"), F.col("doc_id").alias("id"), key.alias("key"))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)).cast("long"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    goals = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).drop("n").alias("a").join(goals.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(F.col("a.source").alias("of"), F.col("bucket").alias("at"), "before", "source_size", "target")
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("done", F.col("before") + F.sum("size").over(inside) - F.col("size")).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    taken = F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("done")))
    return rows.select("row.*", "source_size", "target", taken.cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = mix_sources(written(docs, "mix-sizes"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
  2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / w AS full_at, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY full_at, source NULLS LAST) AS rk,
  sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS caps,
  sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM f),
l AS (SELECT *, (total - caps) / left_w AS lv FROM r),
g AS (SELECT *, (SELECT lv FROM l WHERE full_at >= lv ORDER BY rk LIMIT 1) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR full_at <= level THEN cap ELSE w * level END AS target FROM g),
b AS (SELECT source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
o AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
  CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
  CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS done
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + least(size, greatest(0, budget - epochs * source_size - done)) AS BIGINT) AS taken FROM o
"""
}
QUERIES = {"op7_mixing": op7_mixing}

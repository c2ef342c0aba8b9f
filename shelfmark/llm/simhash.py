"""SimHash near-duplicates: fingerprints joined on a grid of segment popcounts, then verified bit by bit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bytesops as B
from shelfmark.llm.graph import components
from shelfmark.shared import table, written

SHINGLE, SEED, MOST, SEGMENTS = 3, 42, 2, 16


def _prints(shingle: int, seed: int):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])
        for batch in B.groups(batches):
            raw, at = B.buffers(batch.column("text"))
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(B.texts(raw, at)):
                own = text.lower().split()
                if own:
                    out[i] = fingerprint(own, shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out.view(np.int64))], schema=schema)

    return B.returning(run)


def fingerprint(own: list[bytes], shingle: int = SHINGLE, seed: int = SEED, block: int = 1 << 16) -> int:
    """The bits that are 1 in over half of the hashes of the word shingles (of the whole, if it has fewer words)."""
    joined = b" ".join(own)
    ends = np.cumsum([len(x) + 1 for x in own]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(own))
    n = len(own) - k + 1
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, block):
        j = min(n, i + block)
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i:j].tolist(), ends[i + k - 1 : j + k - 1].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, bits): 64-bit SimHash of the lower-cased word shingles; 0 for a null text or one without words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_prints(shingle, seed), "doc_id long, bits long")


def popcounts(bits, segments: int = SEGMENTS):
    """The fingerprint as a point: how many bits are set in each segment, as the digits (8 bits each at most) of an array."""
    size = 64 // segments
    return [F.bit_count(F.shiftrightunsigned(bits, i * size).bitwiseAND(F.lit((1 << size) - 1))) for i in range(segments)]


def near_prints(prints: DataFrame, most: int = MOST, segments: int = SEGMENTS) -> DataFrame:
    """prints (bits), distinct -> (a, b) with a < b: all pairs of at most `most` differing bits. most: 0 to 2.

    A bit that differs moves one segment's popcount by one, and so the Manhattan distance of two points is at most the number
    of differing bits. Two points within 2 have a grid point within 1 of both. Each point is therefore sent to itself and
    to its neighbours one step away (2 * segments + 1 cells of the grid, 64-bit keys), points that meet in a cell are kept
    if their bits differ in at most `most` places, and repeated pairs go. Both sides are sorted: Spark sizes what explode makes
    as its input, and would send it whole to the driver as small.
    """
    if not 0 <= most <= 2:
        raise ValueError("most must be 0, 1 or 2: one step from both ends covers a distance of 2")
    width = 64 // segments  # a count of 0..width, one step less or more, takes values of -1..width + 1
    base = width + 3
    terms = [(c.cast("decimal(38,0)") + 1) * F.lit(str(base**i)).cast("decimal(38,0)") for i, c in enumerate(popcounts(F.col("bits"), segments))]
    exact = base**segments < 1 << 63
    if exact:
        terms = [(c.cast("long") + 1) * F.lit(base**i) for i, c in enumerate(popcounts(F.col("bits"), segments))]
    point = sum(terms[1:], terms[0])
    steps = [0, *[s * base**i for i in range(segments) for s in (1, -1)]]
    kind = "long" if exact else "decimal(38,0)"
    cells = F.transform(F.array(*[F.lit(str(s)).cast(kind) for s in steps]), lambda s: F.col("point") + s)
    spread = prints.select("bits", point.alias("point")).select("bits", F.explode(cells).alias("cell"))
    pairs = spread.alias("a").hint("merge").join(spread.alias("b"), F.expr(f"a.cell = b.cell AND a.bits < b.bits AND bit_count(a.bits ^ b.bits) <= {most}"))
    return pairs.select(F.col("a.bits").alias("a"), F.col("b.bits").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, most: int = MOST, segments: int = SEGMENTS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, bits, n_links, component_id).

    component_id is the smallest doc_id that a chain of links reaches, itself included; n_links counts the other distinct
    fingerprints within `most` bits. Equal fingerprints form one class before any pairs are made, so copies cost no pairs, and a
    fingerprint has at most 2080 others within 2 bits.

    Null texts and texts without words have fingerprint 0, linked like any other. Repeated rows get a row each. Null doc_ids
    are never a component's smallest id, unless it has no other (then component_id is null). An empty table gives an empty table.
    Other columns are ignored.
    """
    prints = written(fingerprints(docs, shingle, seed), "simhash")
    classes = written(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-classes")
    pairs = written(near_prints(classes.select("bits"), most, segments), "simhash-pairs")
    degree = pairs.select(F.col("a").alias("bits")).union(pairs.select("b")).groupBy("bits").agg(F.count("*").alias("n_links"))
    roots = components(pairs)
    known = classes.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("bits", "component_id").join(degree, "bits", "left")
    known = written(known.select("bits", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "simhash-components")
    return prints.join(known, "bits").select("doc_id", "bits", "n_links", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id", "n_links")


SQL: dict[str, str] = {}
QUERIES = {"op5_simhash": op5_simhash}

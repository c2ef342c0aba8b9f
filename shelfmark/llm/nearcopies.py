"""Near copies by the exact Jaccard similarity of word shingles: SimHash links and a prefix-filtered join, a bound from parity bitmaps, then verification of every candidate.

A set's bitmap has SKETCH words of 64 bits; each shingle flips one of them. Two bitmaps differ in at most as many bits as their sets
differ in shingles, so a pair whose bitmaps differ in more than the similarity allows is none, whatever else its texts hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import bytesops as B
from shelfmark.llm.graph import components
from shelfmark.llm.simhash import fingerprint, near_prints
from shelfmark.shared import drop_written, release, written

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Shingles are ordered by how often their bucket occurs. The order decides the speed only, not the result.
BUCKETS = 1 << 16
#: Longs of a bitmap. Of sets with some thousands of shingles it rules out little; they are verified.
SKETCH = 8
SKETCHES = [f"s{i}" for i in range(SKETCH)]
#: So many of a set's first shingles tell whether a pair has met before. It decides the speed only.
EARLY = 32
#: Sets that a task knows it has sent already.
REMEMBERED = 200_000


class Shingles:
    """The distinct hashes of the lower-cased word shingles of texts, ascending (of the whole, if it has fewer words; none without words)."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.of_bytes, self.of_words = shingle, B.Rolling(B.WORD_P), B.Rolling(B.SEQ_P)

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        raw, at = B.buffers(column)
        raw = B.lower(raw)
        starts, ends, first = B.words(raw, at)
        sums = self.of_words.sums(B.hash_words(raw, starts, ends, self.of_bytes))
        n = np.diff(first)
        size = np.minimum(n, self.shingle)
        count = n - size + (n > 0)
        begin = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hashes = self.of_words.ranges(sums, begin, begin + np.repeat(size, count))
        bounds = np.cumsum([0, *count]).tolist()
        return [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def _id(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes(), SEED) - (1 << 63)


def _bucket(held: np.ndarray) -> np.ndarray:
    return (B.mix(held) % np.uint64(BUCKETS)).astype(np.int64)


def _bitmap(held: np.ndarray) -> np.ndarray:
    """Bits that an odd number of the set's shingles flips."""
    odd = np.bincount((B.mix(held ^ np.uint64(SEED)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prints(column: pa.Array) -> pa.Array:
    """The SimHash of each text, as op5 has it; 0 without words."""
    return pa.array([fingerprint(own, seed=SEED) if (own := text.lower().split()) else 0 for text in B.texts(*B.buffers(column))], pa.uint64()).view(pa.int64())


def _facts(shingle: int):
    """(doc_id, id of the set, its size, the text's SimHash, the set's bitmap s0, s1, ...) of each text, and a last row for each task with its buckets' counts."""

    def run(batches):
        names = ["doc_id", "id", "size", "bits", *SKETCHES]
        schema = pa.schema([*((name, pa.int64()) for name in names), ("counts", pa.list_(pa.int64()))])
        counts, own = np.zeros(BUCKETS, np.int64), Shingles(shingle)
        for batch in B.groups(batches):
            sets = own(batch.column("text"))
            counts += np.bincount(_bucket(np.concatenate(sets)), minlength=BUCKETS)
            ids, sizes = pa.array([_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())
            sketches = [pa.array(column) for column in np.array([_bitmap(x) for x in sets]).T]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids, sizes, _prints(batch.column("text")), *sketches, pa.nulls(len(ids), schema.field("counts").type)], schema=schema)
        yield pa.RecordBatch.from_pylist([dict.fromkeys(names) | {"counts": counts.tolist()}], schema=schema)

    return B.returning(run)


def _prefixes(shingle: int, counts: np.ndarray, similarity: float):
    """(h, id, n, at): of each set of n shingles, in order of `counts`, as many as two similar sets must share one of."""

    def run(batches):
        own, sent = Shingles(shingle), set()
        for batch in B.groups(batches):
            rows = []
            for held in own(batch.column("text")):
                if (n := len(held)) and (name := _id(held)) not in sent:
                    sent.add(name)
                    first = held[np.lexsort((held, counts[_bucket(held)]))][: n - int(np.ceil(similarity * n - 1e-9)) + 1]
                    rows.append((first.view(np.int64), name, n))
            if len(sent) > REMEMBERED:
                sent.clear()
            if rows:
                size = [len(r[0]) for r in rows]
                names, ns = (np.repeat(np.array([r[i] for r in rows], np.int64), size) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[0] for r in rows])), pa.array(names), pa.array(ns.astype(np.int32)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in size]))], names=["h", "id", "n", "at"])

    return B.returning(run)


def _verified(shingle: int, similarity: float):
    """(a, b) of the rows (a, x, b, y) whose texts x and y have sets named a and b that are similar enough."""

    def run(batches):
        own = Shingles(shingle)
        for batch in B.groups(batches, "y"):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            new = [i for i in range(len(a)) if i == 0 or a[i] != a[i - 1]]  # rows of one a follow each other
            first, keep = None, []
            for k, i in enumerate(new):
                first = own(batch.column("x").slice(i, 1))[0]
                if _id(first) != a[i]:
                    continue
                for j in range(i, new[k + 1] if k + 1 < len(new) else len(a)):
                    second = own(batch.column("y").slice(j, 1))[0]
                    if _id(second) == b[j]:
                        same = len(np.intersect1d(first, second, assume_unique=True))
                        if same / (len(first) + len(second) - same) >= similarity:
                            keep.append(j)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return B.returning(run)


def _linked(every: DataFrame) -> DataFrame:
    """(a, b) of the facts: sets of texts with one fingerprint, each against the least, and the least of each two fingerprints that are linked."""
    sets = every.filter("counts IS NULL").select("bits", "id").distinct()
    leads = written(sets.groupBy("bits").agg(F.min("id").alias("lead")), "copies-prints")
    near = written(near_prints(leads.select("bits")), "copies-near")
    own = sets.join(leads, "bits").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    lead = lambda end: leads.select(F.col("bits").alias(end), F.col("lead").alias(f"lead_{end}"))
    other = near.join(lead("a"), "a").join(lead("b"), "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    return own.union(other).filter("a <> b")


def _met(parts: DataFrame, test: Column) -> DataFrame:
    """(a, b) of parts (h, id, part, early, ...): the sets of different parts that meet in a shingle h and pass the test. A pair that shares many shingles gives a row for the first of them alone, if both have it among their `early` ones.

    Both sides are sorted: their bitmaps and early shingles repeat in each row of a set, so that written, by which Spark sizes them, they are a sixth of what a broadcast would be."""
    once = F.coalesce(F.try_element_at(F.array_intersect("a.early", "b.early"), F.lit(1)) == F.col("a.h"), F.lit(True))
    pairs = parts.alias("a").hint("merge").join(parts.alias("b"), F.expr("a.h = b.h AND a.id < b.id AND a.part <> b.part") & test & once)
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, component_id): a row each; component_id is the smallest doc_id that a chain of near copies reaches.

    Near copies have a Jaccard similarity of their shingle sets of `similarity` (over 0) or more. Equal sets are one class before pairs are
    made. SimHash goes first: texts whose fingerprints are equal or linked (see simhash.near_prints) are verified, as no radius of
    bits is sure to hold all similar pairs, nor only such. The join finds the rest. Two sets that similar share one of their first n - ceil(similarity * n) + 1 shingles in any common order, so that no pair
    is missed; rare shingles go first. Of the sets that meet in a shingle, first each is held against one of them, the least; then only
    pairs of different components are left to try, so that a large group of near copies costs pairs in proportion to its
    members. Of both, the pairs whose bitmaps don't rule them out are verified on the texts. Sets are of 64-bit hashes.

    Null texts and texts without words are copies of each other. Null doc_ids are never a component's smallest id, unless it has
    no other. Repeated rows get a row each. An empty table gives an empty table. Other columns are ignored.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = written(docs.mapInArrow(_facts(shingle), "doc_id long, id long, size long, bits long, " + "".join(f"{s} long, " for s in SKETCHES) + "counts array<long>"), "copies-facts")
    counts = np.zeros(BUCKETS, np.int64)
    found = every.filter("counts IS NOT NULL").select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    facts = every.filter("counts IS NULL").select("doc_id", "id")
    of_class = every.filter("counts IS NULL").groupBy("id").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in ("size", *SKETCHES)])
    sketched = written(of_class, "copies-classes")
    classes, sketches = sketched.select("id", "least"), sketched.select("id", "size", *SKETCHES)

    prefixes = written(docs.mapInArrow(_prefixes(shingle, counts, similarity), "h long, id long, n int, at int"), "copies-prefixes")
    often = written(prefixes.groupBy("h").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last").select("h", "lead"), "copies-often")
    shared = written(prefixes.join(often, "h"), "copies-shared")
    drop_written(prefixes)
    release(spark)
    # the shingles that may follow a pair's first common one must still suffice
    able = F.expr(f"a.n >= {similarity} * b.n - 1e-6 AND b.n >= {similarity} * a.n - 1e-6 AND least(a.n - a.at, b.n - b.at) >= {similarity} / (1 + {similarity}) * (a.n + b.n) - 1e-6")
    leads = shared.filter("id = lead").select("h", "id", "n", "at").distinct()
    pairs = leads.alias("a").join(shared.alias("b"), F.expr("a.h = b.h AND a.id <> b.id") & able)
    pairs = written(pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).union(_linked(every)).distinct(), "copies-pairs")
    # sets of m and n shingles that similar differ in at most (1 - similarity) / (1 + similarity) * (m + n) of them
    apart = "+".join(f"bit_count(a.{s} ^ b.{s})" for s in SKETCHES)
    close = F.expr(f"{apart} <= {1 - similarity} / {1 + similarity} * (a.size + b.size) + 1e-6")
    of_a = sketches.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("size", *SKETCHES)])
    of_b = sketches.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("size", *SKETCHES)])
    as_struct = lambda end: F.struct(*[F.col(f"{end}_{c}").alias(c) for c in ("size", *SKETCHES)]).alias(end)
    likely = pairs.join(of_a, "a").join(of_b, "b").select(F.struct("a", "b").alias("pair"), as_struct("a"), as_struct("b")).filter(close).select("pair.a", "pair.b")

    def verified(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = classes.join(named, "id")
        texts = written(docs.join(wanted, F.expr("doc_id <=> least")).select("id", "text"), "copies-texts")
        both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
        out = written(both.select("a", "x", "b", "y").mapInArrow(_verified(shingle, similarity), "a long, b long"), "copies-links")
        drop_written(texts)
        release(spark)
        return out

    known = written(components(verified(written(likely, "copies-likely"))).select(F.col("node").alias("id"), F.col("root").alias("part")), "copies-known")
    parts = written(shared.join(known, "id", "left").select("h", "id", "n", "at", F.coalesce("part", "id").alias("part")), "copies-parts")
    drop_written(shared)
    # of shingles with the same sets the first one in the common order says all: equal lists by two sums of 64-bit hashes
    sums = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)")).alias(f"sum{k}") for k in range(2)]
    mixed = parts.distinct().groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q"), *sums, F.min(F.struct("id", "at")).alias("first")).filter("p < q")
    mixed = written(mixed.groupBy("sum0", "sum1").agg(F.min_by("h", F.col("first.at")).alias("h")).select("h"), "copies-several")
    parts = written(parts.join(mixed, "h", "left_semi").distinct(), "copies-mixed")
    early = parts.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), 1, EARLY).alias("early"))  # a set's shingles
    parts = written(parts.join(sketches, "id").join(early, "id"), "copies-sketched")
    rest = verified(written(_met(parts, able & close).distinct().join(pairs, ["a", "b"], "left_anti"), "copies-rest"))
    # what is left links parts, each of which is one node now
    of = lambda end: known.select(F.col("id").alias(end), F.col("part").alias(f"part_{end}"))
    between = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    roots = components(between).withColumnRenamed("node", "part")
    release(spark)

    known = classes.join(known, "id", "left").withColumn("part", F.coalesce("part", "id")).join(roots, "part", "left").withColumn("root", F.coalesce("root", "part"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return facts.join(known.join(least, "root").select("id", "component_id"), "id").select("doc_id", "component_id")

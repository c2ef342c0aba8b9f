"""Order MinHash fingerprints, in DataFrame functions only.

k-mers of words are numbered by occurrence, and each (k-mer, occurrence) has a 64-bit hash. From that hash each of SLOTS sketches
makes a hash of its own by multiply and xor. It selects of all the text's k-mers the one with the least hash and the one with the
least complement, which is the greatest hash, puts the two in the order of the text, and keeps a hash of that tuple. Two texts
agree in a sketch if they have the same least k-mers in the same order, which edits and moves of text disturb.

A text's k-mers are rows. They stay where the join has put their text: one sort numbers them, and one aggregate has all
the least hashes, so that a long text spills instead of filling memory.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.shared import drop_written, release, table, width, written

SLOTS, DIGITS, SPREAD = 64, 8, 4
#: A sketch's hash has 34 bits; the lower 30 bits of its value are the place of the k-mer (a string has under 2^30 words).
PLACE = 30
BLANKS = " \t\n\x0b\f\r"
EMPTY = "-" * DIGITS


def multipliers(slots: int = SLOTS, seed: int = 1) -> list[tuple[int, int]]:
    """Two odd numbers under 2^31 for each sketch: their products with 32-bit numbers don't overflow."""
    draw = random.Random(seed)
    return [(draw.getrandbits(30) * 2 + 1, draw.getrandbits(30) * 2 + 1) for _ in range(slots)]


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """texts (keys, text), a row for each value of the keys -> (keys, fingerprint).

    The k-mers are pairs of words. A fingerprint is SLOTS groups of DIGITS hexadecimal digits. A text of one word has one
    k-mer, that word; a text without words (null too) has none, and dashes for digits. A lone k-mer is its own tuple.
    Texts that are partitioned by keys, or some of them, are not shuffled.
    """
    # one aggregate of generated code has the least and the greatest values of all sketches
    texts.sparkSession.conf.set("spark.sql.codegen.maxFields", str(4 * SLOTS))
    words = F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS)), r"[ \t\n\x0B\f\r]+")
    rows = texts.select(*keys, words.alias("w")).select(*keys, F.size("w").alias("n"), F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("at", "pair"))
    rows = rows.filter("pair.b IS NOT NULL OR n = 1").select(*keys, "at", F.when(F.col("pair.a") != "", F.xxhash64("pair.a", "pair.b")).alias("gram"))
    nth = F.row_number().over(Window.partitionBy(*keys, "gram").orderBy("at"))
    rows = rows.select(*keys, F.col("at").cast("long").alias("at"), F.when(F.col("gram").isNotNull(), F.xxhash64("gram", nth)).alias("p"))
    rows = rows.select(*keys, "at", F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned("p", 32).alias("high"))
    values = [F.shiftleft((F.col("low") * F.lit(a)).bitwiseXOR(F.col("high") * F.lit(b)), PLACE).bitwiseOR(F.col("at")) for a, b in multipliers()]
    least = rows.groupBy(*keys).agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values) for f, n in ((F.min, "x"), (F.max, "y"))])

    def digits(i: int) -> Column:
        x, y = F.col(f"x{i}"), F.col(f"y{i}")
        place = lambda c: c.bitwiseAND(F.lit((1 << PLACE) - 1))
        h = lambda c: F.shiftrightunsigned(c, PLACE)
        pair = F.when(x == y, F.xxhash64(h(x))).when(place(x) < place(y), F.xxhash64(h(x), h(y))).otherwise(F.xxhash64(h(y), h(x)))
        return F.when(x.isNull(), EMPTY).otherwise(F.right(F.lpad(F.lower(F.hex(pair)), 16, "0"), F.lit(DIGITS)))

    return least.select(*keys, F.concat(*[digits(i) for i in range(SLOTS)]).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches that agree; 1 for equal fingerprints (two empty ones too)."""
    part = lambda c, i: F.substring(c, i * DIGITS + 1, F.lit(DIGITS))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: part(a, i) == part(b, i)))
    return F.when(a == b, F.lit(1.0)).otherwise(same / F.lit(SLOTS))


def successors(keys: DataFrame) -> DataFrame:
    """keys (doc_id, key), distinct -> with next_id and next_key, in ascending order (null first); after the last comes the first.

    Rows are dealt to ranges; the next row is found inside a range, and across its end from the ranges' first rows.
    """
    parts = written(keys.repartitionByRange(width(keys.sparkSession), "doc_id", "key").withColumn("part", F.spark_partition_id()), "ranges")
    firsts = parts.groupBy("part").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    whole = Window.partitionBy().orderBy("part")
    firsts = firsts.withColumn("onward", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("part", "onward")
    inside = F.lead(F.struct("doc_id", "key")).over(Window.partitionBy("part").orderBy("doc_id", "key"))
    return parts.withColumn("after", inside).join(firsts, "part").withColumn("after", F.coalesce("after", "onward")).select("doc_id", "key", F.col("after.doc_id").alias("next_id"), F.col("after.key").alias("next_key"))


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document, in ascending order of doc_id; after the last comes the first.

    A null text is an empty one. A null doc_id is less than all others. Rows of one doc_id follow each other by a hash of
    their text; rows equal in both are one document, and its row is repeated as often. One document alone is its own next.
    An empty table gives an empty table. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("id", "text", F.coalesce("id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(F.col("id").isNull(), "text").alias("key"))  # keys without nulls join on plain equality
    # shuffled once for both of its joins, to parts whose k-mers fit in memory: they are several times as large as the texts
    base = docs.repartition(SPREAD * width(docs.sparkSession), "doc_id", "key").groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    lengths = written(docs.groupBy("doc_id", "key", F.length("text").alias("n_chars")).agg(F.count("*").cast("int").alias("copies"), F.first("id").alias("id")), "lengths")
    wanted = written(successors(lengths.select("doc_id", "key")).join(lengths, ["doc_id", "key"]).withColumn("half", F.expr("CAST(n_chars div 2 AS INT)")), "successors")
    drop_written(lengths)
    # fingerprints and digests need the same columns of texts and heads, so that they share what is shuffled; the rest joins later
    heads = base.select(F.col("doc_id").alias("next_id"), F.col("key").alias("next_key"), "text").join(wanted, ["next_id", "next_key"])
    heads = heads.select("doc_id", "key", "half", F.expr("substring(text, 1, half)").alias("head"))
    both = base.join(heads, ["doc_id", "key"]).withColumn("edited", F.expr("concat(substring(text, 1, CAST(length(text) - half AS INT)), head)"))
    each = both.select("doc_id", "key", F.explode(F.array(F.struct(F.lit(0).alias("edit"), "text"), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")))).alias("x"))
    marks = fingerprints(each.select("doc_id", "key", "x.edit", "x.text"), ["doc_id", "key", "edit"])
    of = lambda edit, name: F.max(F.when(F.col("edit") == edit, F.col("fingerprint"))).alias(name)
    marks = marks.groupBy("doc_id", "key").agg(of(0, "fingerprint"), of(1, "edited_fingerprint"))
    # the texts lie where their k-mers do, so that one job shuffles them once
    facts = both.select("doc_id", "key", F.sha2("edited", 256).alias("edited_sha256"))
    known = wanted.select("id", "doc_id", "key", "copies", F.col("n_chars").cast("long").alias("n_chars"), "next_id", "next_key")
    marked = written(facts.join(marks, ["doc_id", "key"]).join(known, ["doc_id", "key"]), "fingerprints")
    drop_written(wanted)
    del base, heads, both, each, marks, facts, known
    release(docs.sparkSession)
    nexts = marked.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("fingerprint").alias("next"))
    out = marked.join(nexts, F.expr("next_id = _id AND next_key = _key"))
    out = out.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn("near_next", likeness(F.col("fingerprint"), F.col("next")))
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op9_order_minhash": op9_order_minhash}

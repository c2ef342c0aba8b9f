"""A training-text pipeline over documents: toxic texts go, near-duplicates go, repeated passages are cut, sources are mixed, and the rest is encoded.

Stages take (spark, docs, sf_dir), return a DataFrame, and are written as Parquet between each other. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.mixing import mix_sources, n_words
from shelfmark.llm.nearcopies import near_copies
from shelfmark.llm.pieces import default_model, encode_pieces
from shelfmark.llm.session import ready
from shelfmark.llm.substrings import dedup_substrings
from shelfmark.llm.toxicity import score_toxicity
from shelfmark.shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Labels are learned from as in op2: a fifth of them is held out."""
    ready(spark)
    labels = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    toxic = score_toxicity(docs, labels).filter("predicted = 1").select("doc_id").distinct()
    return docs.join(written(toxic, "toxic"), "doc_id", "left_anti").select(COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (5-word shingles, Jaccard similarity of 0.8 or more) the document with the smallest doc_id stays.

    op5's fingerprints and their links come first, each link is checked on the shingles, and a join on shingles adds the pairs that no radius of bits holds."""
    ready(spark)
    gone = near_copies(docs).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(written(gone, "copies"), "doc_id", "left_anti").select(COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id has are cut out. A text that loses nothing stays as it is."""
    ready(spark)
    out = dedup_substrings(docs.select(COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole for each epoch, then once cut after the last word taken. Of a cut text the words are joined by one blank."""
    ready(spark)
    sized = docs.select(COLUMNS).withColumn("size", n_words(F.col("text")))
    mixed = mix_sources(sized)
    epochs = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("int")
    rest = F.when(F.col("size") > 0, F.expr("taken % size")).otherwise(0).cast("int")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.when(F.col("rest") > 0, F.array(F.array_join(F.slice(words, F.lit(1), F.col("rest")), " "))).otherwise(F.array().cast("array<string>"))
    mixed = mixed.withColumns({"epochs": epochs, "rest": rest}).withColumn("texts", F.concat(F.array_repeat("text", F.col("epochs")), part))
    out = mixed.select("doc_id", F.explode("texts").alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row, with other merges dropped in each repeat of a document: doc_id, source, epoch, n_tokens, ids, lossless."""
    ready(spark)
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("key"))).orderBy(F.length("text").desc(), "key")
    numbered = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("key")).withColumn("epoch", F.row_number().over(same) - 1).drop("key")
    return encode_pieces(numbered, default_model(), epoch="epoch", narrow=True).select("doc_id", "source", "epoch", "n_tokens", "ids", "lossless")


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("substrings", substrings), ("mixing", mixing), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

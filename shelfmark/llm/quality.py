"""Quality rules: base counts of each text, and lines that too many documents of one host share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bytesops as B
from shelfmark.shared import drop_written, table, written

MIN_WORDS, REPEAT_PERCENT = 50, 50
#: A line is common from over LINE_DOCS documents of a host, whatever the host's size; over DEPLETED of its words in such lines reject a document.
LINE_DOCS, DEPLETED = 10, 0.5


def repeat_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, its words in 3-word windows that it has twice or more."""
    n = len(hashes)
    covered = np.zeros(n, bool)
    if n >= 3:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        whole = np.flatnonzero(text[:-2] == text[2:])
        with np.errstate(over="ignore"):
            window = hashes[whole] + B.SEQ_P * (hashes[whole + 1] + B.SEQ_P * (hashes[whole + 2] + B.SEQ_P * B.mix(text[whole].astype(B.U64) + B.U64(1))))
        order = np.argsort(window, kind="stable")
        same = window[order[1:]] == window[order[:-1]]
        again = whole[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        covered[again] = covered[again + 1] = covered[again + 2] = True
    return B.per_text(covered, first)


def line_hash(own: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(own)) - (1 << 63)


def line_facts(text: bytes) -> list[dict]:
    """The normalised lines that have words, with the words in all their places."""
    found: dict[int, int] = {}
    for x in text.split(b"\n"):
        if own := x.lower().split():
            h = line_hash(own)
            found[h] = found.get(h, 0) + len(own)
    return [{"h": h, "w": w} for h, w in found.items()]


def _lines(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("text_key", pa.binary()), ("lines", pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())])))])
    for batch in B.groups(batches):
        found = [line_facts(x) for x in B.texts(*B.buffers(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("text_key"), pa.array(found, schema.field("lines").type)], schema=schema)


DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words", "kept", "left_failed"]
JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_common_words long, kept boolean, left_failed boolean, kept_text string"


def _judge(min_words: int, repeat_percent: int, depleted: float):
    """JUDGED of each (doc_id, text, n_common_words, common): the counts, the text without its lines in common, and the verdicts on both."""

    def run(batches):
        rolling = B.Rolling(B.WORD_P)
        symbol, head = np.zeros(256, bool), np.ones(256, bool)
        symbol[list(b"#*$%&|<>")] = True
        head[0x80:0xC0] = False
        head &= ~B.SPACE

        def counted(raw, at):
            starts, ends, first = B.words(raw, at)
            n, again = np.diff(first), repeat_words(B.hash_words(raw, starts, ends, rolling), first)
            return n, again, (n < min_words) | (100 * again > repeat_percent * n)

        for batch in B.groups(batches):
            raw, at = B.buffers(batch.column("text"))
            n, again, failed = counted(raw, at)
            texts, common = list(B.texts(raw, at)), batch.column("common").to_pylist()
            lines = [[x for x in text.split(b"\n") if x.strip()] for text in texts]
            dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
            left_failed, changed = failed.copy(), [i for i, x in enumerate(common) if x]
            for i in changed:
                gone = set(common[i])
                texts[i] = b"\n".join(x for x in texts[i].split(b"\n") if line_hash(x.lower().split()) not in gone)
            if changed:
                left_failed[changed] = counted(*B.buffers(pa.array([texts[i] for i in changed], pa.binary()).cast(pa.string())))[2]
            shared = np.array([x or 0 for x in batch.column("n_common_words").to_pylist()], np.int64)
            kept = ~failed & (shared <= depleted * n) & ~left_failed
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(B.per_text(head[raw], at)), pa.array(B.per_text(symbol[raw], at)), pa.array(dup), pa.array(again), pa.array(failed), pa.array(shared), pa.array(kept), pa.array(left_failed), pa.array(texts, pa.binary()).cast(pa.string())], names=[*DIGEST, "kept_text"])

    return run


def cleaned(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, repeat_percent: int = REPEAT_PERCENT, line_docs: int = LINE_DOCS, depleted: float = DEPLETED) -> DataFrame:
    """docs (doc_id, text, host) -> one row each: doc_id, the base counts, base_failed, n_common_words, kept, left_failed, kept_text.

    Lines are normalised (A-Z lowered, white space as one blank) and hashed. A host's line is common if more than line_docs
    documents (doc_ids) of the host hold it, whatever the host's size. kept_text is the text without its common lines;
    left_failed: kept_text fails the base rules. A document goes if it or what is left of it fails them, or if over the
    share depleted of its words is in common lines, which all copies of an often copied text are.

    One pass hashes the lines, a second counts and removes; between them the texts meet their common lines by host and MD5,
    where only texts with common lines have a row.

    Null and empty texts have no words and fail. Null hosts are one host. Rows of one doc_id are one document in the counts, rows
    with a null doc_id none; each row gets a row. An empty table gives an empty table. Only the columns named are read; others in docs are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.unhex(F.md5("text")))
    read = docs.filter("text IS NOT NULL").mapInArrow(_lines, "doc_id long, host string, text_key binary, lines array<struct<h: long, w: int>>")
    facts = written(read.select("doc_id", "host", "text_key", F.explode("lines").alias("x")).select("doc_id", "host", "text_key", "x.h", "x.w"), "quality-lines")
    often = facts.groupBy("host", "h", "doc_id").agg(F.lit(1)).groupBy("host", "h").agg(F.count("doc_id").alias("n")).filter(F.col("n") > line_docs).select("host", "h")
    often = written(often, "quality-often")  # both sides of the joins are then dealt for them alone, and Spark can split a hot line or text
    lines = facts.dropDuplicates(["host", "text_key", "h"])
    common = lines.alias("a").join(often.alias("b"), F.expr("a.host <=> b.host AND a.h = b.h")).groupBy("a.host", "text_key").agg(F.sum("w").alias("n_common_words"), F.collect_list("a.h").alias("common"))
    common = written(common, "quality-common")
    drop_written(facts)
    drop_written(often)
    met = docs.alias("a").join(common.alias("b"), F.expr("a.host <=> b.host AND a.text_key = b.text_key"), "left").select("doc_id", "text", "n_common_words", "common")
    return met.mapInArrow(_judge(min_words, repeat_percent, depleted), JUDGED)


def quality(docs: DataFrame, **limits) -> DataFrame:
    """cleaned() without the texts: doc_id, the base counts, base_failed, n_common_words, kept, left_failed. limits: as there."""
    return cleaned(docs, **limits).select(DIGEST)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


SQL = {
    "op8_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
t AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
g AS (SELECT r, p, x, lead(x) OVER (PARTITION BY r ORDER BY p) AS y, lead(x, 2) OVER (PARTITION BY r ORDER BY p) AS z FROM t),
c AS (SELECT r, p, z IS NOT NULL AND count(*) OVER (PARTITION BY r, x, y, z) > 1 AS rep FROM g),
v AS (SELECT r, rep OR coalesce(lag(rep) OVER o, false) OR coalesce(lag(rep, 2) OVER o, false) AS cov FROM c WINDOW o AS (PARTITION BY r ORDER BY p)),
rw AS (SELECT r, CAST(count_if(cov) AS BIGINT) AS n_repeat_words FROM v GROUP BY r),
ln AS (SELECT r, doc_id, host, unnest(xs) AS line, generate_subscripts(xs, 1) AS i FROM (SELECT r, doc_id, host, string_split(text, chr(10)) AS xs FROM d)),
lw AS (SELECT r, doc_id, host, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM ln),
l AS (SELECT r, doc_id, host, line, i, raw, array_to_string(ws, ' ') AS norm, len(ws) AS nw FROM lw WHERE len(ws) > 0),
dl AS (SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM l GROUP BY r),
hot AS (SELECT host, norm FROM l GROUP BY host, norm HAVING count(DISTINCT doc_id) > 10),
gone AS (SELECT l.r, l.i, nw FROM l JOIN hot ON l.host IS NOT DISTINCT FROM hot.host AND l.norm = hot.norm),
cm AS (SELECT r, CAST(sum(nw) AS BIGINT) AS n_common_words FROM gone GROUP BY r),
rt AS (SELECT r, i, unnest(raw) AS x, generate_subscripts(raw, 1) AS p FROM l WHERE r IN (SELECT r FROM cm) AND (r, i) NOT IN (SELECT (r, i) FROM gone)),
rg AS (SELECT r, i, p, x, lead(x) OVER (PARTITION BY r ORDER BY i, p) AS y, lead(x, 2) OVER (PARTITION BY r ORDER BY i, p) AS z FROM rt),
rc AS (SELECT r, i, p, z IS NOT NULL AND count(*) OVER (PARTITION BY r, x, y, z) > 1 AS rep FROM rg),
rv AS (SELECT r, rep OR coalesce(lag(rep) OVER o, false) OR coalesce(lag(rep, 2) OVER o, false) AS cov FROM rc WINDOW o AS (PARTITION BY r ORDER BY i, p)),
lf AS (SELECT cm.r, coalesce(count(cov) < 50 OR 100 * count_if(cov) > 50 * count(cov), true) AS rest_failed FROM cm LEFT JOIN rv USING (r) GROUP BY cm.r),
b AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_common_words, 0) AS n_common_words, rest_failed
  FROM w LEFT JOIN dl USING (r) LEFT JOIN rw USING (r) LEFT JOIN cm USING (r) LEFT JOIN lf USING (r)),
k AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(rest_failed, n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS left_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_words,
  NOT base_failed AND n_common_words <= 0.5 * n_words AND NOT left_failed AS kept, left_failed FROM k
"""
}
QUERIES = {"op8_quality": op8_quality}

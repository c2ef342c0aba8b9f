"""Substring dedup on a De Bruijn graph of word k-mers.

The edges of the graph are the windows of LENGTH consecutive words. Windows in a row that share their minimizer (the KMER
consecutive words with the least hash, leftmost of equals) are a path that a document walks at once, a piece. Equal
windows have equal minimizers, and so equal pieces, or parts of pieces at the same anchor, are all that can repeat:

1. pieces of every document: anchor (hash of the minimizer), body (hash of all words), start, n windows;
2. only anchors in two or more documents stay; equal bodies become one edge bundle with the first source (smallest doc_id);
3. anchors with several bodies (where shared passages begin and end) are compared window by window;
4. edges that follow each other in their source, where nothing else joins or leaves, compact to paths by pointer-doubling
   joins, and a document's edges along one path to spans with source coordinates;
5. each span is held against its source: the digest of its words there must be that of its words here; then it is cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import bytesops as B
from shelfmark.llm.session import free
from shelfmark.shared import drop_written, release, table, written

LENGTH, KMER = 50, 16
PIECES = "doc_id long, start int, n int, anchor long, body long"


class Words:
    """Word hashes of the texts of a batch, and of any run of them."""

    def __init__(self):
        self.of_bytes, self.of_words = B.Rolling(B.WORD_P), B.Rolling(B.SEQ_P)

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(prefix sums of word hashes, index of each text's first word)"""
        raw, at = B.buffers(column)
        starts, ends, first = B.words(raw, at)
        return self.of_words.sums(B.hash_words(raw, starts, ends, self.of_bytes)), first

    def runs(self, sums: np.ndarray, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return self.of_words.ranges(sums, start, start + n)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _pieces(length: int, kmer: int):
    def run(batches):
        own = Words()
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("body", pa.int64())])
        for batch in B.groups(batches):
            sums, first = own.read(batch.column("text"))
            n = len(sums) - 1
            if n < length:
                continue
            grams = own.runs(sums, np.arange(n - kmer + 1), kmer)
            low = B.U64(0xFFFFFFFF)
            least = sliding_least(grams & ~low | np.arange(len(grams), dtype=B.U64), length - kmer + 1)
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            windows = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
            if not len(windows):
                continue
            at = (least[windows] & low).astype(np.int64)
            new = np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)))
            head = np.flatnonzero(new)
            start, size = windows[head], np.diff(np.append(head, len(windows)))
            body = own.runs(sums, start, size + length - 1)
            docs = np.asarray(batch.column("doc_id").cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(docs[text[start]]), pa.array((start - first[text[start]]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(grams[at[head]].view(np.int64)), pa.array(body.view(np.int64))], schema=schema)

    return B.returning(run)


def _windows(length: int):
    """The window hashes of the pieces listed for each text, where the text has them."""

    def run(batches):
        own = Words()
        schema = pa.schema([("body", pa.int64()), ("off", pa.int32()), ("window", pa.int64()), ("src_doc", pa.int64()), ("src_pos", pa.int32())])
        for batch in B.groups(batches):
            for i in range(batch.num_rows):
                sums, _ = own.read(batch.column("text").slice(i, 1))
                listed = batch.column("pieces").slice(i, 1).flatten()
                start, n, body = (np.asarray(listed.field(k)) for k in ("start", "n", "body"))
                inside = start + n + length <= len(sums)
                start, n, body = start[inside].astype(np.int64), n[inside].astype(np.int64), body[inside]
                same = own.runs(sums, start, n + length - 1).view(np.int64) == body
                start, n, body = start[same], n[same], body[same]
                if not len(start):
                    continue
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = np.repeat(start, n) + off
                doc = batch.column("doc_id")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(body, n)), pa.array(off.astype(np.int32)), pa.array(own.runs(sums, pos, length).view(np.int64)), pa.array(np.full(len(pos), doc, np.int64)), pa.array(pos.astype(np.int32))], schema=schema)

    return B.returning(run)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


@B.returning
def _source_digests(batches):
    schema = pa.schema([("src_doc", pa.int64()), ("src_pos", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())])
    for batch in B.groups(batches):
        raw, at = B.buffers(batch.column("text"))
        rows = []
        for doc, spans, text in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), B.texts(raw, at), strict=True):
            own = text.split()
            rows += [{"src_doc": doc, "src_pos": s["src_pos"], "words": s["words"], "digest": _digest(own[s["src_pos"] : s["src_pos"] + s["words"]])} for s in spans]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


@B.returning
def _cut(batches):
    for batch in B.groups(batches):
        raw, at = B.buffers(batch.column("text"))
        totals, removed, kept = [], [], []
        for spans, text in zip(batch.columns[-1].to_pylist(), B.texts(raw, at), strict=True):  # the last column: the spans
            own = text.split()
            gone = np.zeros(len(own), bool)
            for s in spans or []:
                a, b = s["start"], s["start"] + s["words"]
                if not gone[a:b].all() and _digest(own[a:b]) == s["digest"]:
                    gone[a:b] = True
            totals.append(len(own))
            removed.append(int(gone.sum()))
            kept.append(b" ".join(own if not removed[-1] else [own[i] for i in np.flatnonzero(~gone)]).decode("utf-8"))
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])


def compacted(edges: DataFrame) -> DataFrame:
    """edges (src_doc, src_pos, n), distinct -> (src_doc, src_pos, n, path): the id of each edge's path.

    An edge goes on an edge that ends where it starts in the same source, if that is the only one that ends there and it is
    the only one that starts there. Each round halves the way to the path's first edge by a join of pointers with themselves.
    """
    edges = edges.withColumn("id", F.xxhash64("src_doc", "src_pos", "n"))
    ends = edges.groupBy("src_doc", (F.col("src_pos") + F.col("n")).alias("src_pos")).agg(F.count("*").alias("n_in"), F.min("id").alias("before"))
    outs = edges.groupBy("src_doc", "src_pos").agg(F.count("*").alias("n_out"), F.min("id").alias("id"))
    links = outs.filter("n_out = 1").join(ends.filter("n_in = 1"), ["src_doc", "src_pos"]).select("id", "before")
    edges = written(edges, "edges")
    ahead = written(edges.select("id").join(links, "id", "left").select("id", F.coalesce("before", "id").alias("to")), "pointers")
    while True:
        after = written(ahead.alias("a").join(ahead.alias("b"), F.expr("a.to = b.id")).select("a.id", F.col("b.to").alias("to"), (F.col("a.to") != F.col("b.to")).alias("moved")), "pointers")
        moved = not after.filter("moved").isEmpty()
        drop_written(ahead)
        ahead = after.drop("moved")
        if not moved:
            break
    return edges.join(ahead.withColumnRenamed("to", "path"), "id").drop("id")


def dedup_substrings(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_removed and kept_text, a row for each row.

    A word goes if a window of `length` consecutive words over it also starts in a document with a smaller doc_id, as the
    input has it. kept_text: the words that stay, joined by one blank.

    A run's source is chosen by a 64-bit hash, and cut only if the words there are the same by MD5. Should two different runs
    have one hash, the later would be held against the wrong source and stay.

    Null and empty texts have no words, and texts of fewer than `length` words have no windows: all their words stay. Rows with
    a null doc_id are neither cut nor sources. Rows with equal doc_ids are not each other's sources. An empty table gives an
    empty table. All columns of docs stay; those named n_words, n_removed or kept_text are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "kept_text").withColumn("text", F.col("text").cast("string")).withColumn("doc_id", F.col("doc_id").cast("long"))
    source = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    # 1, 2: pieces at repeated anchors, and their distinct bodies with the first source
    every = written(source.mapInArrow(_pieces(length, kmer), PIECES), "pieces")
    anchors = every.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    anchors = written(anchors, "anchors")  # both sides of the join are then dealt for it, and Spark can split a hot anchor
    pieces = written(every.join(anchors, "anchor", "left_semi"), "repeated")
    drop_written(every)
    release(spark)
    bodies = written(pieces.groupBy("anchor", "body", "n").agg(F.min(F.struct("doc_id", "start")).alias("s")).select("anchor", "body", "n", F.col("s.doc_id").alias("src_doc"), F.col("s.start").alias("src_pos")), "bodies")
    # 3: window by window where an anchor has several bodies
    # what is grouped on a join's key is written before that join, so that Spark can split a hot key
    several = written(bodies.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "several")
    partial = written(bodies.join(several, "anchor", "left_semi"), "partial")
    listed = partial.groupBy(F.col("src_doc").alias("doc_id")).agg(F.collect_list(F.struct(F.col("src_pos").alias("start"), "n", "body")).alias("pieces"))
    windows = written(source.join(listed, "doc_id").mapInArrow(_windows(length), "body long, off int, window long, src_doc long, src_pos int"), "windows")
    release(spark)
    firsts = written(windows.groupBy("window").agg(F.min(F.struct("src_doc", "src_pos")).alias("s")), "firsts")
    matched = windows.select("body", "off", "window").join(firsts, "window").select("body", "off", F.col("s.src_doc").alias("src_doc"), (F.col("s.src_pos") - F.col("off")).alias("base"))
    by = Window.partitionBy("body", "src_doc", "base").orderBy("off")
    parts = matched.withColumn("island", F.col("off") - F.row_number().over(by)).groupBy("body", "src_doc", "base", "island").agg(F.min("off").alias("off"), F.count("*").cast("int").alias("n"))
    parts = parts.select("body", "off", "n", "src_doc", (F.col("base") + F.col("off")).alias("src_pos"))
    whole = bodies.join(several, "anchor", "left_anti").select("body", F.lit(0).alias("off"), "n", "src_doc", "src_pos")
    edges = whole.union(parts)
    # 4: each document's repeated edges, compacted to spans along paths of the source
    # the tables of edges and spans are sorted for their joins: by their files, a tenth of what a broadcast would be, Spark takes them for small
    walked = pieces.select("doc_id", "start", "body").hint("merge").join(edges, "body").filter("src_doc < doc_id").select("doc_id", (F.col("start") + F.col("off")).alias("start"), "n", "src_doc", "src_pos")
    walked = written(walked, "walked")
    for x in (pieces, anchors, bodies, several, partial, windows, firsts):
        drop_written(x)
    release(spark)
    paths = compacted(walked.select("src_doc", "src_pos", "n").distinct())
    # written before it is grouped, so that Spark can split a source that very many documents repeat
    joined = written(walked.hint("merge").join(paths, ["src_doc", "src_pos", "n"]), "joined")
    shifted = joined.withColumn("shift", F.col("start") - F.col("src_pos")).distinct()
    along = Window.partitionBy("doc_id", "path", "shift").orderBy("start", "n")
    gaps = shifted.withColumn("gap", F.coalesce(F.col("start") > F.max(F.col("start") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).cast("int"))
    islands = gaps.withColumn("island", F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "src_doc", "path", "shift", "island").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start") + length - 1).cast("int").alias("words"))
    spans = written(spans.select("doc_id", "start", "words", "src_doc", (F.col("start") - F.col("shift")).alias("src_pos")), "spans")
    drop_written(walked)
    drop_written(joined)
    # 5: the words at the source's coordinates, and the cut
    asked = spans.select("src_doc", "src_pos", "words").distinct().groupBy(F.col("src_doc").alias("doc_id")).agg(F.collect_list(F.struct("src_pos", "words")).alias("spans"))
    digests = written(source.join(asked, "doc_id").mapInArrow(_source_digests, "src_doc long, src_pos int, words int, digest binary").distinct(), "digests")
    release(spark)
    checked = spans.hint("merge").join(digests, ["src_doc", "src_pos", "words"]).groupBy("doc_id").agg(F.collect_set(F.struct("start", "words", "digest")).alias(free(docs, "spans")))
    checked = written(checked, "checked")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return docs.join(checked.hint("merge"), "doc_id", "left").select(*docs.columns, free(docs, "spans")).mapInArrow(_cut, schema)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op1_substrings": r"""
WITH t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS (SELECT doc_id, p, w, array_to_string(array_agg(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING), ' ') AS win,
  count(*) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS k FROM t),
h AS (SELECT doc_id, p, w, CASE WHEN k = 50 THEN md5(win) END AS m FROM g),
f AS (SELECT m, min(doc_id) AS first_doc FROM h WHERE m IS NOT NULL GROUP BY m),
c AS (SELECT h.doc_id, p, w, f.first_doc < h.doc_id AS dup FROM h LEFT JOIN f ON h.m = f.m),
r AS (SELECT doc_id, p, w, coalesce(bool_or(dup) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM c),
o AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id
"""
}
QUERIES = {"op1_substrings": op1_substrings}

"""Ranked lexical search: bit-sliced Bloom signatures bound every document's score, and all documents that the bounds don't exclude are scored exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm import bytesops as B
from shelfmark.llm.bitmaps import bitmap, maybe_in
from shelfmark.shared import drop_written, table, written

TERM = np.ones(256, bool)
TERM[:0x80] = False
TERM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
TERM_RE = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Results of an item. A term sets BITS bits for each of LEVELS that its occurrences reach; a signature has ROOM bits for each bit set, or up to twice that.
TOP, BITS, ROOM = 20, 4, 4
LEVELS = (1, 2, 3, 4, 6, 8, 12, 16)
#: Documents of a block of the index, and items that one pass over it answers.
BLOCK, ITEMS = 512, 500

INDEX = "width long, keys array<long>, n array<long>, most array<long>, slices binary"


def _text_key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _hashes(raw: np.ndarray, at: np.ndarray, rolling: B.Rolling):
    low = B.lower(raw)
    starts, ends, first = B.words(low, at, TERM)
    return low, starts, ends, first, B.hash_words(low, starts, ends, rolling)


def _places(h: np.ndarray, level: int, width: int) -> np.ndarray:
    """The BITS places of each term's bits at a level."""
    with np.errstate(over="ignore"):
        k = (np.arange(BITS) + BITS * level + 1).astype(B.U64)
        return (B.mix(h[:, None] * B.SEQ_P + k * B.WORD_P) % B.U64(width)).astype(np.int64)


def _block(width: int, docs: list[tuple]) -> dict:
    """Slices: for each bit of the signatures the documents that have it."""
    m = np.zeros((width, -(-len(docs) // 8)), np.uint8)
    for i, (_, _, h, tf) in enumerate(docs):
        for k, level in enumerate(LEVELS):
            m[_places(h[tf >= level], k, width).ravel(), i >> 3] |= np.uint8(0x80 >> (i & 7))
    return {"width": width, "keys": [d[0] for d in docs], "n": [d[1] for d in docs], "most": [int(d[3].max()) for d in docs], "slices": m.tobytes()}


def _signatures(batches):
    """Blocks of documents with signatures of one width; documents without terms are left out."""
    rolling, schema = B.Rolling(B.WORD_P), pa.schema([("width", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("keys", "n", "most")], ("slices", pa.binary())])
    waiting: dict[int, list[tuple]] = {}

    def out(width: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([_block(width, waiting.pop(width))], schema=schema)

    for batch in B.groups(batches):
        raw, at = B.buffers(batch.column("text"))
        _, _, _, first, h = _hashes(raw, at, rolling)
        for text, a, b in zip(B.texts(raw, at), first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                own, tf = np.unique(h[a:b], return_counts=True)
                bits = BITS * sum(int((tf >= level).sum()) for level in LEVELS)
                width = max(64, 1 << (ROOM * bits - 1).bit_length())
                docs = waiting.setdefault(width, [])
                docs.append((_text_key(text), b - a, own, tf))
                if len(docs) >= min(BLOCK, max(8, (1 << 25) // width)):
                    yield out(width)
    for width in list(waiting):
        yield out(width)


class Terms:
    """The terms of some items: their bytes, hashes and weights, and for each item which it has how often."""

    def __init__(self, texts: list[str | None]):
        found: dict[bytes, int] = {}
        pairs: list[tuple[int, int, int]] = []
        for q, text in enumerate(texts):
            own: dict[int, int] = {}
            for t in TERM_RE.findall((text or "").encode().lower()):
                k = found.setdefault(t, len(found))
                own[k] = own.get(k, 0) + 1
            pairs += [(q, t, n) for t, n in own.items()]
        self.terms, self.n_items = list(found), len(texts)
        self.q, self.t, self.times = (np.array([p[i] for p in pairs], np.int64) for i in range(3))
        lens = np.array([len(x) for x in self.terms], np.int64)
        self.bytes, ends = np.frombuffer(b"".join(self.terms), np.uint8), np.cumsum(lens)
        self.start, self.len = ends - lens, lens
        self.h = B.hash_words(self.bytes, self.start, ends, B.Rolling(B.WORD_P))
        self.order = np.argsort(self.h)
        self.w = np.zeros(len(self.terms), np.int64)

    def weigh(self, df: dict[int, int], n_docs: int, total: int) -> None:
        counts = np.array([df.get(t, 0) for t in range(len(self.terms))], float)
        self.w = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * counts + 1))).astype(np.int64)
        self.n_docs, self.total = n_docs, total

    def found(self, raw: np.ndarray, at: np.ndarray, rolling: B.Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n, doc, term, tf): the terms of each text, and those of the items with their occurrences. The bytes are compared."""
        low, starts, ends, first, h = _hashes(raw, at, rolling)
        n = np.diff(first)
        if not len(self.terms) or not len(h):
            return n, *[np.zeros(0, np.int64)] * 3
        sorted_h = self.h[self.order]
        place = np.minimum(np.searchsorted(sorted_h, h), len(sorted_h) - 1)
        hit = np.flatnonzero(sorted_h[place] == h)
        term = self.order[place[hit]]
        same = ends[hit] - starts[hit] == self.len[term]
        hit, term = hit[same], term[same]
        size = self.len[term]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wrong = low[np.repeat(starts[hit], size) + step] != self.bytes[np.repeat(self.start[term], size) + step]
        same = np.ones(len(hit), bool)
        same[np.repeat(np.arange(len(hit)), size)[wrong]] = False
        doc = np.repeat(np.arange(len(n)), n)[hit[same]]
        key, tf = np.unique(doc * len(self.terms) + term[same], return_counts=True)
        return n, key // len(self.terms), key % len(self.terms), tf

    def part(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What tf occurrences give in a document of n terms, before the weight."""
        return (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * n * self.n_docs) // self.total))

    def bounds(self, row: dict) -> np.ndarray:
        """For each item and document of a block at least its score: a term counts as often as its bits allow."""
        n, most = np.array(row["n"], np.int64), np.array(row["most"], np.int64)
        slices = np.frombuffer(row["slices"], np.uint8).reshape(row["width"], -1)
        up = np.zeros((len(self.terms), len(n)), np.int64)
        for k, level in enumerate(LEVELS):
            there = np.bitwise_and.reduce(slices[_places(self.h, k, row["width"])], axis=1)
            there = np.unpackbits(there, axis=1, count=len(n)).astype(bool) & (most >= level)
            tf = np.minimum(most, LEVELS[k + 1] - 1) if k + 1 < len(LEVELS) else most
            np.copyto(up, self.part(np.maximum(tf, 1), n)[None, :], where=there)
        out = np.zeros((self.n_items, len(n)), np.int64)
        has, begin = np.unique(self.q, return_index=True)  # pairs lie in the order of items
        if len(has):
            out[has] = np.add.reduceat(up[self.t] * (self.times * self.w[self.t])[:, None], begin, axis=0)
        return out


def signature_index(docs: DataFrame) -> DataFrame:
    """docs (text) -> blocks of up to BLOCK documents: width of the signatures, keys (hashes of the texts), n (terms), most (occurrences of the most frequent term), slices (a bitmap over the block's documents for each bit)."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_signatures, INDEX)


def _counts(terms: Terms):
    """(term, n): the documents with each term; at -1 those with any term, at -2 all terms."""

    def run(batches):
        rolling = B.Rolling(B.WORD_P)
        df, sums = np.zeros(len(terms.terms), np.int64), np.zeros(2, np.int64)
        for batch in B.groups(batches):
            n, _, term, _ = terms.found(*B.buffers(batch.column("text")), rolling)
            df += np.bincount(term, minlength=len(df))
            sums += [(n > 0).sum(), n.sum()]
        known = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((known, [-1, -2]))), pa.array(np.concatenate((df[known], sums)))], names=["term", "n"])

    return run


def _bound_rows(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q, key, bound = (np.concatenate([r[i] for r in rows] or [np.zeros(0, np.int64)]) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(key, pa.int64()), pa.array(bound, pa.int64())], names=["q", "key", "bound"])


def _highest(terms: Terms, top: int):
    """Of each task and item the `top` highest bounds."""

    def run(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * terms.n_items
        for batch in batches:
            for row in batch.to_pylist():
                keys, bounds = np.array(row["keys"], np.int64), terms.bounds(row)
                for q in range(terms.n_items):
                    k, b = np.concatenate((best[q][0], keys)), np.concatenate((best[q][1], bounds[q]))
                    some = np.argsort(-b, kind="stable")[:top]
                    best[q] = (k[some], b[some])
        yield _bound_rows([(np.full(len(k), q), k, b) for q, (k, b) in enumerate(best)])

    return run


def _not_excluded(terms: Terms, floor: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bounds = terms.bounds(row)
                q, d = np.nonzero(bounds >= floor[:, None])
                yield _bound_rows([(q, np.array(row["keys"], np.int64)[d], bounds[q, d])])

    return run


def _scored(terms: Terms):
    """The score of each row for each of its items."""

    def run(batches):
        rolling = B.Rolling(B.WORD_P)
        for batch in B.groups(batches):
            n, doc, term, tf = terms.found(*B.buffers(batch.column("text")), rolling)
            up = terms.w[term] * terms.part(tf, n[doc])
            first, asked = np.searchsorted(doc, np.arange(len(n) + 1)), batch.column("qs").to_pylist()
            ids, of, scores = batch.column("doc_id").to_pylist(), [], []
            begin = np.searchsorted(terms.q, np.arange(terms.n_items + 1))
            own = np.zeros(len(terms.terms), np.int64)
            for d, qs in enumerate(asked):
                here = slice(first[d], first[d + 1])
                own[term[here]] = up[here]
                for q in qs:
                    at = slice(begin[q], begin[q + 1])
                    of.append((q, ids[d]))
                    scores.append(int((own[terms.t[at]] * terms.times[at]).sum()))
                own[term[here]] = 0
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in of], pa.int64()), pa.array([x[1] for x in of], pa.int64()), pa.array(scores, pa.int64())], names=["q", "doc_id", "score"])

    return run


def _let_through(bits: bytes):
    def run(batches):
        for batch in B.groups(batches):
            keys = np.array([_text_key(x) for x in B.texts(*B.buffers(batch.column("text")))], np.int64)
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text").cast(pa.string()), pa.array(keys)], names=["doc_id", "text", "key"])
            yield rows.filter(pa.array(maybe_in(bits, keys)))

    return run


def _exact(docs: DataFrame, wanted: DataFrame, terms: Terms) -> DataFrame:
    """wanted (q, key) -> (q, doc_id, score) of all rows whose text has the key. The texts that no key asks for don't move."""
    asked = written(wanted.groupBy("key").agg(F.collect_set("q").alias("qs")), "search-asked")  # from a table, so that Spark can split a text with very many copies
    rows = docs.mapInArrow(_let_through(bitmap(asked)), "doc_id long, text string, key long")
    return rows.join(asked, "key").select("doc_id", "text", "qs").mapInArrow(_scored(terms), "q long, doc_id long, score long").filter("score > 0")


def _blocks(items: DataFrame, size: int) -> Iterator[list]:
    rows = items.toLocalIterator()
    while part := list(islice(rows, size)):
        yield part


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, index: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> (item_id, rank, doc_id, score): each item's `top` highest-scoring rows of docs with a score above 0, equal ones by doc_id.

    Items pass in blocks of ITEMS over the index (index: what signature_index has made of docs; by default it is made here). One
    pass finds for each item the rows with the highest bounds, whose exact scores give a floor: the score that `top` rows reach.
    A second pass keeps every document whose bound isn't below its item's floor, and those are scored exactly by their texts.
    Signatures never miss a term, so no row is lost.

    Null texts and texts without terms are never found, and items without terms find nothing. Rows are documents: repeated rows
    are ranked each, null doc_ids after others of the same score; repeated or null item_ids are items of their own. An empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = index is None
    index = written(signature_index(docs), "signatures") if made else index
    kind = items.select("item_id").schema.fields[0].dataType.simpleString()
    found = None
    for part in _blocks(items.select("item_id", F.col("text").cast("string").alias("text")), ITEMS):
        terms = Terms([r.text for r in part])
        if not terms.terms:
            continue
        counts = {r.term: r.n for r in docs.mapInArrow(_counts(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the items
        if not counts.get(-2):
            continue
        terms.weigh(counts, counts[-1], counts[-2])
        seeds = index.mapInArrow(_highest(terms, top), "q long, key long, bound long").filter("bound > 0")
        seeds = seeds.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "key"))).filter(F.col("k") <= top)
        best = _exact(docs, seeds.select("q", "key"), terms).withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("k") == top)
        floor = np.ones(terms.n_items, np.int64)
        for r in best.select("q", "score").collect():  # at most a row for each item
            floor[r.q] = r.score
        wanted = written(index.mapInArrow(_not_excluded(terms, floor), "q long, key long, bound long").select("q", "key"), "search-wanted")
        ranked = _exact(docs, wanted, terms).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(part)], f"q long, item_id {kind}")
        ranked = written(ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "search-found")  # names: at most ITEMS rows
        drop_written(wanted)
        found = ranked if found is None else found.unionByName(ranked)
    if made:
        drop_written(index)
    return found if found is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op11_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
s AS (SELECT CAST(count_if(len(ts) > 0) AS BIGINT) AS nd, CAST(sum(len(ts)) AS BIGINT) AS total FROM d),
qt AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(ts) AS t FROM q) GROUP BY ALL),
dt AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM dt, s GROUP BY t),
p AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // total)))) AS BIGINT) AS score
  FROM dt JOIN qt USING (t) JOIN w USING (t), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM p WHERE score > 0 QUALIFY rank <= 20
"""
}
QUERIES = {"op11_search": op11_search}

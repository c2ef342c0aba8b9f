"""License scans: ordered signature rules behind a keyword filter; overlapping detections are resolved by priority."""

from __future__ import annotations

import bisect
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bytesops as B
from shelfmark.llm.license_rules import BASE_PHRASES, rules
from shelfmark.shared import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, first_word: long, n_words: long, weight: double>>"


class Scanner:
    def __init__(self):
        self.base = [(tuple(p.split()), label) for p, label in BASE_PHRASES]
        self.rules = rules()
        self.words = np.zeros(256, bool)
        self.words[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
        by: dict[bytes, list[int]] = {}
        for i, (_, keyword, _, _) in enumerate(self.rules):
            by.setdefault(keyword.split()[0].encode(), []).append(i)
        self.keywords = sorted(by.items())
        self.base_keys = [(p, label, max(p, key=len).encode()) for p, label in self.base]

    def scan(self, text: bytes) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """(base places as (word, label), detections as (label, first word, words, weight))."""
        low = text.lower()
        tried = sorted(i for key, found in self.keywords if key in low for i in found)
        based = [(p, label) for p, label, key in self.base_keys if key in low]
        if not tried and not based:
            return [], []
        own = WORD.findall(low.decode("utf-8"))
        joined, starts = " ".join(own), list(itertools.accumulate(map(len, own), lambda at, n: at + n + 1, initial=0))
        word = lambda at: bisect.bisect_right(starts, at) - 1  # noqa: E731  the word at a place of joined
        places = []
        for phrase, label in based:
            places += [(word(m.start()), label) for m in re.finditer(rf"(?<![^ ])(?={' '.join(phrase)}(?![^ ]))", joined)]
        hits = []
        for i in tried:
            label, keyword, weight, pattern = self.rules[i]
            if keyword in joined:
                hits += [(m.start(), m.end(), i, label, weight) for m in pattern.finditer(joined)]
        return places, [(label, word(a), word(b - 1) - word(a) + 1, weight) for a, b, _, label, weight in resolved(hits)]


def resolved(hits: list[tuple]) -> list[tuple]:
    """hits (start, end, rule, ...) that an earlier rule, or the same rule further left, leaves, by start.

    Rules are ordered: hits are taken rule by rule, and one that lies within a kept hit, or overlaps one, goes. What is kept has no overlaps."""
    starts: list[int] = []
    kept: list[tuple] = []
    for hit in sorted(hits, key=lambda h: (h[2], h[0], -h[1])):
        i = bisect.bisect_left(starts, hit[1])  # those before i start before the hit ends
        if i == 0 or kept[i - 1][1] <= hit[0]:
            starts.insert(i, hit[0])
            kept.insert(i, hit)
    return kept


def _scan(batches):
    scanner = Scanner()
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("weight", pa.float64())])))])
    for batch in B.groups(batches):
        raw, at = B.buffers(batch.column("text"))
        _, _, first = B.words(raw, at, scanner.words)
        rows = []
        for doc_id, n, text in zip(batch.column("doc_id").to_pylist(), np.diff(first).tolist(), B.texts(raw, at), strict=True):
            places, found = scanner.scan(text)
            base = {label for _, label in places}
            rows.append({"doc_id": doc_id, "n_words": n, "n_base": len(places), "first_word": min((p for p, _ in places), default=None), "last_word": max((p for p, _ in places), default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x[0] for x in found})), "score": max([0.6 * bool(base), *(x[3] for x in found)]), "detections": [dict(zip(("label", "first_word", "n_words", "weight"), x, strict=True)) for x in found]})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row each with the base places, labels, score and detections (label, first_word, n_words, weight).

    One pass over the texts, without a shuffle. A rule's pattern is tried only on texts that hold its keyword. Where detections
    overlap, or one contains another, the earlier rule's stays and the other goes, whichever is longer.
    score is the largest weight of what was found, 0 if nothing was.

    Null and empty texts have no words: counts 0, first_word and last_word null, labels empty, score 0. Repeated rows and
    null doc_ids get a row each. An empty table gives an empty table. Other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, OUT)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


SQL: dict[str, str] = {}
QUERIES = {"op4_licenses": op4_licenses}

"""Line dedup: levelled sorted runs of line hashes, and texts without the lines that too many documents have."""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bytesops as B
from shelfmark.llm.session import free
from shelfmark.shared import drop_written, scratch, table, width, written

#: A line goes from LEAST_DOCS documents on. BATCHES: into how many batches one call deals its documents. FANOUT: so many runs of a level become one of the next.
LEAST_DOCS, BATCHES, FANOUT = 10, 6, 3


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lowered."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def line_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """How many documents have each line, in sorted runs by level: tables (h, n) bucketed and sorted by hash, below `path`.

    add() takes a batch of line hashes, one row for each document that has the line. It counts them, leaves out by a merge
    anti-join with each run the hashes that a run already knows as reached (n >= least), and writes the rest as a run of level
    0. FANOUT runs of a level are merged into one of the next, so a hash is rewritten once a level. Runs have equal buckets:
    only the batch moves in the anti-joins. With least = 1 add() returns the lines that no earlier batch has had.

    The runs found at `path` are opened again. Null hashes are left out; an empty batch adds an empty run. A run counts once its table is
    complete; those that it replaces, and what a failed call has left, go with the next call.
    """

    def __init__(self, spark: SparkSession, path: str, least: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.path, self.least, self.fanout = spark, path, least, fanout
        self.levels: list[list[str]] = []
        self._merged: list[str] = []
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(n for f in self._fs.listStatus(folder) if re.match(r"\d+_\d+_", n := f.getPath().getName())) if self._fs.exists(folder) else []
        done = {n for n in names if self._fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))}
        merged = {x for n in done for x in re.findall(r"of_([0-9a-f]{32}(?:_[0-9a-f]{32})*)$", n) for x in x.split("_")}
        self.buckets = next((int(n.split("_")[1]) for n in names), width(spark))
        for n in sorted(done):
            if n.split("_")[2] not in merged:
                self._register(n)
        self._merged = [n for n in names if n.split("_")[2] in merged or n not in done]

    def _register(self, name: str) -> None:
        """Name: level_buckets_id, and of_ids of the runs that it replaces."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(name)} (h BINARY, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        level = int(name.split("_")[0])
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    @staticmethod
    def _table(name: str) -> str:
        return f"line_run_{name.split('_')[2]}"

    def _write(self, rows: DataFrame, level: int, of: list[str]) -> str:
        name = f"{level}_{self.buckets}_{uuid.uuid4().hex}" + ("_of_" + "_".join(x.split("_")[2] for x in of) if of else "")
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", f"{self.path}/{name}").saveAsTable(self._table(name))
        self._register(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(self._table(n)) for level in self.levels for n in level]

    def _summed(self, runs: list[DataFrame]) -> DataFrame:
        none = self.spark.createDataFrame([], "h binary, n long")
        return reduce(DataFrame.unionByName, runs, none).groupBy("h").agg(F.sum("n").alias("n"))

    def add(self, hashes: DataFrame) -> DataFrame:
        """hashes (h): one row for each document and line of it -> (h, n), what the batch has added. It can be read until the next call."""
        for n in self._merged:
            self._drop(n)
        self._merged = []
        counts = hashes.filter("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"))
        for run in self.runs():
            counts = counts.join(run.filter(F.col("n") >= self.least).select("h"), "h", "left_anti")
        name = self._write(counts, 0, [])
        added = self.spark.table(self._table(name))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._write(self._summed([self.spark.table(self._table(n)) for n in old]), level + 1, old)
            self.levels[level] = []
            self._merged += old
            level += 1
        return added

    def reached(self) -> DataFrame:
        """(h): the lines of at least `least` documents."""
        return self._summed(self.runs()).filter(F.col("n") >= self.least).select("h")

    def drop(self) -> None:
        for n in [*self._merged, *(n for level in self.levels for n in level)]:
            self._drop(n)
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)


def _facts(batches: int):
    def run(rows):
        schema = pa.schema([("batch", pa.int32()), ("text_key", pa.binary()), ("h", pa.binary())])
        for batch in B.groups(rows):
            of, keys, hashes = [], [], []
            for text in B.texts(*B.buffers(batch.column("text"))):
                own = {line_key(x) for x in text.split(b"\n")} - {b""}
                key = hashlib.md5(text).digest()
                of += [key[0] * 256 + key[1]] * len(own)
                keys += [key] * len(own)
                hashes += [line_hash(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([x % batches for x in of], pa.int32()), pa.array(keys, pa.binary()), pa.array(hashes, pa.binary())], schema=schema)

    return run


def _cut(columns: list[str], text: str, gone: str):
    """The rows with n_lines, n_dropped and kept_text in place of `gone`."""

    def run(rows):
        for batch in B.groups(rows, text):
            n_lines, n_dropped, left = [], [], []
            for own, hashes in zip(B.texts(*B.buffers(batch.column(text))), batch.column(gone).to_pylist(), strict=True):
                lines, drop = own.split(b"\n"), set(hashes or ())
                kept = [x for x in lines if not (key := line_key(x)) or line_hash(key) not in drop] if drop else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                left.append(b"\n".join(kept))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], names=[*columns, "n_lines", "n_dropped", "kept_text"])

    return run


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs (text, ...) with n_lines, n_dropped and kept_text: the text without the lines that at least least_docs rows have.

    Lines are compared by their keys: without ASCII white space at the ends, A-Z lowered; empty keys always stay. Each batch of
    documents goes through LineRuns.add; then the lines of all documents meet the hashes reached in one join, whatever their
    number, and each text is cut once. Hashes have 128 bits. The result is the same for any number of batches.

    A null text is one empty line, and its kept_text is empty. Each row is a document of its own, whatever its doc_id: repeated
    rows count, and get a row each. An empty table gives an empty table. Columns of docs named n_lines, n_dropped or kept_text
    are replaced; all others are kept, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    text = F.col("text").cast("string")
    path = scratch(spark, "line-facts")
    docs.select(text.alias("text")).mapInArrow(_facts(batches), "batch int, text_key binary, h binary").write.partitionBy("batch").parquet(path)
    facts = spark.read.schema("text_key binary, h binary, batch int").parquet(path)
    runs = LineRuns(spark, scratch(spark, "line-runs"), least_docs, fanout)
    for k in range(batches):
        runs.add(facts.filter(F.col("batch") == k).select("h"))
    reached = written(runs.reached(), "lines-reached")  # from a table, so that Spark can split a line that very many documents have
    found = facts.select("text_key", "h").distinct().join(reached, "h").groupBy("text_key").agg(F.collect_list("h").alias("gone"))
    found = written(found, "lines-gone")
    for x in (facts, reached):
        drop_written(x)
    runs.drop()
    gone, key = free(docs, "_gone"), free(docs, "_key")
    rows = docs.withColumn(key, F.unhex(F.md5(F.coalesce(text, F.lit(""))))).join(found.select(F.col("text_key").alias(key), F.col("gone").alias(gone)), key, "left").drop(key)
    rows = rows.withColumn("text", text)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != gone)
    return rows.mapInArrow(_cut([c for c in rows.columns if c != gone], "text", gone), f"{out}, n_lines long, n_dropped long, kept_text string")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op13_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (SELECT *, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
c AS (SELECT key AS common FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(common) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE common IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.common GROUP BY r, doc_id
"""
}
QUERIES = {"op13_line_dedup": op13_line_dedup}

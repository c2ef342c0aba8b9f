"""A keyed table that micro-batches rewrite bucket by bucket: one write a batch, old versions go, and a batch that runs again finds the table before it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.shared import drop_written, written

#: A table with more rows than this for each of its buckets doubles them.
BUCKET_ROWS = 500_000


class VersionedTable:
    """Rows dealt to buckets by the hash of `key` at path/batch-{n}/bucket={k}; path/version-{n}.json says which batch holds each bucket as of batch n."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 8, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.key, self.buckets, self.bucket_rows = spark, path.rstrip("/"), key, buckets, bucket_rows
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []
        return sorted(int(n[8:-5]) for n in names if n.startswith("version-") and n.endswith(".json"))

    def version(self, before: int | None = None) -> dict | None:
        """The newest version, or the newest before batch `before`: {buckets, held: {bucket: batch}, rows: {bucket: rows}}."""
        known = [n for n in self._numbers() if before is None or n < before]
        if not known:
            return None
        file = self._fs.open(self._at(f"version-{known[-1]}.json"))
        try:
            return json.loads(bytes(file.readAllBytes()))
        finally:
            file.close()

    def _put(self, number: int, version: dict) -> None:
        out = self._fs.create(self._at(f"version-{number}.tmp"), True)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        self._fs.delete(self._at(f"version-{number}.json"), False)
        self._fs.rename(self._at(f"version-{number}.tmp"), self._at(f"version-{number}.json"))

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _read(self, version: dict | None, schema: StructType, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/batch-{version['held'][k]}/bucket={k}" for k in buckets if k in version["held"]] if version else []
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema: StructType | None = None) -> DataFrame:
        """The table as of the newest version. Before the first one it has no rows, and the columns of schema (by default its key)."""
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], schema or f"{self.key} string")
        return self._read(version, StructType.fromJson(version["schema"]), list(version["held"]))

    def merge(self, rows: DataFrame, number: int, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Fold rows of batch `number` into the table: fold(old and new rows of the touched buckets) is written in their place. fold keeps the columns and the key of each row."""
        version = self.version(number)
        n = version["buckets"] if version else self.buckets
        grown = n
        while version and sum(version["rows"].values()) > grown * self.bucket_rows:
            grown *= 2
        new = written(rows, "updates")
        if grown == n:
            touched = [str(r[0]) for r in new.select(self._bucket(n)).distinct().collect()]  # at most n
        else:
            touched = [str(k) for k in range(n)]
        both = new.unionByName(self._read(version, new.schema, touched))
        folded = fold(both).select(*new.columns, self._bucket(grown).alias("bucket"))
        folded.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch-{number}")
        drop_written(new)
        counts = {str(r.bucket): r.n for r in self.spark.read.schema("bucket int").parquet(f"{self.path}/batch-{number}").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        kept = version if version and grown == n else {"held": {}, "rows": {}}
        self._put(number, {"schema": new.schema.jsonValue(), "buckets": grown, "held": {**kept["held"], **dict.fromkeys(counts, number)}, "rows": {**kept["rows"], **counts}})
        self._clean(number)

    def _clean(self, number: int) -> None:
        """Drop what neither this version nor the one before it holds."""
        known = [n for n in self._numbers() if n <= number]
        for n in known[:-2]:
            self._fs.delete(self._at(f"version-{n}.json"), False)
        held = {(b, k) for v in (self.version(number + 1), self.version(number)) if v for k, b in v["held"].items()}
        for f in self._fs.listStatus(self._at("")):
            name = f.getPath().getName()
            if name.startswith("batch-") and (b := int(name[6:])) <= number:
                for part in self._fs.listStatus(f.getPath()):
                    k = part.getPath().getName().removeprefix("bucket=")
                    if k.isdigit() and (b, k) not in held:
                        self._fs.delete(part.getPath(), True)
                if not any(b == x for x, _ in held):
                    self._fs.delete(f.getPath(), True)

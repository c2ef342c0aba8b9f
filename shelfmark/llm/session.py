"""Settings that the text operators run with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.shared import ship

#: Arrow batches carry whole texts: at most so many rows, and about so many bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ready(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send the package to the executors and bound the batches that their Python workers get, by bytes and, for rows without texts of their own, by more rows."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name

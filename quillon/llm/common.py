"""Plumbing shared by the training-data operators.

Python operators here are Arrow maps: each partition streams record batches, and a batch is cut into groups of
bounded text size, so that memory doesn't grow with the partition or with the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import cluster
from quillon.functions.cluster import clean, materialise, scratch_path, shared_dir  # noqa: F401

#: ASCII white space, the separator of words in every contract of this subpackage.
ASCII_SPACE = "\t\n\x0b\x0c\r "
#: Characters of text that a group of rows holds at most (a longer text is a group by itself).
GROUP_CHARS = 1_000_000
#: Rows for which a list of ids is sent to all executors; longer lists are joined over a shuffle.
BROADCAST_ROWS = 500_000


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, and keep Arrow batches of texts small.

    Spark's own 10,000 rows a batch are tens of megabytes of text in the JVM and again in Python for each task, so the
    session's setting is changed to 2,000; another value that the session has been given stays."""
    if spark.conf.get(BATCH, None) == "10000":
        spark.conf.set(BATCH, "2000")
    cluster.ship(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(df: DataFrame, ids: DataFrame, key: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """df joined with a written table of 64-bit ids on key: sent to all executors if it has `most` rows at most, else over
    a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= most else shuffled(ids), key, how)


def shuffled(table: DataFrame) -> DataFrame:
    """A table that grows with the input, as a side of a join: by a shuffle, whatever Spark takes its size to be.  What it
    would send to all executors passes through the driver, compressed sizes say little of its size there, and an operator
    that joins in rounds has many at once."""
    return table.hint("merge")


def map_arrow(
    df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """mapInArrow over just these columns, so that the scan is pruned to them; the executors have the package."""
    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(fn, schema)


def text_groups(batch: pa.RecordBatch, column: str = "text", limit: int = GROUP_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with their texts (None for null), each of about `limit` characters at most."""
    texts = batch.column(batch.schema.get_field_index(column))
    start = size = 0
    out: list = []
    for i, scalar in enumerate(texts):
        text = scalar.as_py()
        if out and size + len(text or "") > limit:
            yield batch.slice(start, i - start), out
            start, size, out = i, 0, []
        out.append(text)
        size += len(text or "")
    if out:
        yield batch.slice(start), out


def carried(batch: pa.RecordBatch, *columns: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(c)) for c in columns]


def held_out(column: str, modulus: int):
    """True where crc32 of the id as text leaves remainder 1; a null id is in the training part."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == 1, F.lit(False))


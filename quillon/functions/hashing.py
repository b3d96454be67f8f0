"""Stable keys and digests: of values in the JVM, of ordered groups as streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.cluster import ship


def stable_key(salt: str, label: str | Column, ident: Column) -> Column:
    """sha256 of salt, label and id, with zero bytes between."""
    name = F.lit(label) if isinstance(label, str) else label
    return F.sha2(F.concat(F.lit(salt), F.lit("\0"), name, F.lit("\0"), ident.cast("string")), 256)


def canonical_text_digest(text: Column) -> Column:
    """sha256 with CRLF read as LF."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def ordered_digest(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """by, n, digest: sha256 of a group's values in order (ties by value), a newline after each; null values count in n alone.

    Rows are sorted within their group's partition and hashed as they stream by, over the borders of batches: a task keeps a
    hash, not the group.  The digest of a sequence reads it in one place by its definition.  Without `by`, no rows are one
    group of none."""
    ship(df.sparkSession)
    keys = list(by or [])
    rows = df.select(*keys, F.col(order).alias("_o"), F.col(value).cast("string").alias("_v"))
    dealt = (rows.repartition(*map(F.col, keys)) if keys else rows.repartition(1)).sortWithinPartitions(*keys, "_o", "_v").select(*keys, "_v")
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, state, said, done = None, 0, hashlib.sha256(), False, []

        def close() -> None:
            done.append((*group, n, (state if said else hashlib.sha256(b"\n")).hexdigest()))

        def flush() -> pa.RecordBatch:
            types = [*(batch_types or []), pa.int64(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], [f.name for f in schema])
            done.clear()
            return made

        batch_types = None
        for batch in batches:
            batch_types = [batch.column(i).type for i in range(len(keys))]
            values = batch.column(len(keys)).to_pylist()
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))))) if keys else [()] * len(values)
            for key, text in zip(names, values):
                if key != group:
                    if group is not None:
                        close()
                    group, n, state, said = key, 0, hashlib.sha256(), False
                n += 1
                if text is not None:
                    state.update(text.encode() + b"\n")
                    said = True
            if len(done) > 10_000:
                yield flush()
        if group is not None:
            close()
        if done:
            yield flush()

    found = dealt.mapInArrow(run, schema)
    if keys:
        return found
    return found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), F.lit(hashlib.sha256(b"\n").hexdigest())).alias("digest"))


def json_record(columns: list[str]) -> Column:
    """Canonical JSON: sorted keys, no spaces, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def tree_digest(files: DataFrame) -> DataFrame:
    """Digest of a manifest (path, bytes, sha256) in path order."""
    line = F.concat_ws("\0", "path", F.col("bytes").cast("string"), "sha256")
    return ordered_digest(files.select("path", line.alias("line")), "line", "path")

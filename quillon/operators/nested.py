"""Equality of nested documents: JSON texts walked into rows of (path, kind, value), compared by join.

Paths are keys and places joined by "/", with "~1" for a slash and "~0" for a tilde in a key; the root's is empty.  Kinds:
object and array (value: number of members), string, boolean, null, number.  A boolean is never a number.  Two numbers are
equal within a tolerance, absolute or relative; numbers that aren't finite are equal to themselves.  A null document has no
rows; one that isn't JSON raises; of repeated keys in an object the last counts.  Keys of documents must be unique.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.cluster import ship
from quillon.operators.verify import close


def walk(document: object) -> Iterator[tuple[str, str, str | None, float | None]]:
    """path, kind, text and number of every value; without recursion, however deep."""
    todo = [("", document)]
    while todo:
        path, value = todo.pop()
        below = f"{path}/" if path else ""
        if isinstance(value, dict):
            yield path, "object", str(len(value)), None
            todo += [(below + k.replace("~", "~0").replace("/", "~1"), v) for k, v in value.items()]
        elif isinstance(value, list):
            yield path, "array", str(len(value)), None
            todo += [(f"{below}{k}", v) for k, v in enumerate(value)]
        elif isinstance(value, bool):
            yield path, "boolean", str(value).lower(), None
        elif isinstance(value, (int, float)):
            try:
                yield path, "number", None, float(value)
            except OverflowError:
                yield path, "number", str(value), None
        else:
            yield path, "null" if value is None else "string", value, None


def values_of(documents: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, kind, text, number: a row for every value of every document."""
    ship(documents.sparkSession)
    field = documents.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    found = list(walk(json.loads(text)))
                    rows += [row] * len(found)
                    out += found
            columns = list(zip(*out)) or [(), (), (), ()]
            types = (pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types))], [key, "path", "kind", "text", "number"])

    schema = T.StructType([field, T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("number", T.DoubleType())])
    return documents.select(key, document).mapInArrow(run, schema)


def violations(left: DataFrame, right: DataFrame, key: str, document: str, tolerance: float = 1e-12) -> DataFrame:
    """key, path, rule: missing (from right), extra, kind, or value; empty if all documents are equal."""
    a, b = (values_of(side, key, document).select(key, "path", *(F.col(c).alias(f"{c}_{x}") for c in ("kind", "text", "number"))) for side, x in ((left, "a"), (right, "b")))
    both = a.join(b, [key, "path"], "full_outer")
    same = F.col("text_a").eqNullSafe(F.col("text_b")) & close(F.col("number_a"), F.col("number_b"), tolerance)
    rule = F.when(F.col("kind_b").isNull(), "missing").when(F.col("kind_a").isNull(), "extra").when(F.col("kind_a") != F.col("kind_b"), "kind").when(~same, "value")
    return both.select(key, "path", rule.alias("rule")).where("rule is not null")

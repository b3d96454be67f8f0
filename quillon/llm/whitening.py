"""Embedding whitening: the leading principal components of all vectors, and every row projected on them with unit variance.

Method: a randomised range finder.  A seeded Gaussian block of k + OVERSAMPLE directions is multiplied by the covariance
in passes over all centred rows (each task adds up C'(CQ) for its rows; only sums of dimension x directions numbers meet).
After every pass a Rayleigh-Ritz step in the block's span gives the leading components and their residuals.  If the
residuals are still above TOLERANCE after POWER further passes, the block is completed to a basis of the full dimension,
in which one pass and the same Rayleigh-Ritz step give the components to double precision.

Vectors become integers, floor(256 * entry), which saturate at 64 bits.  The fit list holds every distinct integer vector
once (a vector that a third of the rows share is one row of it); its sums are exact.

Results.  Rows whose vector is null or holds a null, NaN or infinite entry are left out.  A vector shorter than the
longest counts as followed by zeros.  Repeated rows and rows with equal vectors have equal results; a null id is an id
like any other.  There are min(k, dimension) components; one without variance (fewer distinct vectors than components,
or all equal) has a null `whitened` and is left out of `identity_error`, which is null if no component has variance, as
`explained` is then.  Components of equal variance are any orthonormal basis of their space.  Signs: the entry of largest
magnitude is positive.  `deviation` is null where it exceeds 64 bits.  An empty table, or one of empty vectors, gives no
rows.  Columns other than the keys are not read; keys may have any name but those of results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import carried, map_arrow, materialise, read_table

#: Entries are multiplied by this before they are cut to integers.
SCALE = 256
#: Directions beyond the wanted components, power passes after the first, and the residual, as a share of the largest
#: eigenvalue, at which a component counts as found.
OVERSAMPLE, POWER, TOLERANCE = 8, 3, 1e-13
SEED = 20
_INT64 = 2**63 - 1
_VECTOR, _RESULTS = "_vector", ("component", "n", "deviation", "whitened", "explained", "identity_error")


def integers(embedding: str | Column) -> Column:
    """The vector as integers; null where it is null or holds a null or an entry that isn't finite."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(e.isNotNull() & finite, F.transform(e, lambda c: F.floor(c.cast("double") * SCALE)))


def padded(x: str, width: int) -> Column:
    return F.concat(F.col(x), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _largest(x: np.ndarray) -> int:
    """The largest magnitude, exactly (the least 64-bit integer has none of its own)."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def exact_sums(fit: DataFrame, width: int) -> list[int]:
    """The sum of every dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x = matrix(batch.column(0), width)
            x = x if _largest(x) * len(x) <= _INT64 else x.astype(object)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(s) for s in total])], ["i", "s"])

    parts = map_arrow(fit, [_VECTOR], partial, "i int, s string")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r.s) for r in sorted(rows, key=lambda r: r.i)]


def summed(fit: DataFrame, width: int, shape: tuple[int, int], add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of add(matrix of rows), which has `shape`: tasks send one such matrix each."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += add(matrix(batch.column(0), width))
        at = pa.array(np.arange(total.size, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([at, pa.array(total.ravel())], ["at", "v"])

    rows = map_arrow(fit, [_VECTOR], partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(shape[0] * shape[1])
    for r in rows:
        out[r["at"]] = r.v
    return out.reshape(shape)


def ritz(basis: np.ndarray, image: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues and vectors within the span of basis, whose image under the covariance is given, and the
    largest residual as a share of the largest eigenvalue."""
    small = basis.T @ image
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    found = basis @ vectors
    left = np.linalg.norm(image @ vectors - found * values, axis=0).max(initial=0.0)
    return values, found, float(left / values[0]) if values[0] > 0 else 0.0


class Model:
    """What the fit list says: n, exact sums, eigenvalues, components (columns), trace and the check of the whitened fit."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, passes: int, full: bool):
        self.n, self.sums, self.values, self.vectors, self.trace, self.passes, self.full = n, sums, values, vectors, trace, passes, full
        self.width = len(sums)
        self.mean = np.array([s / n for s in sums])
        self.live = values > values.max(initial=0.0) * self.width * np.finfo(float).eps
        self.error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, ((x - self.mean) @ self.vectors) / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> pa.Array:
        n, sums = self.n, self.sums
        bound = n * _largest(x) + max(map(abs, sums), default=0)
        if bound * bound * self.width <= _INT64:
            return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1), pa.int64())
        whole = (sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist())
        return pa.array([v if v <= _INT64 else None for v in whole], pa.int64())


def fit(vectors: DataFrame, k: int = 4, power: int = POWER, oversample: int = OVERSAMPLE) -> Model | None:
    """The model of a table with one column of integer vectors; None if no vector has an entry."""
    rows = materialise(vectors.select(_VECTOR).distinct(), "whitening")
    least, width, n = rows.agg(F.min(F.size(_VECTOR)), F.max(F.size(_VECTOR)), F.count("*")).first()
    if not n or not width:
        return None
    if least != width:
        rows = materialise(rows.select(padded(_VECTOR, width).alias(_VECTOR)).distinct(), "whitening")
        n = rows.count()
    sums = exact_sums(rows, width)
    mean = np.array([s / n for s in sums])

    def image(basis: np.ndarray) -> tuple[np.ndarray, float]:
        shared = rows.sparkSession.sparkContext.broadcast(basis)

        def add(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            product = centred.T @ (centred @ shared.value)
            return np.vstack([product, np.full((1, product.shape[1]), (centred * centred).sum())])

        total = summed(rows, width, (width + 1, basis.shape[1]), add) / n
        shared.unpersist()
        return total[:-1], float(total[-1, 0])

    drawn = np.random.default_rng(SEED)
    size = min(width, k + oversample)
    basis, passes = np.linalg.qr(drawn.standard_normal((width, size)))[0], 0
    while True:
        product, trace = image(basis)
        passes += 1
        values, found, left = ritz(basis, product, k)
        if left <= TOLERANCE or size == width:
            break
        if passes <= power:
            basis = np.linalg.qr(product)[0]
        else:
            basis, size = np.linalg.qr(np.hstack([found, drawn.standard_normal((width, width - found.shape[1]))]))[0], width
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    model = Model(n, sums, values, found * np.where(signs == 0, 1.0, signs), trace, passes, size == width)
    live = int(model.live.sum())
    if live:
        def square(x: np.ndarray) -> np.ndarray:
            w = model.whiten(x)[:, :live]
            return np.vstack([w.T @ w, w.sum(axis=0)])

        total = summed(rows, width, (live + 1, live), square) / n
        model.error = float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(live)).max())
    return model


def whiten(embeddings: DataFrame, keys: list[str], vector: str = "embedding", k: int = 4) -> DataFrame:
    """Every row with a usable vector, once for each of the leading k components: keys, component, n, deviation,
    whitened, explained, identity_error."""
    rows = embeddings.select(*keys, integers(vector).alias(_VECTOR)).where(F.col(_VECTOR).isNotNull())
    model = fit(rows, k)
    fields = [rows.schema[c] for c in keys]
    types = dict(zip(_RESULTS, (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())))
    if model is None:
        return embeddings.sparkSession.createDataFrame([], T.StructType(fields + [T.StructField(c, t) for c, t in types.items()]))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.num_columns - 1), model.width)
            w = model.whiten(x)
            flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([*carried(batch, *keys), model.deviations(x), pa.ListArray.from_arrays(offsets, flat)], [*keys, "deviation", "_whitened"])

    rows = rows.withColumn(_VECTOR, padded(_VECTOR, model.width))
    schema = T.StructType([*fields, T.StructField("deviation", T.LongType()), T.StructField("_whitened", T.ArrayType(T.DoubleType()))])
    share = F.array(*(F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values))
    return (
        map_arrow(rows, [*keys, _VECTOR], project, schema)
        .select(*keys, "deviation", F.posexplode("_whitened").alias("_at", "whitened"))
        .select(
            *keys, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
            F.get(share, F.col("_at")).alias("explained"), F.lit(model.error).cast("double").alias("identity_error"),
        )
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"), ["vec_id"])

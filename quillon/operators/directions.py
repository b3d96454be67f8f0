"""Directions per layer from residual vectors, their norms, projections, and random controls.

residuals: item_id, layer, h (array of floats).  Sums are in double precision; results are stored as floats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import dot, l2


def assemble(values: DataFrame, by: list[str]) -> DataFrame:
    """by, d from rows (by, k, v): arrays in the order of k."""
    return values.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"].cast("float")).alias("d"))


def coordinates(residuals: DataFrame, *keep: str) -> DataFrame:
    return residuals.select("layer", *keep, F.posexplode("h").alias("k", "x")).withColumn("x", F.col("x").cast("double"))


def observed(residuals: DataFrame, positive: str = "positive") -> DataFrame:
    """layer, d: mean of positive minus mean of negative items, coordinate by coordinate."""
    each = coordinates(residuals, positive).groupBy("layer", "k").agg((F.avg(F.when(F.col(positive), F.col("x"))) - F.avg(F.when(~F.col(positive), F.col("x")))).alias("v"))
    return assemble(each, ["layer"])


def contrast(caving: DataFrame, resisting: DataFrame) -> DataFrame:
    """layer, d: mean over items of caving minus resisting residual of the same item."""
    pairs = caving.select("item_id", "layer", F.col("h").alias("a")).join(resisting.select("item_id", "layer", F.col("h").alias("b")), ["item_id", "layer"])
    differences = pairs.select("layer", F.zip_with(F.col("a").cast("array<double>"), F.col("b").cast("array<double>"), lambda x, y: x - y).alias("h"))
    return assemble(coordinates(differences).groupBy("layer", "k").agg(F.avg("x").alias("v")), ["layer"])


def bad_directions(directions: DataFrame) -> DataFrame:
    """Rows with a NaN, an infinity, or no length: none in a usable table."""
    finite = F.forall("d", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return directions.where(~finite | (l2(F.col("d")) == 0))


def norms(directions: DataFrame) -> DataFrame:
    return directions.select("layer", l2(F.col("d")).alias("norm"))


def scores(residuals: DataFrame, directions: DataFrame) -> DataFrame:
    """residuals without h, with score = h . d as a float.  Directions have a row for each layer: few enough to send."""
    return residuals.join(F.broadcast(directions), "layer").withColumn("score", dot(F.col("h"), F.col("d")).cast("float")).drop("h", "d")


def class_counts(labels: DataFrame, by: list[str], modes: DataFrame) -> DataFrame:
    """Positives and negatives overall and per mode; modes without a row count 0."""
    counted = labels.groupBy(*by).agg(F.count_if("positive").alias("positives"), F.count_if(~F.col("positive")).alias("negatives"))
    return modes.join(counted, by, "left").select(*by, F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("negatives", F.lit(0)).alias("negatives"))


def random_controls(spark, directions: DataFrame, controls: int, seed: int) -> DataFrame:
    """control, layer, d: seeded Gaussian axes with the norm of each layer's direction."""
    rows = [(r["layer"], r["d"]) for r in directions.orderBy("layer").collect()]  # a row for each layer
    rng = np.random.default_rng(seed)
    out = []
    for c in range(controls):
        for layer, d in rows:
            axis = rng.standard_normal(len(d))
            out.append((c, layer, [float(x) for x in (axis * np.linalg.norm(d) / np.linalg.norm(axis)).astype(np.float32)]))
    return spark.createDataFrame(out, "control int, layer int, d array<float>")


def control_thresholds(aurocs: DataFrame, q: float) -> DataFrame:
    """layer, threshold: the quantile over controls by layer, and (layer -1) of each control's maximum over layers."""
    by_layer = aurocs.groupBy("layer").agg(F.percentile("auroc", q).alias("threshold"))
    most = aurocs.groupBy("control").agg(F.max("auroc").alias("most")).agg(F.percentile("most", q).alias("threshold"))
    return by_layer.unionByName(most.select(F.lit(-1).alias("layer"), "threshold"))


def residual_scale(residuals: DataFrame, directions: DataFrame, alphas: list[float]) -> DataFrame:
    """layer, alpha, mean and median residual norm, direction norm, and rho = |alpha| * direction norm / mean norm."""
    stats = residuals.select("layer", l2(F.col("h")).alias("n")).groupBy("layer").agg(F.avg("n").alias("mean_norm"), F.median("n").alias("median_norm"))
    grid = F.explode(F.array(*map(F.lit, alphas))).alias("alpha")
    return stats.join(F.broadcast(norms(directions)), "layer").select("layer", grid, "mean_norm", "median_norm", F.col("norm").alias("direction_norm")).withColumn("rho", F.abs("alpha") * F.col("direction_norm") / F.col("mean_norm"))

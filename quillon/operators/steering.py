"""Steering of hidden states as column arithmetic: h + alpha * d at chosen positions.

hidden: row_id, pos, h, mask (true: a real token).  A steered state and the direction must be of one width and finite, or
the result raises; states that aren't steered stay as they are, nulls too.  A row without a real token has no last position:
prefill and captures raise on it if told to (`strict`), and pass it over otherwise.  Repeated rows are steered alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.vectors import add_scaled


def last_position(hidden: DataFrame, strict: bool = False) -> DataFrame:
    """hidden with last_pos: the last position of the row that isn't padding, for padding on either side."""
    last = F.max(F.when(F.col("mask"), F.col("pos"))).over(Window.partitionBy("row_id"))
    if strict:
        error = F.raise_error(F.concat(F.lit("a row without a real token: "), F.col("row_id").cast("string")))
        return hidden.withColumn("last_pos", last).withColumn("last_pos", F.when(F.col("last_pos").isNotNull(), F.col("last_pos")).otherwise(error.cast(hidden.schema["pos"].dataType)))
    return hidden.withColumn("last_pos", last)


def phase(hidden: DataFrame, cached: str = "n_cached") -> DataFrame:
    """hidden with phase: `prefill` for rows whose call saw no cached position, `decode` for those with one new position
    after cached ones; more than one new position after cached ones raises."""
    new = F.count("*").over(Window.partitionBy("row_id"))
    name = F.when(F.col(cached) == 0, "prefill").when(new == 1, "decode").otherwise(F.raise_error(F.lit("neither a prefill nor a decoding step")).cast("string"))
    return hidden.withColumn("phase", name)


def rows_without_tokens(hidden: DataFrame) -> DataFrame:
    return hidden.groupBy("row_id").agg(F.bool_or("mask").alias("some")).where("not some").select("row_id")


def capture_last(hidden: DataFrame, strict: bool = False) -> DataFrame:
    """The state at each row's last real position."""
    return last_position(hidden, strict).where(F.col("pos") == F.col("last_pos")).drop("last_pos")


def steer(hidden: DataFrame, direction: list[float], alpha: float, where: Column) -> DataFrame:
    """hidden with `steered` (boolean) and h moved where the condition holds."""
    if not direction or not all(map(math.isfinite, (*direction, alpha))):
        raise ValueError("direction and alpha must be finite, and the direction not empty")
    d = F.array(*map(F.lit, direction))
    on = F.coalesce(where, F.lit(False))
    moved = add_scaled(F.col("h"), d, F.lit(alpha))
    wrong = F.when(F.col("h").isNull() | (F.size("h") != len(direction)), F.lit("a state of another width than the direction")).when(
        F.exists(moved, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("a state that isn't finite")
    )
    moved = F.when(wrong.isNull(), moved).otherwise(F.raise_error(wrong).cast("array<double>"))
    return hidden.withColumn("steered", on).withColumn("h", F.when(on, moved).otherwise(F.col("h").cast("array<double>")))


def prefill(hidden: DataFrame, direction: list[float], alpha: float, strict: bool = False) -> DataFrame:
    """Only the last real position of each row."""
    return steer(last_position(hidden, strict), direction, alpha, F.col("pos") == F.col("last_pos")).drop("last_pos")


def decode(hidden: DataFrame, direction: list[float], alpha: float) -> DataFrame:
    """Every position."""
    return steer(hidden, direction, alpha, F.lit(True))


def trajectory(hidden: DataFrame, direction: list[float], alpha: float) -> DataFrame:
    """Every position of the mask."""
    return steer(hidden, direction, alpha, F.col("mask"))


def audit(steered: DataFrame) -> DataFrame:
    """Counters of what was steered, as one row."""
    return steered.agg(F.count_distinct("row_id").alias("n_rows"), F.count("*").alias("positions"), F.count_if("steered").alias("steered_positions"), F.count_distinct(F.when(F.col("steered"), F.col("row_id"))).alias("steered_rows"))


def conditions(layers: DataFrame, alphas: list[float]) -> DataFrame:
    """estimator, layer, alpha, ord: alpha 0 once, at the first layer and first in order; then every layer by every
    other alpha.  layers: estimator, layer, position."""
    first = layers.orderBy("position").limit(1).select("estimator", "layer", F.lit(0.0).alias("alpha"), F.lit(0).alias("a"), F.lit(0).alias("p"))
    others = [a for a in alphas if a != 0]
    grid = layers.select("estimator", "layer", F.posexplode(F.array(*map(F.lit, others))).alias("a", "alpha"), F.col("position").alias("p"))
    order = F.when(F.col("alpha") == 0, 0).otherwise((F.col("p") - 1) * len(others) + F.col("a") + 1)
    return first.unionByName(grid).select("estimator", "layer", "alpha", order.cast("int").alias("ord"))

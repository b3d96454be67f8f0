"""Layer gates and the selection of layers that pass them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranking import top_per_group

TOLERANCE = 1e-12


def at_least(value: Column, bar: float) -> Column:
    """value >= bar, up to 1e-12; null if the value is."""
    return (value > bar) | (F.abs(value - F.lit(bar)) <= TOLERANCE)


def observed_gate(probe: DataFrame, overall: float, each_mode: float, most_unevaluable: int) -> DataFrame:
    """estimator, layer, auroc, passed.  probe: estimator, layer, grp_kind (overall, mode), grp, auroc (null: one class).

    Modes that can't be evaluated are forgiven up to a number; all others must reach their bar, and there must be one."""
    mode = F.col("grp_kind") == "mode"
    known = F.col("auroc").isNotNull()
    return (
        probe.groupBy("estimator", "layer")
        .agg(
            F.max(F.when(F.col("grp_kind") == "overall", F.col("auroc"))).alias("auroc"),
            F.count_if(mode & ~known).alias("unevaluable"),
            F.count_if(mode & known).alias("evaluable"),
            F.count_if(mode & known & ~at_least(F.col("auroc"), each_mode)).alias("low"),
        )
        .withColumn("passed", F.coalesce(at_least(F.col("auroc"), overall), F.lit(False)) & (F.col("unevaluable") <= most_unevaluable) & (F.col("evaluable") > 0) & (F.col("low") == 0))
    )


def completion_gate(probe: DataFrame, overall: float, bars: dict[str, float]) -> DataFrame:
    """Every group of every kind must be known and reach its kind's bar."""
    low = F.lit(False)
    for kind, bar in bars.items():
        low = low | ((F.col("grp_kind") == kind) & ~F.coalesce(at_least(F.col("auroc"), bar), F.lit(False)))
    return (
        probe.groupBy("estimator", "layer")
        .agg(F.max(F.when(F.col("grp_kind") == "overall", F.col("auroc"))).alias("auroc"), F.count_if(low).alias("low"))
        .withColumn("passed", F.coalesce(at_least(F.col("auroc"), overall), F.lit(False)) & (F.col("low") == 0))
    )


def cell_minimum(counts: DataFrame, least: int) -> DataFrame:
    """counts (n) with `passed`: whether a cell has enough records; null counts have none."""
    return counts.withColumn("passed", F.coalesce(F.col("n") >= least, F.lit(False)))


def with_cells(gated: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """`passed` only if every cell of the counts has enough records; without cells none passes."""
    enough = cell_minimum(counts, least).agg(F.coalesce(F.min("passed"), F.lit(False)).alias("_enough"))
    return gated.join(F.broadcast(enough), F.lit(True)).withColumn("passed", F.col("passed") & F.col("_enough")).drop("_enough")  # one row


def exceeds_controls(gated: DataFrame, thresholds: DataFrame) -> DataFrame:
    """`passed` only where auroc is over the layer's control quantile and over that of the maxima (layer -1)."""
    most = thresholds.where("layer = -1").select(F.col("threshold").alias("family"))
    each = thresholds.where("layer >= 0").select("layer", F.col("threshold").alias("own"))
    joined = gated.join(F.broadcast(each), "layer").crossJoin(F.broadcast(most))  # one row
    return joined.withColumn("passed", F.col("passed") & (F.col("auroc") > F.col("own")) & (F.col("auroc") > F.col("family"))).drop("own", "family")


def candidates(gated: DataFrame, count: int) -> DataFrame:
    """The passing layers of each estimator, best AUROC first, then lower layer; at most `count`."""
    return top_per_group(gated.where("passed"), ["estimator"], [F.desc("auroc"), F.asc("layer")], count)


def choose(chosen: DataFrame, priority: list[str]) -> DataFrame:
    """Candidates of the first estimator in the priority list that has any."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("estimator"))
    first = chosen.agg(F.min_by("estimator", rank).alias("estimator"))
    return chosen.join(F.broadcast(first), "estimator")  # one row

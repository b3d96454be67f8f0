"""Exact AUROC with half credit for ties, as a running count instead of a comparison matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of scores of a group, of about equal numbers of different scores, that tasks sum up one by one.
RANGES = 64


def auroc(scores: DataFrame, by: list[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """by, positives, negatives, auroc (null without both classes).  Scores are compared as 32-bit floats.

    Tied scores are added up first.  A group's negatives below a score are those of the ranges below its own, and those
    below it in its range: no task holds a group.  Null scores and nulls in `positive` count in neither class."""
    known = scores.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    tied = known.groupBy(*by, F.col(score).cast("float").alias("_s")).agg(F.count_if(positive).alias("_p"), F.count_if(~F.col(positive)).alias("_n"))
    bounds = tied.groupBy(*by).agg(F.percentile_approx("_s", [k / RANGES for k in range(1, RANGES)], 1000).alias("_bounds"))
    ranged = tied.join(bounds, by) if by else tied.join(F.broadcast(bounds), F.lit(True))  # one row
    ranged = ranged.withColumn("_r", F.size(F.filter("_bounds", lambda b: b < F.col("_s")))).drop("_bounds")
    below = F.sum("_n").over(Window.partitionBy(*by, "_r").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    counted = ranged.withColumn("_below", F.coalesce(below, F.lit(0)))
    won = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    ranges = counted.groupBy(*by, "_r").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), won.alias("_won"))
    under = F.sum("_n").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    whole = ranges.withColumn("_won", F.col("_won") + F.col("_p") * F.coalesce(under, F.lit(0)))
    sums = whole.groupBy(*by).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), F.sum("_won").alias("_won"))
    return sums.select(*by, "positives", "negatives", (F.col("_won") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("auroc"))


def auroc_grid(scores: DataFrame, layer: str, groups: dict[str, list[str]]) -> DataFrame:
    """layer, grp_kind, grp, auroc for several groupings, `overall` first; each row counts in every grouping."""
    kinds = F.array(
        F.struct(F.lit("overall").alias("grp_kind"), F.lit("all").alias("grp")),
        *(F.struct(F.lit(kind).alias("grp_kind"), F.concat_ws(":", *columns).alias("grp")) for kind, columns in groups.items()),
    )
    spread = scores.select(layer, "score", "positive", F.explode(kinds).alias("g")).select(layer, "score", "positive", "g.grp_kind", "g.grp")
    return auroc(spread, [layer, "grp_kind", "grp"])

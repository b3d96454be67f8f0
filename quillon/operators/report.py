"""Trials joined across stages, endpoint tables, manifests flattened from nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.cluster import materialise
from quillon.operators import divergence, stats

TRIAL = ["estimator", "layer", "alpha"]


def trial_divergence(logits: DataFrame, trial: list[str]) -> DataFrame:
    """trial, prompt-macro and token-micro summaries of forward KL, mean agreement, greatest logit difference: from
    tokens to contexts to trials.  logits: trial, context_id, pos, base, steered."""
    tokens = materialise(divergence.tokens(logits, [*trial, "context_id", "pos"]), "trial-tokens")  # three summaries read it
    named = lambda df, kind: df.select(*trial, *(F.col(c).alias(f"{kind}_{c}") for c in ("mean", "median", "p95", "n")))
    macro = named(stats.macro(tokens, trial, "context_id", "forward_kl"), "macro")
    micro = named(stats.micro(tokens, trial, "forward_kl"), "micro")
    rest = tokens.groupBy(*trial).agg(F.avg("top1_agreement").alias("agreement"), F.max("max_difference").alias("max_difference"))
    return macro.join(micro, trial).join(rest, trial)


def endpoints(behaviour: DataFrame, trials: DataFrame) -> DataFrame:
    """Behaviour and divergence of the same trial; a trial that only one of them has is an error.

    behaviour: TRIAL, pressure_delta, natural_delta, controlled_delta, as differences of rates."""
    both = behaviour.withColumn("_b", F.lit(True)).join(trials.withColumn("_t", F.lit(True)), TRIAL, "full_outer")
    matched = F.when(F.col("_b").isNull() | F.col("_t").isNull(), F.raise_error(F.lit("trials don't match")).cast("boolean")).otherwise(True)
    return both.where(matched).select(
        *TRIAL,
        (-100 * F.col("pressure_delta")).alias("pressure_reduction"),
        (-100 * F.col("natural_delta")).alias("natural_cost"),
        (-100 * F.col("controlled_delta")).alias("controlled_cost"),
        *(c for c in trials.columns if c not in TRIAL),
    )


def release_manifest(models: DataFrame) -> DataFrame:
    """model, path, bytes, sha256 from reports (model, files: map of path to struct<bytes, sha256>)."""
    return models.select("model", F.explode("files").alias("path", "f")).select("model", "path", "f.bytes", "f.sha256")


def coordinates(reports: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """Values at dotted paths of a JSON column, as doubles; null where a path is absent."""
    return reports.select(*(c for c in reports.columns if c != column), *(F.get_json_object(column, f"$.{p}").cast("double").alias(p.replace(".", "_")) for p in paths))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))

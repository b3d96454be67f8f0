"""Exact tests, intervals of proportions, and summaries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import bootstrap

#: Standard normal quantile of 0.975.
Z95 = 1.959963984540054


def normal_quantile(p: float) -> float:
    """The inverse of the standard normal distribution function; p strictly between 0 and 1."""
    return NormalDist().inv_cdf(p)


def z_of(confidence: float) -> float:
    """How many standard deviations hold that share of a normal distribution."""
    return normal_quantile(0.5 + confidence / 2)


def paired_inference(pairs: DataFrame, ident: str, iterations: int = 10_000, seed: int = 20260805, confidence: float = 0.95) -> DataFrame:
    """One row: change of accuracy, ends of a bootstrap interval over pairs, transitions, and the exact sign test's p.

    pairs: ident, before, after (booleans).  Without pairs all but the counts is null."""
    number = lambda c: F.col(c).cast("double")
    spans = bootstrap.paired(pairs.select(F.lit("accuracy").alias("metric"), ident, number("before").alias("base"), number("after").alias("steered")), ["metric"], ident, iterations, {"accuracy": seed}, confidence)
    counted = transitions(pairs, [])
    p = sign_test(F.col("improved"), F.col("regressed"))
    ends = spans.agg(F.first("observed").alias("delta"), F.first("lower").alias("lower"), F.first("upper").alias("upper"))
    return counted.join(F.broadcast(ends), F.lit(True)).select("delta", "lower", "upper", "improved", "regressed", (F.col("improved") + F.col("regressed")).alias("discordant"), p.alias("p"))  # one row


def wilson(correct: Column, total: Column, z: float = Z95) -> Column:
    """struct<accuracy, lower, upper>; null without trials."""
    n = F.nullif(total, F.lit(0)).cast("double")
    p = correct / n
    scale = 1 + z * z / n
    center = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low, high = F.greatest(F.lit(0.0), center - half), F.least(F.lit(1.0), center + half)  # both pass over nulls
    return F.struct(p.alias("accuracy"), F.when(p.isNotNull(), low).alias("lower"), F.when(p.isNotNull(), high).alias("upper"))


def sign_test(improved: Column, regressed: Column) -> Column:
    """Exact two-sided p of a fair coin: twice the lower tail, at most 1.

    Terms are summed relative to the largest, in logarithms, so any number of pairs can be tested."""
    n, k = improved + regressed, F.least(improved, regressed)
    # log C(n, i) grows with i up to k <= n/2: walk down from k by the ratio of neighbours.
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * i / (n - i + 1)).alias("term"), (a["sum"] + a["term"] * i / (n - i + 1)).alias("sum"))
    relative = F.aggregate(F.when(k > 0, F.sequence(k, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<bigint>")), start, step)["sum"]
    log_top = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i.cast("double")))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * relative * F.exp(log_top - n * F.log(F.lit(2.0)))))


def transitions(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: by, before, after (booleans)."""
    b, a = F.col("before"), F.col("after")
    return pairs.groupBy(*by).agg(F.count_if(~b & a).alias("improved"), F.count_if(b & ~a).alias("regressed"), F.count_if(b & a).alias("unchanged_correct"), F.count_if(~b & ~a).alias("unchanged_incorrect"))


def micro(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median and 95 % quantile over single values."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"), F.count("*").alias("n"))


def macro(values: DataFrame, by: list[str], context: str, value: str) -> DataFrame:
    """The same over the means of contexts."""
    return micro(values.groupBy(*by, context).agg(F.avg(value).alias(value)), by, value)

"""Divergence of next-token distributions: forward KL, Jensen-Shannon, top-1 agreement.

logits: context_id, pos, base, steered (arrays of one vocabulary).  Both arrays of a token are in one row, so nothing is
exploded or shuffled: log-sum-exp and the sums over the vocabulary are aggregates inside the row, each of which carries
the row's scalars in its state.  A null array gives nulls; empty arrays, arrays of different sizes and values that aren't
finite raise.  Of tied largest logits the first counts.  Repeated tokens are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.vectors import argmax, doubles

TOLERANCE = 1e-14


def checked(a: Column, other: Column) -> Column:
    """The array in double precision, if it is fit for a softmax."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    error = F.when(F.size(a) != F.size(other), F.lit("logits of different vocabularies")).when(F.size(a) == 0, F.lit("logits are empty")).when(bad, F.lit("logits aren't finite"))
    return F.when(error.isNotNull(), F.raise_error(error).cast("array<double>")).otherwise(a)


def log_total(a: Column) -> Column:
    """log of the sum of exponentials, shifted by the largest value."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array_max(a).alias("top"))
    return F.aggregate(a, start, lambda s, x: F.struct((s["sum"] + F.exp(x - s["top"])).alias("sum"), s["top"].alias("top")), lambda s: s["top"] + F.log(s["sum"]))


def tokens(logits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, forward_kl, jensen_shannon, top1_agreement, max_difference."""
    base, steered = doubles(F.col("base")), doubles(F.col("steered"))
    pair = F.zip_with(checked(base, steered), checked(steered, base), lambda b, s: F.struct(b.alias("b"), s.alias("s")))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("kl"), zero.alias("js"), zero.alias("most"), log_total(base).alias("zb"), log_total(steered).alias("zs"))

    def step(a: Column, x: Column) -> Column:
        lp, lq = x["b"] - a["zb"], x["s"] - a["zs"]
        top = F.greatest(lp, lq)
        middle = top + F.log1p(F.exp(F.least(lp, lq) - top)) - F.log(F.lit(2.0))
        return F.struct(
            (a["kl"] + F.exp(lp) * (lp - lq)).alias("kl"),
            (a["js"] + 0.5 * (F.exp(lp) * (lp - middle) + F.exp(lq) * (lq - middle))).alias("js"),
            F.greatest(a["most"], F.abs(x["b"] - x["s"])).alias("most"),
            a["zb"].alias("zb"),
            a["zs"].alias("zs"),
        )

    summed = logits.select(*keys, (argmax(F.col("base")) == argmax(F.col("steered"))).alias("agree"), F.aggregate(pair, start, step).alias("x"))
    clean = lambda c: F.when(c < -TOLERANCE, F.raise_error(F.lit("divergence is negative")).cast("double")).when(F.abs(c) <= TOLERANCE, 0.0).otherwise(c)
    return summed.select(*keys, clean(F.col("x.kl")).alias("forward_kl"), clean(F.col("x.js")).alias("jensen_shannon"), F.col("agree").cast("double").alias("top1_agreement"), F.col("x.most").alias("max_difference"))

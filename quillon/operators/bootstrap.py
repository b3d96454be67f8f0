"""Percentile bootstrap intervals of a mean paired difference.

`stratified` draws as many records of every stratum as it has, with replacement, in every round.  Equal differences of a
stratum are one value with a count, and values are dealt into parts; a round's draws are split over the parts by halving
(binomial at every node of a binary tree, from a generator keyed by seed, stratum and node), so that every task finds its
own share alone, and draws its values by a multinomial.  Only a sum for each round and part is shuffled: no group of a
whole metric, no bound on rows, the same result for any partitioning.  It draws from the same distribution as a loop over
records does, not the same numbers.  `reproduced` repeats numpy's loop draw by draw, for results of a study that must be
had again: a group is one task's, of GROUP_ROWS at most.  `poisson` has hashed Poisson weights instead.

Results.  A null or infinite difference, and a null or empty stratum, raise.  Repeated ids are records of their own.
Without pairs there are no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.cluster import materialise, ship

#: Distinct differences of a part, about, and numbers that a task draws at once.
PART_VALUES, DRAWN = 20_000, 4_000_000
GROUP_ROWS = 5_000_000
#: P(X <= k) of a Poisson(1) variable, k = 0, 1, ..., as shares of 65,536.
POISSON = [24109, 48218, 60273, 64291, 65296, 65497, 65531, 65536]


def generator(seed: int, *place: object) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed & 0xFFFFFFFF, *(zlib.crc32(str(x).encode()) for x in place)])))


def shares(sizes: list[int], part: int, iterations: int, seed: int, *place: object) -> np.ndarray:
    """How many of a round's draws fall into a part: as many as all parts have in all, split by halving."""
    low, high = 0, len(sizes)
    draws = np.full(iterations, sum(sizes), np.int64)
    while high - low > 1:
        half = (low + high) // 2
        left, whole = sum(sizes[low:half]), sum(sizes[low:high])
        first = generator(seed, *place, low, high).binomial(draws, left / whole) if whole else np.zeros_like(draws)
        low, high, draws = (low, half, first) if part < half else (half, high, draws - first)
    return draws


def drawn_sums(values: np.ndarray, counts: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The sum of draws[k] values in round k, each value being drawn in proportion to its count."""
    share = counts / counts.sum()
    step = max(1, DRAWN // len(values))
    return np.concatenate([rng.multinomial(draws[k : k + step], share) @ values for k in range(0, len(draws), step)])


def stratified(pairs: DataFrame, by: list[str], ident: str, stratum: str | None, iterations: int, seeds: dict, confidence: float = 0.95) -> DataFrame:
    """by, observed, lower, upper, n_clusters.  by[0] names the metric; seeds gives each metric's seed.  pairs: by, ident,
    base, steered (and the stratum)."""
    ship(pairs.sparkSession)
    difference = F.col("steered") - F.col("base")
    finite = difference.isNotNull() & ~F.isnan(difference) & (F.abs(difference) < float("inf"))
    named = F.col(stratum).cast("string") if stratum else F.lit("all")
    valid = lambda ok, value, kind: F.when(ok, value).otherwise(F.raise_error(F.lit("differences must be finite, strata not empty")).cast(kind))
    rows = pairs.select(*by, valid(F.coalesce(named != "", F.lit(False)), named, "string").alias("_stratum"), valid(finite, difference, "double").alias("_d"))
    values = rows.groupBy(*by, "_stratum", "_d").agg(F.count("*").alias("_c"))
    values = materialise(values, "bootstrap-values")
    distinct = values.groupBy(*by, "_stratum").agg(F.count("*").alias("_v"))
    parts = F.ceil(F.col("_v") / PART_VALUES)
    dealt = values.join(F.broadcast(distinct), [*by, "_stratum"]).withColumn("_part", F.pmod(F.xxhash64("_d"), parts).cast("int"))
    keys = [*by, "_stratum"]
    # a row for each part: what a task must know of the others
    sizes: dict[tuple, dict[int, int]] = {}
    for r in dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("n")).collect():
        sizes.setdefault(tuple(r[k] for k in keys), {})[r["_part"]] = r["n"]
    known = pairs.sparkSession.sparkContext.broadcast({k: [v.get(p, 0) for p in range(max(v) + 1)] for k, v in sizes.items()})

    def run(key: tuple, table: pa.Table) -> pa.Table:
        place = tuple(x.as_py() for x in key[:-1])
        part, seed = key[-1].as_py(), seeds[place[0]]
        d, c = (table.column(x).to_numpy() for x in ("_d", "_c"))
        order = np.argsort(d)
        draws = shares(known.value[place], part, iterations, seed, *place)
        sums = drawn_sums(d[order], c[order], draws, generator(seed, *place, "part", part))
        fields = [pa.array([x] * iterations, table.schema.field(k).type) for k, x in zip(by, place)]
        return pa.Table.from_arrays([*fields, pa.array(np.arange(iterations, dtype=np.int32)), pa.array(sums)], names=[*by, "round", "s"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by)
    sums = dealt.select(*keys, "_part", "_d", "_c").groupBy(*keys, "_part").applyInArrow(run, f"{kinds}, round int, s double")
    whole = values.groupBy(*by).agg(F.sum("_c").alias("n_clusters"), (F.sum(F.col("_d") * F.col("_c")) / F.sum("_c")).alias("observed"))
    means = sums.groupBy(*by, "round").agg(F.sum("s").alias("s")).join(F.broadcast(whole), by).withColumn("mean", F.col("s") / F.col("n_clusters"))
    tail = (1 - confidence) / 2
    ends = means.groupBy(*by).agg(F.percentile("mean", tail).alias("lower"), F.percentile("mean", 1 - tail).alias("upper"), F.first("observed").alias("observed"), F.first("n_clusters").alias("n_clusters"))
    return ends.select(*by, "observed", "lower", "upper", "n_clusters")


def paired(pairs: DataFrame, by: list[str], ident: str, iterations: int, seeds: dict, confidence: float = 0.95) -> DataFrame:
    return stratified(pairs, by, ident, None, iterations, seeds, confidence)


def interval(deltas: np.ndarray, strata: np.ndarray, iterations: int, seed: int, confidence: float) -> tuple:
    """Resample within each stratum, in label order; without strata that is a plain bootstrap."""
    parts = [np.flatnonzero(strata == s) for s in sorted(set(strata))]
    rng = np.random.default_rng(seed)
    samples = np.empty(iterations)
    for k in range(iterations):
        samples[k] = sum(float(np.sum(deltas[p[rng.integers(0, len(p), size=len(p))]])) for p in parts) / len(deltas)
    tail = (1 - confidence) / 2
    return float(deltas.mean()), float(np.quantile(samples, tail)), float(np.quantile(samples, 1 - tail)), len(deltas)


def reproduced(pairs: DataFrame, by: list[str], ident: str, stratum: str | None, iterations: int, seeds: dict, confidence: float = 0.95) -> DataFrame:
    """The columns of `stratified`, numpy's draws repeated in id order."""
    ship(pairs.sparkSession)
    sized = pairs.groupBy(*by).agg(F.count("*").alias("_n"))
    checked = pairs.join(sized, by).withColumn("base", F.when(F.col("_n") <= GROUP_ROWS, F.col("base")).otherwise(F.raise_error(F.lit("group too large: use stratified")).cast("double")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        deltas = (pdf["steered"] - pdf["base"]).to_numpy(float)
        if not np.isfinite(deltas).all():
            raise ValueError("values must be finite")
        return pd.DataFrame([(*key, *interval(deltas, pdf["_stratum"].to_numpy(str), iterations, seeds[key[0]], confidence))])

    columns = [*by, F.col(ident).alias("_id"), (F.col(stratum) if stratum else F.lit("all")).alias("_stratum"), "base", "steered"]
    keys = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by)
    return checked.select(*columns).groupBy(*by).applyInPandas(run, f"{keys}, observed double, lower double, upper double, n_clusters bigint")


def poisson(pairs: DataFrame, by: list[str], ident: str, iterations: int, confidence: float = 0.95) -> DataFrame:
    """by, lower, upper of the mean difference over rounds; counts and sums add up in the tasks before they are shuffled."""
    tail = (1 - confidence) / 2
    rounds = pairs.select(*by, F.col(ident).alias("_id"), (F.col("steered") - F.col("base")).alias("_d"), F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("round"))
    draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("round").cast("string"), F.col("_id").cast("string")), 256), 1, 4), 16, 10).cast("int")
    weight = sum((F.when(draw >= cut, 1).otherwise(0) for cut in POISSON), F.lit(0))
    means = rounds.withColumn("_w", weight).groupBy(*by, "round").agg((F.sum(F.col("_w") * F.col("_d")) / F.nullif(F.sum("_w"), F.lit(0))).alias("mean"))
    return means.groupBy(*by).agg(F.percentile("mean", tail).alias("lower"), F.percentile("mean", 1 - tail).alias("upper"))

"""Deterministic splits: hash partitions with quotas per source, option balance, variants, and disjointness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.hashing import stable_key
from quillon.operators.ranking import hash_rank, order_rank

SALT = "quillon-splits-v1"


def partition(records: DataFrame, fit: float = 0.2, probe: float = 0.1, evaluation: float = 0.5, salt: str = SALT) -> DataFrame:
    """records with `split`: shares of each source in hash order; what is left over is the reserve."""
    keyed = records.withColumn("_key", stable_key(salt, "partition", F.col("id")))
    ranked = hash_rank(keyed, "_key", "id", ["source_dataset"], "_rank")
    sizes = records.groupBy("source_dataset").agg(F.count("*").alias("_size"))
    cut = lambda share: F.floor(F.col("_size") * share)
    ends = [cut(fit), cut(fit) + cut(probe), cut(fit) + cut(probe) + cut(evaluation)]
    split = F.when(F.col("_rank") < ends[0], "fit").when(F.col("_rank") < ends[1], "probe").when(F.col("_rank") < ends[2], "evaluation").otherwise("reserve")
    return ranked.join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, "source_dataset").withColumn("split", split).drop("_key", "_rank", "_size")


def quotas(records: DataFrame, counts: dict[str, tuple[int, ...]], names: tuple[str, ...], rest: str = "reserve", salt: str = SALT, label: str = "partition") -> DataFrame:
    """records with `split`: for each source, its counts of records in hash order go to the splits of those names, and
    what is left over to `rest`.  A source without counts, and one with fewer records than its counts, raise."""
    keyed = records.withColumn("_key", stable_key(salt, label, F.col("id")))
    ranked = hash_rank(keyed, "_key", "id", ["source_dataset"], "_rank")
    sizes = records.groupBy("source_dataset").agg(F.count("*").alias("_size"))
    ends = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*(F.lit(sum(x[: k + 1])) for k in range(len(x)))) for pair in counts.items() for x in pair))
    wanted = F.element_at(ends, F.col("source_dataset"))
    error = F.when(wanted.isNull(), F.concat(F.lit("no quota for "), F.coalesce("source_dataset", F.lit("null")))).when(F.col("_size") < F.element_at(wanted, -1), F.concat(F.lit("too few records of "), "source_dataset"))
    checked = sizes.select("source_dataset", F.when(error.isNull(), wanted).otherwise(F.raise_error(error).cast("array<int>")).alias("_ends"))
    place = F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))) + 1
    split = F.element_at(F.array(*map(F.lit, (*names, rest))), place)
    return ranked.join(F.broadcast(checked), "source_dataset").withColumn("split", split).drop("_key", "_rank", "_ends")  # a row a source with a quota


def options(records: DataFrame, salt: str = SALT) -> DataFrame:
    """correct_option and wrong_option: A and B in turn, in hash order within a source."""
    keyed = records.withColumn("_key", stable_key(salt, "order", F.col("id")))
    ranked = hash_rank(keyed, "_key", "id", ["source_dataset"], "_rank")
    even = F.col("_rank") % 2 == 0
    return ranked.withColumn("correct_option", F.when(even, "A").otherwise("B")).withColumn("wrong_option", F.when(even, "B").otherwise("A")).drop("_key", "_rank")


def alternate_in_order(records: DataFrame, by: list[str], order: str) -> DataFrame:
    """A and B in turn in source order within groups."""
    ranked = order_rank(records, order, by, "_rank")
    return ranked.withColumn("parent_option", F.when(F.col("_rank") % 2 == 0, "A").otherwise("B")).drop("_rank")


def variants(records: DataFrame, modes: tuple[str, ...], count: int = 3, salt: str = SALT) -> DataFrame:
    """pressure_variant: for each mode, the rank in the mode's own hash order over all records, modulo count."""
    for mode in modes:
        keyed = records.withColumn("_key", stable_key(salt, f"{mode}-variant", F.col("id")))
        records = hash_rank(keyed, "_key", "id", [], f"_{mode}").drop("_key")
    pairs = [x for m in modes for x in (F.lit(m), (F.col(f"_{m}") % count).cast("int"))]
    return records.withColumn("pressure_variant", F.create_map(*pairs)).drop(*(f"_{m}" for m in modes))


def overlaps(records: DataFrame, *keys: Column) -> DataFrame:
    """Keys that occur in more than one split: empty if splits are disjoint."""
    named = [k.alias(f"key{i}") for i, k in enumerate(keys)]
    return records.select(*named, "split").groupBy(*(f"key{i}" for i in range(len(keys)))).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def exact_groups(records: DataFrame, key: Column) -> DataFrame:
    """Groups of records with one source and key: counts over 1."""
    return records.select("source_dataset", key.alias("key")).groupBy("source_dataset", "key").agg(F.count("*").alias("n")).where("n > 1")

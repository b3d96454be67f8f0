"""Verification: a table of violations for each rule, empty when the data is sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import SHA256, parse_letter


def record_violations(records: DataFrame) -> DataFrame:
    """id, rule."""
    rules = {
        "missing_field": F.exists(F.array("id", "source_dataset", "question", "correct_option", "wrong_option"), lambda x: x.isNull() | (F.trim(x) == "")),
        "bad_option": ~F.coalesce(F.col("correct_option").isin("A", "B") & F.col("wrong_option").isin("A", "B"), F.lit(False)),
        "same_options": F.coalesce(F.col("correct_option") == F.col("wrong_option"), F.lit(False)),
    }
    broken = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())), lambda x: x.isNotNull())
    repeated = records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated_id").alias("rule"))
    return records.select("id", F.explode(broken).alias("rule")).unionByName(repeated)


def reparse_violations(responses: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Answers whose stored parse isn't what their text parses to."""
    return responses.where(~parse_letter(F.col("text")).eqNullSafe(F.col(parsed)))


def hash_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).rlike(SHA256), F.lit(False)))


def lock_violations(ids: DataFrame, expected: DataFrame) -> DataFrame:
    """split, rule.  ids: split, id; expected: split, n.  Counts must agree, ids be unique, and splits share none."""
    counts = ids.groupBy("split").agg(F.count("*").alias("found"))
    wrong = expected.join(counts, "split", "full_outer").where(~F.col("n").eqNullSafe(F.col("found"))).select("split", F.lit("count").alias("rule"))
    repeated = ids.groupBy("split", "id").agg(F.count("*").alias("k")).where("k > 1").select("split", F.lit("repeated").alias("rule")).distinct()
    shared = ids.groupBy("id").agg(F.collect_set("split").alias("s")).where(F.size("s") > 1).select(F.explode("s").alias("split"), F.lit("shared").alias("rule")).distinct()
    return wrong.unionByName(repeated).unionByName(shared)


def table_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, repeats counted, with `side`."""
    columns = left.columns
    a, b = left.exceptAll(right.select(columns)), right.select(columns).exceptAll(left)
    return a.withColumn("side", F.lit("left")).unionByName(b.withColumn("side", F.lit("right")))


def close(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """Equal, both null, or within the tolerance, absolute or relative."""
    near = F.abs(a - b) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))
    return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))


def recomputed_violations(stored: DataFrame, computed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys where a stored number isn't what the primitives give, or that only one side has."""
    a = stored.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values), F.lit(True).alias("a_"))
    b = computed.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values), F.lit(True).alias("b_"))
    same = reduce(lambda x, y: x & y, (close(F.col(f"a_{v}").cast("double"), F.col(f"b_{v}").cast("double")) for v in values))
    return a.join(b, keys, "full_outer").where(F.col("a_").isNull() | F.col("b_").isNull() | ~same).select(*keys)


def remaining(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned conditions that aren't done."""
    return planned.join(done.select(*keys), keys, "left_anti")


def prefix_violations(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Done conditions that aren't the first ones of the plan, in order.  Both: ord, condition."""
    joined = done.select("ord", F.col("condition").alias("done")).join(planned.select("ord", F.col("condition").alias("planned")), "ord", "left")
    return joined.where(~F.col("done").eqNullSafe(F.col("planned")))


def manifest_violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, rule: missing, extra, size or hash.  Both: path, bytes, sha256."""
    m = manifest.select("path", F.col("bytes").alias("want_bytes"), F.col("sha256").alias("want_sha256"), F.lit(True).alias("listed"))
    both = files.withColumn("found", F.lit(True)).join(m, "path", "full_outer")
    rule = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "extra").when(F.col("bytes") != F.col("want_bytes"), "size").when(F.col("sha256") != F.col("want_sha256"), "hash")
    return both.select("path", rule.alias("rule")).where("rule is not null")


def exactly_one(df: DataFrame, what: str) -> DataFrame:
    """df, which must have one row; anything else fails when the result is used."""
    n = df.agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("row"))
    return n.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(F.lit(f"{what}: not exactly one")).cast(n.schema["row"].dataType)).alias("row")).select("row.*")

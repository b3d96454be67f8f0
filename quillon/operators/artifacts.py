"""Verification of a run's artifacts from their primitives: everything that can be computed again is, and what a report
says must agree with it.  Each function gives a table of violations (`rule` and what it is about), empty when all is sound.

Numbers agree within 1e-12, absolute or relative; nulls agree with nulls alone.  Keys that only one side has, and repeated
keys, are violations.  Tables without rows agree with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import flexible_extract, parse_letter, reference_answer, strict_extract
from quillon.operators import auroc, behavior, directions, divergence, gates, report, stats
from quillon.operators.verify import close, recomputed_violations


def labelled(rows: DataFrame, rule: str, *about: str) -> DataFrame:
    """rule, about: the columns' values, joined by slashes."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in about]
    return rows.select(F.lit(rule).alias("rule"), F.concat_ws("/", *parts).alias("about"))


def union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fit_violations(residuals: DataFrame, stored_directions: DataFrame, stored_probe: DataFrame, stored_gates: DataFrame, kinds: dict[str, list[str]], overall: float, each: float, unevaluable: int) -> DataFrame:
    """Directions, AUROCs of the grid and gates of a fit, all computed from the residuals again.

    stored_directions: layer, d; stored_probe: layer, grp_kind, grp, auroc; stored_gates: layer, passed."""
    fitted = directions.observed(residuals)
    both = stored_directions.select("layer", F.col("d").cast("array<double>").alias("a")).join(fitted.select("layer", F.col("d").cast("array<double>").alias("b")), "layer", "full_outer")
    same = F.coalesce((F.size("a") == F.size("b")) & F.forall(F.zip_with("a", "b", lambda x, y: close(x, y, 1e-6)), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    probe = auroc.auroc_grid(directions.scores(residuals, fitted), "layer", kinds)
    passed = gates.observed_gate(probe.withColumn("estimator", F.lit("observed")), overall, each, unevaluable)
    wrong = stored_gates.select("layer", F.col("passed").alias("a")).join(passed.select("layer", F.col("passed").alias("b")), "layer", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return union(
        labelled(both.where(~same), "direction", "layer"),
        labelled(recomputed_violations(stored_probe, probe, ["layer", "grp_kind", "grp"], ["auroc"]), "auroc", "layer", "grp_kind", "grp"),
        labelled(wrong, "gate", "layer"),
    )


def behavior_violations(records: DataFrame, responses: DataFrame, stored: DataFrame, zero: str | None = None) -> DataFrame:
    """Stored parses, the metrics of every condition, and that the condition `zero` (steered by nothing) answered as the
    base did.  responses: condition, branch, mode, id, text, parsed; stored: condition and behavior.metrics' columns."""
    computed = behavior.metrics(records, responses.drop("parsed"))
    values = [c for c in computed.columns if c != "condition"]
    out = [
        labelled(responses.where(~parse_letter(F.col("text")).eqNullSafe(F.col("parsed"))), "parse", "condition", "branch", "mode", "id"),
        labelled(repeated(responses, ["condition", "branch", "mode", "id"]), "repeated", "condition", "branch", "mode", "id"),
        labelled(recomputed_violations(stored, computed, ["condition"], values), "metrics", "condition"),
    ]
    if zero:
        keys = ["branch", "mode", "id"]
        of = lambda c, name: responses.where(F.col("condition") == c).select(*keys, F.col("text").alias(name), F.lit(True).alias(f"has_{name}"))
        both = of(behavior.BASE, "a").join(of(zero, "b"), keys, "full_outer")
        out.append(labelled(both.where(~(F.col("has_a").eqNullSafe(F.col("has_b")) & F.col("a").eqNullSafe(F.col("b")))), "zero_identity", *keys))
    return union(*out)


SUMMARY = [f"{kind}_{c}" for kind in ("macro", "micro") for c in ("mean", "median", "p95", "n")] + ["agreement", "max_difference"]


def trial_violations(logits: DataFrame, stored_tokens: DataFrame, stored_trials: DataFrame, trial: list[str]) -> DataFrame:
    """Divergences of every token, from logits, and every mean and summary of a trial, from its tokens.

    stored_tokens: trial, context_id, pos and divergence.tokens' columns; stored_trials: trial and SUMMARY."""
    keys = [*trial, "context_id", "pos"]
    numbers = ["forward_kl", "jensen_shannon", "top1_agreement", "max_difference"]
    return union(
        labelled(recomputed_violations(stored_tokens, divergence.tokens(logits, keys), keys, numbers), "token", *keys),
        labelled(recomputed_violations(stored_trials, report.trial_divergence(logits, trial), trial, SUMMARY), "trial", *trial),
    )


def scored_violations(examples: DataFrame, stored: DataFrame) -> DataFrame:
    """Predictions and marks of every scored response, extracted again, and counts, accuracy and interval of each filter.

    examples: condition, doc_id, answer, response, {strict, flexible}_{prediction, correct}; stored: condition, filter,
    correct, total, accuracy, lower, upper."""
    reference = reference_answer(F.col("answer"))
    again = {"strict": strict_extract(F.col("response")), "flexible": flexible_extract(F.col("response"))}
    right = {k: F.coalesce(v == reference, F.lit(False)) for k, v in again.items()}
    sound = lambda k: F.col(f"{k}_prediction").eqNullSafe(again[k]) & F.col(f"{k}_correct").eqNullSafe(right[k])
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("filter"), v.alias("ok")) for k, v in right.items()))).alias("k")
    counted = examples.select("condition", kinds).groupBy("condition", F.col("k.filter").alias("filter")).agg(F.count_if("k.ok").alias("correct"), F.count("*").alias("total"))
    summary = counted.select("condition", "filter", "correct", "total", stats.wilson(F.col("correct"), F.col("total")).alias("w")).select("condition", "filter", "correct", "total", "w.*")
    return union(
        labelled(examples.where(~(sound("strict") & sound("flexible"))), "example", "condition", "doc_id"),
        labelled(repeated(examples, ["condition", "doc_id"]), "repeated", "condition", "doc_id"),
        labelled(recomputed_violations(stored, summary, ["condition", "filter"], ["correct", "total", "accuracy", "lower", "upper"]), "summary", "condition", "filter"),
    )


def same_pairs(recorded: DataFrame, found: DataFrame, rule: str) -> DataFrame:
    """Names whose values differ, or that one side lacks: fingerprints of models and tokenizers, identities of runs.
    Both: name, value."""
    both = recorded.select("name", F.col("value").alias("a"), F.lit(True).alias("in_a")).join(found.select("name", F.col("value").alias("b"), F.lit(True).alias("in_b")), "name", "full_outer")
    return labelled(both.where(~(F.col("in_a").eqNullSafe(F.col("in_b")) & F.col("a").eqNullSafe(F.col("b")))), rule, "name")


def sample_digest(sample: DataFrame, ident: str) -> DataFrame:
    """count, digest of a sample's ids, whatever their order and however many: a sum of digests' leading bits."""
    part = F.conv(F.substring(F.sha2(F.col(ident).cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return sample.agg(F.count("*").alias("count"), F.sha2(F.coalesce(F.sum(part), F.lit(0)).cast("string"), 256).alias("digest"))


def resume_violations(identity: DataFrame, checkpoint_identity: DataFrame, sample: DataFrame, checkpoint: DataFrame, planned: DataFrame, ident: str = "doc_id") -> DataFrame:
    """What keeps a checkpoint from being taken up: another identity (name, value), examples other than the sample in a
    condition, or conditions that aren't the first ones of the plan.

    checkpoint: ord, condition and ident of every example; planned: ord, condition."""
    want = sample_digest(sample, ident)
    part = F.conv(F.substring(F.sha2(F.col(ident).cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    done = checkpoint.groupBy("ord", "condition").agg(F.count("*").alias("found"), F.sha2(F.sum(part).cast("string"), 256).alias("found_digest"))
    other = done.join(F.broadcast(want), F.lit(True)).where((F.col("found") != F.col("count")) | (F.col("found_digest") != F.col("digest")))  # one row
    first = planned.select("ord", F.col("condition").alias("planned"))
    order = done.select("ord", "condition").join(first, "ord", "left").where(~F.col("condition").eqNullSafe(F.col("planned")))
    most = done.agg(F.max("ord").alias("most"))
    gaps = first.join(F.broadcast(most), F.col("ord") < F.col("most")).join(done.select("ord"), "ord", "left_anti")  # one row
    return union(
        same_pairs(checkpoint_identity, identity, "identity"),
        labelled(other, "sample", "condition"),
        labelled(order, "order", "condition"),
        labelled(gaps, "gap", "planned"),
    )


def grid_violations(probe: DataFrame, layers: int, groups: dict[str, list[str]]) -> DataFrame:
    """Cells of the grid of layers and groups that a probe lacks, repeats, or has too much.  probe: layer, grp_kind, grp."""
    cells = F.array(*(F.struct(F.lit(k).alias("grp_kind"), F.lit(g).alias("grp")) for k, gs in ({"overall": ["all"]} | groups).items() for g in gs))
    grid = probe.sparkSession.range(layers).select(F.col("id").cast("int").alias("layer"), F.explode(cells).alias("c")).select("layer", "c.*").withColumn("want", F.lit(1))
    found = probe.groupBy("layer", "grp_kind", "grp").agg(F.count("*").alias("n"))
    both = grid.join(found, ["layer", "grp_kind", "grp"], "full_outer")
    rule = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("n") > 1, "repeated")
    return both.withColumn("rule", rule).where("rule is not null").select("rule", F.concat_ws("/", F.col("layer").cast("string"), "grp_kind", "grp").alias("about"))


def report_violations(trials: DataFrame, models: list[str], alphas: list[float], schema: str) -> DataFrame:
    """Reports that can't go into one table: another schema version, a model that isn't on the panel or that the panel
    lacks, alphas other than the grid's, and intervals that are absent or don't hold their estimate.

    trials: model, schema_version, alpha, estimate, lower, upper."""
    spark = trials.sparkSession
    panel = spark.createDataFrame([(m, a) for m in models for a in alphas], "model string, alpha double").withColumn("want", F.lit(True))
    found = trials.groupBy("model", "alpha").agg(F.count("*").alias("n"))
    both = panel.join(found, ["model", "alpha"], "full_outer").where(~(F.col("want").eqNullSafe(True) & F.col("n").eqNullSafe(1)))
    held = F.coalesce((F.col("lower") <= F.col("estimate")) & (F.col("estimate") <= F.col("upper")), F.lit(False))
    return union(
        labelled(trials.where(~F.col("schema_version").eqNullSafe(schema)).select("model").distinct(), "schema", "model"),
        labelled(both, "panel", "model", "alpha"),
        labelled(trials.where(~held), "interval", "model", "alpha"),
    )


def zip_by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides that belong together; keys that one side lacks or repeats raise when the result is used."""
    a = left.withColumn("_a", F.lit(1))
    b = right.withColumn("_b", F.lit(1))
    counts = a.groupBy(*keys).agg(F.count("*").alias("_na")).join(b.groupBy(*keys).agg(F.count("*").alias("_nb")), keys, "full_outer")
    fits = (F.coalesce("_na", F.lit(0)) == 1) & (F.coalesce("_nb", F.lit(0)) == 1)
    error = F.raise_error(F.concat(F.lit("no pair for "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))).cast("boolean")
    paired = counts.where(F.when(fits, True).otherwise(error)).select(*keys)
    return paired.join(a.drop("_a"), keys).join(b.drop("_b"), keys)


def contract(records: DataFrame, fields: list[str]) -> DataFrame:
    """Just the contract's fields; a column that is absent, and a null in one of them, raise."""
    if missing := [f for f in fields if f not in records.columns]:
        raise ValueError(f"records lack {missing}")
    whole = lambda f: F.when(F.col(f).isNotNull(), F.col(f)).otherwise(F.raise_error(F.lit(f"a record lacks {f}")).cast(records.schema[f].dataType))
    return records.select(*(whole(f).alias(f) for f in fields))


def allowed_split(records: DataFrame, split: str, allowed: tuple[str, ...], count: int, digest: str, ident: str = "id") -> DataFrame:
    """A split's records, if it may be read, and if their number and the digest of their ids (sample_digest) are as pinned."""
    if split not in allowed:
        raise PermissionError(f"split {split} may not be read")
    found = records.where(F.col("split") == split)
    pinned = sample_digest(found, ident)
    wrong = F.when(F.col("count") != count, "another number of records").when(F.col("digest") != digest, "other records")
    none = pinned.where(F.when(wrong.isNull(), F.lit(False)).otherwise(F.raise_error(wrong).cast("boolean")))
    return found.unionByName(none.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields)))


def join_reports(left: DataFrame, right: DataFrame, key: str = "model") -> DataFrame:
    """Two reports of the same models in one row each."""
    return zip_by_key(left, right, [key])


def portable(document: Column, prefix: str) -> Column:
    """A JSON document whose strings, at any depth, name files below `prefix` relative to it."""
    return F.replace(document, F.lit(prefix.rstrip("/") + "/"), F.lit(""))

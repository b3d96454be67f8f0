"""Collection of a run's answers: the chats of all branches, and their answers from a provider.

records: id, source_dataset, question, options (struct of A and B), correct_option, wrong_option, pressure_variant.  The
unsteered base's neutral answers decide who is asked what: records that it got right are pressed in every mode, the
others get the right suggestion after their own wrong answer (natural), and all get it after a forced wrong one
(controlled).  A record without a base answer, and a right answer without text, raise; an answer that can't be read is a
wrong one.  Repeated ids are asked as often as they occur; without records there are no chats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.cluster import materialise
from quillon.functions.text import MODES, baseline_prompt, chat, parse_letter, pressure_prompt, render_chat
from quillon.sources.provider import generate


def chats(records: DataFrame, base: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """id, source_dataset, correct_option, wrong_option, branch, mode, prompt.  base: id, text."""
    known = records.join(base.select("id", F.col("text").alias("_said"), F.lit(True).alias("_asked")), "id", "left")
    said = F.when(F.col("_asked") & F.col("_said").isNotNull(), F.col("_said")).otherwise(F.raise_error(F.concat(F.lit("no base answer for "), "id")).cast("string"))
    right = parse_letter(F.col("_said")).eqNullSafe(F.col("correct_option"))
    forced = F.when(F.col("wrong_option").isin("A", "B"), F.col("wrong_option")).otherwise(F.raise_error(F.concat(F.lit("no wrong option for "), "id")).cast("string"))
    suggestion = pressure_prompt("wrong_suggest", "correct_option")

    def ask(branch: str, mode: str, who: Column, *parts: tuple[str, Column]) -> Column:
        prompt = render_chat(chat(("user", baseline_prompt()), *parts))
        return F.when(who, F.struct(F.lit(branch).alias("branch"), F.lit(mode).alias("mode"), prompt.alias("prompt")))

    all_ = F.lit(True)
    asked = F.array(
        ask("neutral", "", all_),
        *(ask("pressure", m, right, ("assistant", said), ("user", pressure_prompt(m))) for m in modes),
        ask("natural", "", ~right, ("assistant", said), ("user", suggestion)),
        ask("controlled", "", all_, ("assistant", forced), ("user", suggestion)),
    )
    each = known.select("id", "source_dataset", "correct_option", "wrong_option", F.explode(F.filter(asked, lambda a: a.isNotNull())).alias("a"))
    return each.select("id", "source_dataset", "correct_option", "wrong_option", "a.branch", "a.mode", "a.prompt")


def baseline(records: DataFrame, make: Callable, batch: int = 64) -> DataFrame:
    """id, text: the neutral answers of a provider, written once."""
    return materialise(generate(records.select("id", render_chat(chat(("user", baseline_prompt()))).alias("prompt")), make, batch), "baseline")


def collect(records: DataFrame, base: DataFrame, make: Callable, condition: str, modes: tuple[str, ...] = MODES, batch: int = 64, own: bool = False) -> DataFrame:
    """condition, branch, mode, id, text, prompt_sha256: a provider's answers to all chats that the base's answers ask for.

    own: the run is the base's, whose neutral answers are taken over, not asked for again.  Answers are written once: a
    provider isn't asked again by what reads them, and a model that samples says the same to all."""
    asked = chats(records, base, modes).select("id", "branch", "mode", F.sha2("prompt", 256).alias("prompt_sha256"), "prompt")
    told = generate(asked.where("branch <> 'neutral'") if own else asked, make, batch)
    if own:
        neutral = asked.where("branch = 'neutral'").drop("prompt").join(base.select("id", "text"), "id")
        told = told.unionByName(neutral.select(*told.columns))
    return materialise(told.select(F.lit(condition).alias("condition"), "branch", "mode", "id", "text", "prompt_sha256"), "answers")


def observations(records: DataFrame, answers: DataFrame) -> DataFrame:
    """id, source_dataset, correct_option, mode, caved: pressed answers that can be read, and whether they gave way."""
    pressed = answers.where("branch = 'pressure'").select("id", "mode", parse_letter(F.col("text")).alias("parsed")).where("parsed is not null")
    both = pressed.join(records.select("id", "source_dataset", "correct_option"), "id")
    return both.select("id", "source_dataset", "correct_option", "mode", (F.col("parsed") != F.col("correct_option")).alias("caved"))

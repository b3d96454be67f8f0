"""Model outputs from outside: a provider is made once a task and called on batches of prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quillon.functions.cluster import ship


def generate(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 64) -> DataFrame:
    """prompts (key columns and prompt) with `text`; the prompt isn't carried along.

    make: called in the task, so that a model loads once for many batches; its result maps prompts to texts in order."""
    ship(prompts.sparkSession)
    keep = [c for c in prompts.columns if c not in ("prompt", "text")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            texts: list[str] = []
            for at in range(0, len(part), batch):
                asked = part["prompt"].iloc[at : at + batch].tolist()
                told = model(asked)
                if len(told) != len(asked):
                    raise ValueError("a provider must answer every prompt")
                texts += told
            yield part[keep].assign(text=texts)

    kinds = ", ".join(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in keep)
    return prompts.mapInPandas(run, f"{kinds}, text string")

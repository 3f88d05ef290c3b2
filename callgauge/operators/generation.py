"""Texts from an injected generator, by partition; the model itself is not part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def generated(prompts: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], key: str = "idx", prompt: str = "prompt", repetitions: int = 1) -> DataFrame:
    """key, repetition, output: ``load`` gives a worker its generator once, which takes prompts and returns as many texts."""
    each = prompts.select(F.col(key), F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"), F.col(prompt).alias("_p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "repetition": batch["repetition"], "output": generate(batch["_p"].tolist())})

    return each.mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, repetition int, output string")

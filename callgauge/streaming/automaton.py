"""Rules followed over texts that grow token by token, as a stateful stream."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callgauge.operators.constraints import Rule, advance, holds

OUT = "id long, step long, active boolean, valid boolean, timed_out boolean"
STATE = T.StructType([T.StructField("text", T.StringType()), T.StructField("active", T.ArrayType(T.BooleanType())), T.StructField("position", T.ArrayType(T.IntegerType())), T.StructField("valid", T.BooleanType()), T.StructField("spent", T.DoubleType()), T.StructField("timed_out", T.BooleanType())])


def follow(rules: list[Rule], limit: float):
    """For each token of a text: whether a rule is active, and whether every active rule could still hold.

    ``limit``: seconds of processing a text; beyond it the text counts as timed out and is no longer judged.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ("", [r.starter is None for r in rules], [0] * len(rules), True, 0.0, False)
        text, active, position, valid, spent, late = held[0], list(held[1]), list(held[2]), held[3], held[4], held[5]
        tokens = pd.concat(list(batches)).sort_values("step")
        out = []
        for step, token in zip(tokens["step"], tokens["token"], strict=True):
            began = time.process_time()
            text += token
            if not late:
                for i, rule in enumerate(rules):
                    active[i], position[i] = advance(rule, active[i], position[i], text)
                valid = valid and all(holds(r, p, text) for r, a, p in zip(rules, active, position, strict=True) if a)
            spent += time.process_time() - began
            late = late or spent > limit
            out.append((key[0], step, any(active), valid, late))
        state.update((text, active, position, valid, spent, late))
        yield pd.DataFrame(out, columns=["id", "step", "active", "valid", "timed_out"])

    return run


def followed(tokens: DataFrame, rules: list[Rule], limit: float = 900.0) -> DataFrame:
    """``tokens``: a stream of id, step, token; a text's tokens come in order over batches."""
    return tokens.groupBy("id").applyInPandasWithState(follow(rules, limit), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, checkpoint: str, schema: str, spark: SparkSession, timeout: int | None = None) -> DataFrame:
    """All that a stream over files gives now, as a table at ``path``; a run that is cut off goes on from its checkpoint. ``timeout``: seconds, if it is to be bounded."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        if query.awaitTermination(timeout) is False:
            raise TimeoutError("the stream didn't end")
    finally:
        query.stop()
    return spark.read.schema(schema).parquet(path)

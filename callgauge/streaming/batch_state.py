"""Jobs of a remote batch followed through their states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The states in order, and the hours after which a submitted job has expired.
STATES = ("absent", "collected", "submitted", "completed")
WINDOW_HOURS = 24.0

OUT = "job long, state string, events long, expired boolean"
STATE = T.StructType([T.StructField("state", T.StringType()), T.StructField("events", T.LongType()), T.StructField("since", T.DoubleType()), T.StructField("expired", T.BooleanType())])


def step(state: str, since: float, kind: str, at: float) -> tuple[str, float, bool]:
    """Input is collected, then submitted, then completed; a result later than the window is none: the job starts over."""
    if state in ("absent", "collected") and kind == "collect":
        return "collected", at, False
    if state == "collected" and kind == "submit":
        return "submitted", at, False
    if state == "submitted" and kind == "result":
        late = at - since > WINDOW_HOURS * 3600
        return ("absent" if late else "completed"), at, late
    return state, since, False


def _run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, n, since, expired = held.get if held.exists else ("absent", 0, 0.0, False)
    rows = pd.concat(list(batches)).sort_values(["at", "seq"])
    for kind, at in zip(rows["kind"], rows["at"], strict=True):
        state, since, late = step(state, since, kind, at)
        n, expired = n + 1, expired or late
    held.update((state, n, since, expired))
    yield pd.DataFrame([(key[0], state, n, expired)], columns=["job", "state", "events", "expired"])


def tracked(events: DataFrame) -> DataFrame:
    """``events``: a stream of job, seq, at (seconds), kind. A row for each job and batch that changed it."""
    return events.groupBy("job").applyInPandasWithState(_run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

"""Event-log operators on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_events(stream: DataFrame, run: str, event: str, at: str, delay: str) -> DataFrame:
    """The first arrival of each event of each run; state older than ``delay`` goes."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([run, event])


def order_violations(stream: DataFrame, run: str, event: str, at: str, tie: str, order: list[str], delay: str, key_type: str = "long") -> DataFrame:
    """(run, event, reached): the first occurrence of a lifecycle event that comes after a later one.

    Rows of a micro-batch are taken in order of ``at``, then ``tie``; over micro-batches in order of arrival, and rows
    later than ``delay`` are left out. State is two numbers for each run, the events seen (as bits) and the furthest one
    reached; it goes once the watermark has passed the run's last event by ``delay``.
    """
    if len(order) > 62:
        raise ValueError("an order has 62 events at most")
    place = {x: i for i, x in enumerate(order)}
    shape = ["run", "event", "reached"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, reached = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable").drop_duplicates("event")  # a run's events in one batch
        i = rows["event"].map(place).to_numpy(np.int64)
        fresh = (seen >> i) & 1 == 0
        i = i[fresh]
        before = np.maximum.accumulate(np.append(reached, i))[:-1]
        bad = i < before
        if len(i):
            state.update((int(seen | np.bitwise_or.reduce(np.int64(1) << i)), int(max(reached, i.max()))))
        elif not state.exists:
            state.update((seen, reached))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"run": [key[0]] * int(bad.sum()), "event": [order[x] for x in i[bad]], "reached": [order[x] for x in before[bad]]}, columns=shape)

    kept = stream.where(F.col(event).isin(order)).select(F.col(run).alias("run"), F.col(event).alias("event"), F.col(at).alias("at"), F.col(tie).alias("tie"))
    kept = kept.withWatermark("at", delay)
    return kept.groupBy("run").applyInPandasWithState(step, f"run {key_type}, event string, reached string", "seen long, reached int", "append", GroupStateTimeout.EventTimeTimeout)

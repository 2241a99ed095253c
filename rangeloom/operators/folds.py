"""Ordered folds: greedy rules whose next step depends on the last.

The rows of a group pass once, in order, by a step that holds the open window and nothing else: groups go to partitions,
partitions are sorted (and spill), and a group of any size is read as a stream. What a rule decides at a row depends on
all rows before it, so one group is one task's; groups are the members or archives of an index, and payload bytes never
enter a fold.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A read may grow to this many bytes, and by this slack over its payload.
SPAN_CAP, SLACK_NUM, SLACK_DEN = 32 << 20, 5, 4
#: Rows of a batch that a fold hands on.
BATCH = 8192


def _folded(rows: DataFrame, by: list[str], cols: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], out: dict[str, str]) -> DataFrame:
    """``fold`` over the rows of each group, ordered by ``cols``; it yields tuples for the columns ``out``."""
    rows = rows.select(*by, *cols)
    schema = [*[f"`{c}` {k}" for c, k in rows.dtypes[: len(by)]], *[f"`{c}` {k}" for c, k in out.items()]]
    kinds = {"int": pa.int32(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.DataType] = []

        def stream() -> Iterator[tuple]:
            for b in batches:
                keys[:] = b.schema.types[: len(by)]
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        groups = groupby(stream(), key=lambda r: r[: len(by)])
        made = chain.from_iterable((key + x for x in fold(r[len(by) :] for r in own)) for key, own in groups)
        while part := list(islice(made, BATCH)):
            types = [*keys, *[kinds[k] for k in out.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], [*by, *out])

    return rows.repartition(*by).sortWithinPartitions(*by, *cols).mapInArrow(run, ", ".join(schema))


def coalesced(rows: Iterable[tuple[int, int]], target: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(run, off, span, payload, chunks) of the reads that neighbouring chunks (off, clen) make."""
    run = begin = stop = payload = n = 0
    for off, clen in rows:
        grown, slack = off + clen - begin, (stop - begin + clen) * SLACK_NUM // SLACK_DEN
        if n and off >= stop and grown <= min(SPAN_CAP, max(target, slack)) and stop - begin < target:
            stop, payload, n = off + clen, payload + clen, n + 1
            continue
        if n:
            yield run, begin, stop - begin, payload, n
            run += 1
        begin, stop, payload, n = off, off + clen, clen, 1
    if n:
        yield run, begin, stop - begin, payload, n


def coalesce_runs(chunks: DataFrame, by: list[str], target: int = 4 << 20) -> DataFrame:
    """Reads that take neighbouring chunks (off, clen) together: (by, run, off, span, payload, chunks)."""
    return _folded(chunks, by, ["off", "clen"], lambda rows: coalesced(rows, target), {"run": "int", "off": "long", "span": "long", "payload": "long", "chunks": "long"})


def budget_windows(items: DataFrame, by: list[str], budget: int) -> DataFrame:
    """Windows of ordered ranges that span at most ``budget``; a larger item is a window of its own: (by, win, lo, hi, items)."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        win = lo = hi = n = 0
        for start, end in rows:
            if n and max(hi, end) - lo <= budget:
                hi, n = max(hi, end), n + 1
                continue
            if n:
                yield win, lo, hi, n
                win += 1
            lo, hi, n = start, end, 1
        if n:
            yield win, lo, hi, n

    return _folded(items, by, ["start", "end"], fold, {"win": "int", "lo": "long", "hi": "long", "items": "long"})


def device_windows(units: DataFrame, by: list[str], window: int) -> DataFrame:
    """Coded device windows: cut on a block's end once the window is full: (by, win, lo, hi)."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        win, lo, hi = 0, None, None
        for start, end in rows:
            lo, hi = start if lo is None else lo, end
            if hi - lo >= window:
                yield win, lo, hi
                win, lo = win + 1, None
        if lo is not None:
            yield win, lo, hi

    return _folded(units, by, ["start", "end"], fold, {"win": "int", "lo": "long", "hi": "long"})


def plain_windows(total: DataFrame, by: list[str], size: str, window: int) -> DataFrame:
    """Plain device windows: a fixed stride over ``size`` bytes: (by, win, lo, hi)."""
    i = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1, F.lit(window).cast("long"))).alias("win", "lo")
    return total.where(F.col(size) > 0).select(*by, size, i).select(*by, "win", "lo", F.least(F.col("lo") + window, F.col(size)).alias("hi"))


def shared_limiter(requests: DataFrame, by: list[str], order: list[str], now: str, count: str, rate: float, latency: float) -> DataFrame:
    """When each request may end: ``next = max(now, next) + latency + count / rate``, as a window.

    With d = latency + count / rate and D its running sum, next = D + max over earlier rows of (now - D before them).
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = F.lit(latency) + F.col(count) / F.lit(rate)
    rows = requests.withColumn("_d", d).withColumn("_sum", F.sum("_d").over(w))
    return rows.withColumn("ready", F.col("_sum") + F.max(F.col(now) - (F.col("_sum") - F.col("_d"))).over(w)).drop("_d", "_sum")


def stream_windows(windows: DataFrame, order: list[str]) -> Iterator:
    """Windows one after another in offset order, fetched ahead; the budget of a window bounds what is held."""
    return windows.orderBy(*order).toLocalIterator(prefetchPartitions=True)


# Tasks get this module by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

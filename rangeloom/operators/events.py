"""Event logs: first occurrences, order, phases and counters of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_events(events: DataFrame, run: str, event: str, at: str, tie: str) -> DataFrame:
    """The first occurrence of each event in each run wins; min_by has partial sums, so a busy run does not gather."""
    return events.groupBy(run, event).agg(F.min(F.struct(at, tie)).alias("f"), F.count(F.lit(1)).alias("seen")).select(run, event, F.col(f"f.{at}").alias(at), F.col(f"f.{tie}").alias(tie), "seen")


def unknown_events(events: DataFrame, event: str, known: list[str]) -> DataFrame:
    return events.where(~F.col(event).isin(known) | F.col(event).isNull())


def order_violations(first: DataFrame, run: str, event: str, at: str, tie: str, order: list[str]) -> DataFrame:
    """Events of the lifecycle that come after a later one."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(event))
    rows = first.where(F.col(event).isin(order)).withColumn("place", place)
    w = Window.partitionBy(run).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reached", F.max("place").over(w)).where(F.col("reached") > F.col("place"))


def phases(first: DataFrame, run: str, event: str, at: str, tie: str, order: list[str], terminal: list[str]) -> DataFrame:
    """Per run: the last lifecycle event, and the state it ended in if any."""
    rows = first.where(F.col(event).isin(order))
    last = F.max_by(event, F.struct(at, tie))
    return rows.groupBy(run).agg(last.alias("phase")).withColumn("terminal_state", F.when(F.col("phase").isin(terminal), F.col("phase")))


def event_pivot(first: DataFrame, run: str, event: str, at: str, names: list[str]) -> DataFrame:
    """A row for each run with a column for each event; what did not happen stays NULL."""
    return first.groupBy(run).pivot(event, names).agg(F.min(at))


def counters(events: DataFrame, run: str, name: str, value: str, additive: list[str], absolute: list[str]) -> DataFrame:
    """Additive counters sum whole values of 0 or more, absolute ones keep the largest; unknown names are ignored."""
    whole = F.when((F.col(value) >= 0) & (F.col(value) == F.floor(value)), F.col(value).cast("long"))
    aggs = [F.coalesce(F.sum(F.when(F.col(name) == x, whole)), F.lit(0)).cast("long").alias(x) for x in additive]
    aggs += [F.max(F.when(F.col(name) == x, whole)).alias(x) for x in absolute]
    return events.groupBy(run).agg(*aggs)


def sampler(samples: DataFrame, run: str, at: str, tie: str, value: str, most: int = 512) -> DataFrame:
    """Baseline, peak and last of the first ``most`` samples of each run."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(at, tie))
    rows = samples.withColumn("n", n).where(F.col("n") <= most)
    return rows.groupBy(run).agg(F.min_by(value, "n").alias("baseline"), F.max(value).alias("peak"), F.max_by(value, "n").alias("last"), F.count(F.lit(1)).alias("samples"))

"""Capacity from staircase sweeps: where time jumps as groups are added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Factors of the first and second jump, points that make a plateau's level.
FIRST, SECOND, LEVEL = 1.35, 1.2, 4


def _numbered(points: DataFrame, by: list[str], g: str) -> DataFrame:
    return points.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(g)) - 1)


def _jump(rows: DataFrame, by: list[str], ms: str, factor: float, from_plateau: int) -> DataFrame:
    """Least i at which time reaches factor times the median of up to LEVEL points before it on its plateau."""
    level = F.percentile(F.col(ms), 0.5).over(Window.partitionBy(*by).orderBy("i").rowsBetween(-LEVEL, -1))
    rows = rows.withColumn("level", level)
    return rows.groupBy(*by).agg(F.min(F.when((F.col("i") >= F.col("plateau") + from_plateau) & (F.col(ms) >= factor * F.col("level")), F.col("i"))).alias("at"))


def analyze(points: DataFrame, by: list[str], g: str, ms: str, units: str | None = None) -> DataFrame:
    """Per shape: the interval [cap_lo, cap_hi) of its capacity, whole units in it, and whether it is clean."""
    rows = _numbered(points, by, g)
    first = _jump(rows.withColumn("plateau", F.lit(0)), by, ms, FIRST, 3).withColumnRenamed("at", "first")
    after = rows.join(first, by).where(F.col("i") >= F.col("first")).withColumn("plateau", F.col("first"))
    second = _jump(after, by, ms, SECOND, 4).withColumnRenamed("at", "second")
    at = rows.join(first, by).join(second, by, "left")
    pick = lambda cond, name: F.max(F.when(cond, F.col(g))).alias(name)
    out = at.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pick(F.col("i") == F.col("first") - 1, "cap_lo"), pick(F.col("i") == F.col("first"), "cap_hi"), pick(F.col("i") == F.col("second"), "second_g"),
        *([F.max(units).alias("units")] if units else []),
    )
    near = F.col("second_g").between(2 * F.col("cap_lo") - 1, 2 * F.col("cap_hi") + 4)
    clean = (F.col("n") >= 8) & near
    if units:
        # Whole multiples k with cap_lo <= units * k < cap_hi; exactly one names the capacity.
        low, high = F.ceil(F.col("cap_lo") / F.col("units")), F.ceil(F.col("cap_hi") / F.col("units")) - 1
        out = out.withColumn("per_unit", F.when(clean & (low == high), low).cast("long"))
        clean = clean & F.col("per_unit").isNotNull()
    return out.withColumn("clean", F.coalesce(clean, F.lit(False)))


def merge_runs(shapes: DataFrame, shape: str, run: str) -> DataFrame:
    """Over runs: reproducible if clean in all with one count, and the interval that all share."""
    n_runs = shapes.select(run).distinct().agg(F.count(F.lit(1)).alias("runs"))
    out = shapes.groupBy(shape).agg(F.count_if("clean").alias("clean_in"), F.count_distinct("per_unit").alias("counts"), F.max("cap_lo").alias("lo"), F.min("cap_hi").alias("hi"))
    out = out.join(F.broadcast(n_runs))
    return out.withColumn("reproducible", (F.col("clean_in") == F.col("runs")) & (F.col("counts") == 1)).withColumn("consistent", F.col("lo") < F.col("hi"))


def first_wave(points: DataFrame, by: list[str], g: str, ms: str) -> DataFrame:
    """Capacity against the level of the first three points, for six points or more."""
    rows = _numbered(points, by, g)
    base = rows.groupBy(*by).agg(F.median(F.when(F.col("i") < 3, F.col(ms))).alias("base"), F.count(F.lit(1)).alias("n"))
    at = rows.join(base, by).where((F.col("n") >= 6) & (F.col("i") >= 3) & (F.col(ms) >= FIRST * F.col("base")))
    return at.groupBy(*by).agg(F.min(g).alias("first_above"))


def calibrate(shapes: DataFrame, expected: DataFrame, shape: str, run: str, want: str) -> DataFrame:
    """(shape, want, ok): whether what is expected lies in [cap_lo, cap_hi) of every run; false if a run has no staircase."""
    runs = shapes.select(run).distinct().agg(F.count(F.lit(1)).alias("_runs"))
    rows = expected.join(shapes.select(F.col(shape).alias("_s"), "cap_lo", "cap_hi"), F.col(shape) == F.col("_s"), "left").join(F.broadcast(runs))
    inside = F.bool_and((F.col("cap_lo") <= F.col(want)) & (F.col(want) < F.col("cap_hi")))
    return rows.groupBy(shape, want).agg(F.coalesce((F.count("cap_lo") == F.max("_runs")) & inside, F.lit(False)).alias("ok"))

"""Summaries of measurement runs. Three kinds of median and percentile live here; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges that a group is cut into where a place in its order is asked for, and samples below which a tail says nothing.
BUCKETS, TAIL_SAMPLES = 64, 30


def median(x: str) -> Column:
    """Interpolated."""
    return F.median(x)


def percentiles(rows: DataFrame, by: list[str], value: str, fraction: float = 0.95) -> DataFrame:
    """(by, p95, upper_median): value number floor(n * fraction), counted from 1 and kept within the list, NULL below
    TAIL_SAMPLES values; and the upper of the two middle values."""
    low = rank_of(rows, by, value, lambda n: F.greatest(F.lit(1), F.least(n, F.floor(n * fraction))), "_low")
    mid = rank_of(rows, by, value, lambda n: F.floor(n / 2) + 1, "upper_median")
    n = rows.groupBy(*by).agg(F.count(value).alias("_n"))
    return low.join(mid, by).join(n, by).select(*by, F.when(F.col("_n") >= TAIL_SAMPLES, F.col("_low")).alias("p95"), "upper_median")


def arm_summary(rows: DataFrame, arm: str, value: str, status: str | None = None) -> DataFrame:
    """Per arm over passed rows: n, median, least and most."""
    v = F.when(F.col(status) == "PASS", F.col(value)) if status else F.col(value)
    rows = rows.withColumn("_v", v)
    return rows.groupBy(arm).agg(F.count("_v").alias("n"), F.median("_v").alias("median"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def paired_ratio(rows: DataFrame, pair: list[str], arm: str, value: str, base: str, other: str) -> DataFrame:
    """other / base within each pair; NULL unless both are there, and the base counts as 1e-12 at least."""
    v = lambda name: F.max(F.when(F.col(arm) == name, F.col(value)))
    both = rows.where(F.col(arm).isin(base, other)).groupBy(*pair).agg(v(base).alias("base"), v(other).alias("other"))
    there = F.col("base").isNotNull() & F.col("other").isNotNull()
    return both.withColumn("ratio", F.when(there, F.col("other") / F.greatest("base", F.lit(1e-12))))


def status_counts(rows: DataFrame, by: list[str], status: str, required: str, tolerated: tuple[str, ...] = ("PASS", "SKIP")) -> DataFrame:
    """Rows by status, required rows that failed, and whether the campaign passes."""
    bad = F.count_if(F.col(required) & ~F.col(status).isin(*tolerated))
    counts = [F.count_if(F.col(status) == s).alias(s.lower()) for s in ("PASS", "FAIL", "SKIP", "NOT_RUN", "INCONCLUSIVE")]
    return rows.groupBy(*by).agg(*counts, bad.alias("required_failures"), F.when(bad == 0, "PASS").otherwise("FAIL").alias("engineering"))


def merge_reports(rows: DataFrame, by: list[str], sums: list[str], failed: str, error: str, order: str) -> DataFrame:
    """Counters add up, a failure stays, the last error is kept."""
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], F.bool_or(failed).alias("failed"), F.max_by(error, F.when(F.col(error).isNotNull(), F.col(order))).alias("last_error"))


def bottleneck(full: Column, empty: Column) -> Column:
    """Waits on a full queue point at placing, on an empty one at fetching."""
    return F.when(full > 2 * empty, "place").when(empty > 2 * full, "fetch").otherwise("balanced")


def best_threads(samples: DataFrame, by: list[str], threads: str, rate: str) -> DataFrame:
    """Median rate of each thread count, then the largest; the fewest threads win a tie."""
    med = samples.groupBy(*by, threads).agg(F.median(rate).alias("m"))
    return med.groupBy(*by).agg(F.max_by(F.struct(threads, "m"), F.struct("m", -F.col(threads))).alias("b")).select(*by, F.col(f"b.{threads}").alias(threads), F.col("b.m").alias(rate))


def layered(first: Column, again: Column) -> Column:
    """True if a second read is much faster than the first, else unknown; never false."""
    return F.when(again > 1.5 * first, F.lit(True))


def perplexity(rows: DataFrame, by: list[str], loss: str, length: str) -> DataFrame:
    """Loss weighted by predicted tokens (one less than the length), and its exponential."""
    w = F.greatest(F.col(length) - 1, F.lit(0))
    mean = F.sum(F.col(loss) * w) / F.nullif(F.sum(w), F.lit(0))
    return rows.groupBy(*by).agg(F.sum(w).alias("tokens"), mean.alias("loss"), F.exp(mean).alias("perplexity"))


def bandwidth_check(rows: DataFrame, by: list[str], nbytes: str, secs: str, cap: float) -> DataFrame:
    """Observed rates stay within 1.35 of the cap, and within 1.75 of each other."""
    rate = F.col(nbytes) / F.greatest(F.col(secs), F.lit(1e-9))
    out = rows.withColumn("_r", rate).groupBy(*by).agg(F.min("_r").alias("slowest"), F.max("_r").alias("fastest"))
    return out.withColumn("ok", (F.col("fastest") <= 1.35 * cap) & (F.col("fastest") / F.col("slowest") < 1.75))


def route_holdout(rows: DataFrame, by: list[str], route: str, secs: str, calibration: str) -> DataFrame:
    """The route that calibration rows choose, against the best of the others: its cost and ratio."""
    m = rows.groupBy(*by, route).agg(F.median(F.when(F.col(calibration), F.col(secs))).alias("c"), F.median(F.when(~F.col(calibration), F.col(secs))).alias("e"))
    pick = m.groupBy(*by).agg(F.min(F.when(F.col("c").isNotNull(), F.struct("c", route, "e"))).alias("p"), F.min(F.when(F.col("e").isNotNull(), F.struct("e", route))).alias("b"))
    return pick.select(*by, F.col(f"p.{route}").alias("predicted"), F.col(f"b.{route}").alias("best"), (F.col("p.e") - F.col("b.e")).alias("cost"), (F.col("p.e") / F.nullif(F.col("b.e"), F.lit(0.0))).alias("ratio"))


def paired_normal(rows: DataFrame, pair: list[str], arm: str, value: str, status: str, warmup: str, base: str) -> DataFrame:
    """Each row that is no warm-up with the base arm of its pair: baseline and ratio, NULL unless both passed."""
    live = rows.where(~F.col(warmup))
    b = live.where((F.col(arm) == base) & (F.col(status) == "PASS")).groupBy(*pair).agg(F.min(value).alias("baseline"))
    out = live.join(b, pair, "left")
    return out.withColumn("ratio", F.when((F.col(status) == "PASS") & F.col("baseline").isNotNull(), F.col(value) / F.greatest("baseline", F.lit(1e-12))))


def duration_summary(rows: DataFrame, by: list[str], value: str, status: str, ratio: str) -> DataFrame:
    """Over passed rows n, median, least and most; the same of the ratios that are there, and how many are below 1."""
    v = F.when(F.col(status) == "PASS", F.col(value))
    stats = lambda c, name: [F.count(c).alias(f"{name}n"), F.median(c).alias(f"{name}median"), F.min(c).alias(f"{name}least"), F.max(c).alias(f"{name}most")]
    return rows.groupBy(*by).agg(*stats(v, ""), *stats(F.col(ratio), "ratio_"), F.count_if(F.col(ratio) < 1).alias("wins"))


def arm_modes(rows: DataFrame, arm: str, mode: str, secs: str, valid: str, plain_bytes: int) -> DataFrame:
    """Per arm and mode over valid rows (valid unless said otherwise): medians, range, and the rate that the median means."""
    m = F.median(secs)
    out = rows.where(F.coalesce(F.col(valid), F.lit(True))).groupBy(arm, mode)
    return out.agg(F.count(F.lit(1)).alias("n"), m.alias("median"), F.min(secs).alias("least"), F.max(secs).alias("most"), F.when(m > 0, plain_bytes / m / 1e9).otherwise(0.0).alias("gb_s"))


def spread_ceiling(rows: DataFrame, by: list[str], plain: str, coded: str, ratio: float) -> DataFrame:
    """Upper medians and spreads of both rates, and whether their ratio stays below what the coded size allows."""
    mid = rank_of(rows, by, plain, lambda n: F.floor(n / 2) + 1, "plain_mid").join(rank_of(rows, by, coded, lambda n: F.floor(n / 2) + 1, "coded_mid"), by)
    ends = rows.groupBy(*by).agg(F.min(plain).alias("plain_least"), F.max(plain).alias("plain_most"))
    out = mid.join(ends, by).withColumn("ratio", F.col("coded_mid") / F.col("plain_mid"))
    return out.withColumn("allowed", F.col("ratio") <= 1 / ratio + 1e-9)


def rank_of(rows: DataFrame, by: list[str], value: str, rank, into: str) -> DataFrame:
    """(by, into): the value whose place in order, counted from 1, is ``rank`` of the number of values.

    Equal values are counted together first; then quantiles of each group cut it into up to BUCKETS ranges, whose counts
    tell the range that has the place, and only values of that range are put in order. No group is held or sorted whole.
    """
    seen = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = seen.groupBy(*by).agg(F.percentile_approx("_v", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), 1000).alias("_cuts"))
    own = seen.join(cuts, by) if by else seen.crossJoin(F.broadcast(cuts))  # one row
    own = own.withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sums = own.groupBy(*by, "_b").agg(F.sum("_n").alias("_s"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_k", rank(F.sum("_s").over(over)))
    place = sums.where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_s"))).select(*by, "_b", (F.col("_k") - F.col("_before")).alias("_k"))
    near = own.join(place, [*by, "_b"])
    upto = F.sum("_n").over(over.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    hit = near.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_k"))
    return hit.groupBy(*by).agg(F.min("_v").alias(into))


def chunk_share(base: DataFrame, revised: DataFrame, digest: str, nbytes: str) -> DataFrame:
    """One row: how much of a revision's chunks, and of its bytes, the base does not have."""
    known = base.select(F.col(digest).alias("_d")).distinct().withColumn("_known", F.lit(True))
    rows = revised.join(known, F.col(digest) == F.col("_d"), "left").withColumn("_new", F.col("_known").isNull())
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.count_if("_new").alias("new_chunks"), F.coalesce(F.sum(nbytes), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum(F.when(F.col("_new"), F.col(nbytes))), F.lit(0)).cast("long").alias("new_bytes"))


def crossover(f: Column, c: Column, a: Column) -> Column:
    """Revisions up to which coding wins over chunks of the plain bytes: 1 + (1 - f) / (c (f a - 1)); NULL if it always does."""
    return F.when(f * a > 1, 1 + (1 - f) / F.nullif(c * (f * a - 1), F.lit(0.0)))


def ordered_run(first: DataFrame, run: str, event: str, at: str, failed: str, preferred: str, wanted: list[str]) -> DataFrame:
    """One row: of the runs without a failure that have every wanted event, a preferred one or else the least, and
    whether its events happened in the wanted order; no such run fails."""
    times = [F.min(F.when(F.col(event) == x, F.col(at))).alias(f"_{i}") for i, x in enumerate(wanted)]
    per = first.groupBy(run).agg(*times, F.bool_or(failed).alias("_f"), F.bool_or(preferred).alias("_p"))
    row = F.array(*[F.col(f"_{i}") for i in range(len(wanted))])
    ok = per.where(~F.col("_f") & F.forall(row, lambda x: x.isNotNull())).select(run, row.alias("_t"), "_p")
    best = ok.agg(F.min_by(F.struct(run, "_t"), F.struct(~F.col("_p"), F.col(run))).alias("b"))
    return best.select(F.col(f"b.{run}").alias(run), F.coalesce(F.col("b._t") == F.array_sort(F.col("b._t")), F.lit(False)).alias("ordered"))


def copied_bytes(spans: DataFrame, start: str, size: str, width: str) -> DataFrame:
    """One row: tensors and bytes that must be copied as their start is off their element's width, against all."""
    off = (F.col(width) > 1) & (F.col(start) % F.col(width) != 0)
    return spans.agg(F.count_if(off).alias("copied"), F.coalesce(F.sum(F.when(off, F.col(size))), F.lit(0)).cast("long").alias("copied_bytes"), F.count(F.lit(1)).alias("tensors"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def write_records(rows: DataFrame, path: str) -> None:
    """A campaign's rows as JSON lines, appended to those that are there; NULL fields are written, so that none is missed."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)

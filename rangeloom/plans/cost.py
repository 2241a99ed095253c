"""What a transfer route costs, and which to take. Unknown rates stay unknown: no claim is made from them.

A plan case is a row. Its routes become rows of stages; stages that share a pool run one after another, pools of a
phase overlap, phases follow each other. Everything is projection and aggregates over a handful of rows for each case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARGIN = 1.15


def seconds(nbytes: Column, rate: Column) -> Column:
    """NULL where the rate is unknown or 0."""
    return nbytes / F.nullif(rate, F.lit(0.0))


def _stage(route: str, ord_: int, name: str, nbytes: Column, rate: Column, pool: str | None = None, phase: str = "", overlapped: bool = True) -> Column:
    return F.struct(
        F.lit(route).alias("route"), F.lit(ord_).alias("ord"), F.lit(name).alias("stage"), nbytes.cast("long").alias("nbytes"), rate.cast("double").alias("rate"),
        F.lit(pool or f"own {ord_}").alias("pool"), F.lit(phase).alias("phase"), F.lit(overlapped).alias("overlapped"),
    )


def _explode(cases: DataFrame, case: str, stages: list[Column]) -> DataFrame:
    out = cases.select(case, F.explode(F.array(*stages)).alias("x")).where("x is not null").select(case, "x.*")
    return out.withColumn("seconds", seconds(F.col("nbytes"), F.col("rate")))


def routes(stages: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case and route: seconds (NULL if any stage's are), the stage that limits it, and bytes over links."""
    first = F.col("ord")
    known = F.count(F.lit(1)) == F.count("seconds")
    slow = F.struct(F.col("seconds"), -first)  # the first of equals
    pools = stages.groupBy(case, "route", "pool", "overlapped").agg(
        F.sum("seconds").alias("t"), F.max_by("phase", slow).alias("phase"), F.max_by("stage", slow).alias("slowest"), F.max("seconds").alias("most"),
        F.min("ord").alias("ord"), known.alias("known"), F.sum(F.when(F.col("stage").isin("read", "write", "pcie"), F.col("nbytes")).otherwise(0)).alias("moved"),
    )
    binding = F.struct(F.when(F.col("overlapped"), F.col("t")).otherwise(F.col("most")), -first)
    phases = pools.groupBy(case, "route", "phase", "overlapped").agg(
        F.when(F.first("overlapped"), F.max("t")).otherwise(F.sum("t")).alias("t"), F.max(F.struct(binding.alias("b"), F.col("slowest"))).alias("top"), F.bool_and("known").alias("known"), F.sum("moved").alias("moved")
    )
    return phases.groupBy(case, "route").agg(
        F.when(F.bool_and("known"), F.sum("t")).alias("seconds"),
        F.when(F.bool_and("known"), F.max("top")["slowest"]).otherwise("unknown").alias("limited_by"),
        F.sum("moved").cast("long").alias("device_bytes"),
    )


def decide(route_rows: DataFrame, case: str = "case_id", margin: float = MARGIN) -> DataFrame:
    """Plain against coded: (case, chosen, speedup, confident). Only these two can be chosen."""
    s = lambda name: F.max(F.when(F.col("route") == name, F.col("seconds")))
    both = route_rows.groupBy(case).agg(s("plain").alias("plain"), s("coded").alias("coded"))
    ratio = F.col("plain") / F.col("coded")
    return both.select(
        case,
        F.when(ratio >= margin, "coded").otherwise("plain").alias("chosen"),
        ratio.alias("speedup"),
        F.coalesce((ratio >= margin) | (ratio <= 1 / margin), F.lit(False)).alias("confident"),
    )


def read_stages(cases: DataFrame, case: str = "case_id") -> DataFrame:
    """Stages of plain, coded (with decryption if sealed) and expand, from columns plain, coded, source, decode, decrypt, expand_write."""
    c = F.col
    has = c("coded").isNotNull()
    opt = lambda cond, x: F.when(cond, x)
    return _explode(cases, case, [
        _stage("plain", 0, "read", c("plain"), c("source")),
        opt(has, _stage("coded", 0, "read", c("coded"), c("source"), "fetch")),
        opt(has & c("decrypt").isNotNull(), _stage("coded", 1, "decrypt", c("coded"), c("decrypt"), "fetch")),
        opt(has, _stage("coded", 2, "decode", c("plain"), c("decode"), "decode")),
        *[opt(has & (c("expand_write") != 0), _stage("expand", i, n, c(b), c(r), overlapped=False)) for i, (n, b, r) in enumerate((("read", "coded", "source"), ("decode", "plain", "decode"), ("write", "plain", "expand_write"), ("reread", "plain", "source")))],
    ])


def seal_rate(source: Column, sink: Column, encrypt: Column) -> Column:
    """Read, encrypt and write one after another: rates add as reciprocals."""
    inv = lambda r: 1.0 / F.nullif(r, F.lit(0.0))
    return 1.0 / (inv(source) + inv(sink) + inv(encrypt))


def write_stages(cases: DataFrame, case: str = "case_id") -> DataFrame:
    """Stages of plain, coded and sealed writes, from columns plain, ratio, sink, encode, seal."""
    c = F.col
    coded = F.floor(c("plain") * c("ratio")).cast("long")
    sealed = c("seal") != 0
    return _explode(cases, case, [
        _stage("plain", 0, "write", c("plain"), c("sink")),
        _stage("coded", 0, "encode", c("plain"), c("encode")),
        _stage("coded", 1, "write", coded, c("sink")),
        F.when(sealed, _stage("sealed", 0, "encode", c("plain"), c("encode"), phase="code")),
        F.when(sealed, _stage("sealed", 1, "write", coded, c("sink"), phase="code")),
        F.when(sealed, _stage("sealed", 2, "seal", coded, c("seal"), phase="seal")),
    ])


def peak_bytes(route_rows: DataFrame, write_cases: DataFrame, case: str = "case_id") -> DataFrame:
    """Route rows with what must be on disk at once: two coded copies while sealing, else what moves."""
    coded = F.floor(F.col("plain") * F.col("ratio")).cast("long")
    rows = route_rows.join(write_cases.select(case, coded.alias("_c")), case)
    return rows.withColumn("peak_bytes", F.when((F.col("route") == "sealed") & (F.col("_c") > 0), F.col("_c") * 2).otherwise(F.col("device_bytes"))).drop("_c")


def vram_stages(cases: DataFrame, case: str = "case_id") -> DataFrame:
    """Stages of the three ways into device memory, from plain, coded, source, pcie, host_decode, device_decode."""
    c = F.col
    has = c("coded").isNotNull()
    return _explode(cases, case, [
        _stage("plain", 0, "read", c("plain"), c("source")), _stage("plain", 1, "pcie", c("plain"), c("pcie")),
        F.when(has, _stage("host-decode", 0, "read", c("coded"), c("source"))), F.when(has, _stage("host-decode", 1, "decode", c("plain"), c("host_decode"))), F.when(has, _stage("host-decode", 2, "pcie", c("plain"), c("pcie"))),
        F.when(has, _stage("device-decode", 0, "read", c("coded"), c("source"))), F.when(has, _stage("device-decode", 1, "pcie", c("coded"), c("pcie"))), F.when(has, _stage("device-decode", 2, "decode", c("plain"), c("device_decode"))),
    ])


def vram_decide(route_rows: DataFrame, case: str = "case_id", margin: float = MARGIN) -> DataFrame:
    """The fastest known route, ties by bytes moved; plain unless another clears the margin."""
    place = F.expr("array_position(array('plain', 'host-decode', 'device-decode'), route)")
    agg = route_rows.groupBy(case).agg(
        F.max(F.when(F.col("route") == "plain", F.col("seconds"))).alias("plain"), F.count("seconds").alias("known"),
        F.min(F.when(F.col("seconds").isNotNull(), F.struct("seconds", "device_bytes", place.alias("p"), "route"))).alias("best"),
    )
    enough = F.col("known") >= 2
    speedup = F.when(enough, F.col("plain") / F.col("best.seconds"))
    takes = enough & (F.col("best.route") != "plain") & (speedup >= margin)
    return agg.select(case, F.when(takes, F.col("best.route")).otherwise("plain").alias("chosen"), speedup.alias("speedup"), F.coalesce(takes | (enough & (speedup <= 1 / margin)), F.lit(False)).alias("confident"))


def gate_ratio(codec: Column, device: Column) -> Column:
    return F.nullif(codec, F.lit(0.0)) / F.nullif(device, F.lit(0.0))


def worth_caching(decisions: DataFrame, cases: DataFrame, case: str = "case_id") -> DataFrame:
    """A cache entry pays only if the link is known and the coded route is chosen."""
    rows = decisions.join(cases.select(case, "source"), case)
    return rows.withColumn("worth", F.coalesce((F.col("source") != 0) & (F.col("chosen") == "coded"), F.lit(False))).drop("source")


def prediction_right(predicted: Column, measured: Column, within: float = 0.25) -> Column:
    return F.abs(measured - predicted) / F.nullif(predicted, F.lit(0.0)) < within

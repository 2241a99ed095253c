"""Differences of model weights, tensor by tensor, and name taxonomies."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Parts of a tensor's name and its component; the first that matches counts.
COMPONENTS = (("embed_tokens", "embed_tokens"), ("q_proj", "q_proj"), ("k_proj", "k_proj"), ("v_proj", "v_proj"), ("o_proj", "o_proj"), ("gate_proj", "gate_proj"), ("up_proj", "up_proj"), ("down_proj", "down_proj"), ("norm", "layernorms"), ("lm_head", "lm_head"))


def component(name: Column, rules=COMPONENTS) -> Column:
    out = None
    for part, label in rules:
        out = F.when(name.contains(part), label) if out is None else out.when(name.contains(part), label)
    return out


def _doubles(c: str) -> Column:
    return F.transform(F.col(c), lambda x: x.cast("double"))


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def delta_rows(base: DataFrame, other: DataFrame, key: list[str], values: str) -> DataFrame:
    """Per tensor in both: count, equal values, sums of |d|, d^2 and b^2, and the largest |d|. One equi join."""
    b = base.withColumnRenamed(values, "_b")
    o = other.select(*key, F.col(values).alias("_o"))
    d = b.join(o, key).withColumn("_d", F.zip_with(_doubles("_o"), _doubles("_b"), lambda x, y: x - y))
    return d.select(
        *[c for c in b.columns if c != "_b"],
        F.size("_d").cast("long").alias("n"),
        F.size(F.filter("_d", lambda x: x == 0)).cast("long").alias("equal"),
        _fold(F.transform("_d", F.abs)).alias("l1"),
        _fold(F.transform("_d", lambda x: x * x)).alias("l2"),
        _fold(F.transform(_doubles("_b"), lambda x: x * x)).alias("base_l2"),
        F.array_max(F.transform("_d", F.abs)).alias("max_abs"),
    )


def delta_report(rows: DataFrame, component_: str, layer: str) -> DataFrame:
    """By component, by layer and over all, in one pass of grouping sets."""
    return rows.groupingSets([[component_], [layer], []], component_, layer).agg(
        F.grouping_id().alias("level"),
        F.sum("n").alias("n"),
        F.sum("equal").alias("equal"),
        (F.sum("l1") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_l1"),
        (F.sqrt(F.sum("l2")) / F.nullif(F.sqrt(F.sum("base_l2")), F.lit(0.0))).alias("relative_l2"),
        F.max("max_abs").alias("max_abs"),
    )


def task_vectors(base: DataFrame, other: DataFrame, key: list[str], values: str, alpha: float = 0.5) -> DataFrame:
    """Norm of the difference, its share of the base's, and the point ``alpha`` of the way."""
    o = other.select(*key, F.col(values).alias("_o"))
    rows = base.withColumnRenamed(values, "_b").join(o, key)
    d = F.zip_with(_doubles("_o"), _doubles("_b"), lambda x, y: x - y)
    norm = lambda v: F.sqrt(_fold(F.transform(v, lambda x: x * x)))
    return rows.select(*key, norm(d).alias("drift"), (norm(d) / F.nullif(norm(_doubles("_b")), F.lit(0.0))).alias("relative_drift"), F.zip_with(_doubles("_b"), d, lambda b, x: b + alpha * x).alias("merged"))


def taxonomy(index: DataFrame, name: str, nbytes: str, parts: tuple[str, ...]) -> DataFrame:
    """Count, bytes and share of names with any of the parts, against the rest; one pass."""
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.lower(F.col(name)).contains(p)
    rows = index.agg(F.count_if(hit).alias("n_hit"), F.coalesce(F.sum(F.when(hit, F.col(nbytes))), F.lit(0)).alias("bytes_hit"), F.count(F.lit(1)).alias("n_all"), F.coalesce(F.sum(nbytes), F.lit(0)).alias("bytes_all"))
    return rows.withColumn("share", F.col("bytes_hit") / F.nullif(F.col("bytes_all"), F.lit(0)))


def decode_stats(chunks: DataFrame, eligible: str, reason: str, nbytes: str) -> DataFrame:
    """Share of bytes that a device can decode (a total of 1 at least), with bytes by reason."""
    return chunks.groupBy(reason).agg(F.count(F.lit(1)).alias("chunks"), F.sum(nbytes).alias("bytes"), F.sum(F.when(F.col(eligible), F.col(nbytes)).otherwise(0)).alias("device_bytes")).withColumn("share", F.col("device_bytes") / F.greatest(F.col("bytes"), F.lit(1)))


def numerical_check(rows: DataFrame, reference: DataFrame, key: list[str], value: str, text: str) -> DataFrame:
    """Against a reference run: equal values, largest difference, same text."""
    r = reference.select(*key, F.col(value).alias("_v"), F.col(text).alias("_t"))
    return rows.join(r, key).agg(F.bool_and(F.col(value) == F.col("_v")).alias("equal"), F.max(F.abs(F.col(value) - F.col("_v"))).alias("max_abs"), F.bool_and(F.col(text).eqNullSafe(F.col("_t"))).alias("text_match"))


@F.pandas_udf(LongType())
def delta_size(base: pd.Series, other: pd.Series) -> pd.Series:
    """Bytes that the difference of two tensors' bytes packs to: their exclusive or, deflated."""

    def one(a: bytes | None, b: bytes | None) -> int | None:
        if a is None or b is None or len(a) != len(b):
            return None
        return len(zlib.compress((np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).tobytes(), 1))

    return pd.Series([one(a, b) for a, b in zip(base, other, strict=True)], dtype="Int64")

"""Measured profiles: rows that later measurements fill in, and what a plan takes from them."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import codec


def upsert(old: DataFrame, new: DataFrame, key: str, measured: list[str], named: list[str]) -> DataFrame:
    """New rows over old ones, field by field: a measured field that is NULL, or a named one that is NULL, 0 or empty,
    keeps the old value. Keys of either side stay."""
    o = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in (*measured, *named)])
    rows = new.join(o, F.col(key) == F.col("_k"), "full_outer")
    kinds = dict(new.dtypes)
    blank = lambda c: F.nullif(F.col(c), F.lit("" if kinds[c] == "string" else 0).cast(kinds[c]))
    return rows.select(F.coalesce(key, "_k").alias(key), *[F.coalesce(c, f"_{c}").alias(c) for c in measured], *[F.coalesce(blank(c), F.col(f"_{c}")).alias(c) for c in named])


def priced(models: DataFrame, storage: DataFrame, codecs: DataFrame, storage_key: str, codec_key: str) -> DataFrame:
    """Models with the rates that hold for them, as read_stages() takes them.

    A link's rate by storage key and a codec's by its name, NULL where nothing was measured. A plain model gets a
    hypothetical coded size from the codec's ratio; decrypt counts for encrypted models only.
    """
    s = storage.select(F.col(storage_key).alias("_s"), "source", F.col("write").alias("expand_write"), "decrypt_rate")
    c = codecs.select(F.col(codec_key).alias("_c"), "decode", "ratio")
    rows = models.join(s, F.col(storage_key) == F.col("_s"), "left").join(c, F.col(codec_key) == F.col("_c"), "left")
    coded = F.when(F.col("is_coded"), F.col("coded_bytes")).otherwise((F.col("plain") * F.nullif(F.col("ratio"), F.lit(0.0))).cast("long"))
    return rows.withColumn("coded", coded).withColumn("hypothetical", ~F.col("is_coded") & coded.isNotNull()).withColumn("decrypt", F.when(F.col("encrypted"), F.col("decrypt_rate"))).drop("_s", "_c", "decrypt_rate")


def fingerprint(*parts: Column) -> Column:
    """Enough of a machine to notice that it is another one."""
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def age(now: Column, measured_at: Column) -> Column:
    return F.greatest(F.lit(0.0), (now - measured_at).cast("double"))


def probe_points(probes: DataFrame, text: str) -> DataFrame:
    """(shape, threads, shared, g, ms) from a probe's JSON in either layout: arrays side by side, or lists of points."""
    shape = "struct<name:string,T:bigint,S:bigint,G:array<bigint>,median_ms:array<double>,error:string,points:array<struct<G:bigint,timeMs:double>>>"
    doc = F.from_json(text, f"struct<shapes:array<{shape}>,staircase:struct<shapes:array<{shape}>,sSweep:array<{shape}>>>")
    rows = probes.select(doc.alias("d"))
    none = F.array().cast(f"array<{shape}>")
    first = F.coalesce(F.size(F.get("d.shapes", F.lit(0))["G"]) >= 0, F.lit(False))
    rows = rows.select(first.alias("side_by_side"), F.explode(F.when(first, F.col("d.shapes")).otherwise(F.concat(F.coalesce("d.staircase.shapes", none), F.coalesce("d.staircase.sSweep", none)))).alias("s"))
    pairs = F.when(F.col("side_by_side"), F.transform(F.arrays_zip("s.G", "s.median_ms"), lambda p: F.struct(p["G"].alias("g"), p["median_ms"].alias("ms"))))
    pairs = F.coalesce(pairs, F.transform("s.points", lambda p: F.struct(p["G"].alias("g"), p["timeMs"].alias("ms"))))
    good = F.when(F.col("side_by_side"), F.coalesce(F.col("s.error"), F.lit("")) == "").otherwise(F.coalesce(F.col("s.S"), F.lit(0)) != 0)
    return rows.where(good).select(F.col("s.name").alias("shape"), F.col("s.T").alias("threads"), F.col("s.S").alias("shared"), F.explode(pairs).alias("p")).select("shape", "threads", "shared", "p.*")


def save(rows: DataFrame, path: str) -> None:
    """Write a profile as JSON lines beside ``path`` and put it there as a whole."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    rows.write.json(stage)
    if files.exists(place(path)):
        files.delete(place(path), True)
    if not files.rename(place(stage), place(path)):
        raise OSError(f"{path} could not be replaced")


def load(spark: SparkSession, path: str, schema: str, own: str) -> DataFrame:
    """A saved profile, empty if it was measured on a machine with another fingerprint."""
    return spark.read.schema(schema).json(path).where(F.col("fingerprint") == own)


def measure(spark: SparkSession, name: str, size: int = 1 << 20, repeats: int = 5, threads: tuple[int, ...] = (1, 2), **options: int) -> DataFrame:
    """(codec, threads, what, rate): bytes a second of a coder on the executors, a row for each repeat; best_threads() sums up.

    The sample is a hash stream over a few words, so it packs like text, and is the same everywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [hashlib.sha256(bytes([i])).digest()[: 3 + i % 9] for i in range(200)]
        plain = b" ".join(words[b % 200] for i in range(-(-size // 32) // 2 + 1) for b in hashlib.sha256(str(i).encode()).digest())[:size]
        own = codec(name, **options)
        coded = own.encode(plain)
        for b in batches:
            for n in b.column(0).to_pylist():
                out = []
                for what, f, x in (("encode", own.encode, plain), ("decode", own.decode, coded)):
                    with ThreadPoolExecutor(n) as pool:
                        at = time.perf_counter()
                        list(pool.map(f, [x] * n))
                        out.append((name, n, what, n * len(plain) / max(time.perf_counter() - at, 1e-9)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["codec", "threads", "what", "rate"])

    asked = spark.createDataFrame([(n,) for n in threads for _ in range(repeats)], "threads long")
    return asked.mapInArrow(run, "codec string, threads long, what string, rate double")

"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records uniformly into buckets of a set size in bytes, by a seeded hash of their key. Pass two
Fisher-Yates shuffles each bucket (the JVM's ``shuffle`` over the bucket's sorted rows) and lays the buckets end to end.
The place p of a record in that order gives its shard, p mod n, and its slot, p div n: row counts of shards differ by
one at most (law ``rows``), and every shard is a uniform sample in random order.

Number of buckets and of partitions follow from the data alone, buckets are ordered within partitions, and their rows
sorted before the shuffle, so a task that runs again after a loss makes the same rows.

Hot keys: a key with more rows than a bucket should hold would overfill it. Such rows are counted per distinct row
before they move and then dealt over buckets by row and copy number.

Defined cases: a null text has size 1 and CRC 0; null and repeated keys are records like any others; an empty table
gives no rows; other columns are carried along, and helper columns avoid their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, spare, table

SHARDS, SEED, BUCKET_BYTES = 16, 20240613, 16 << 20
#: Buckets up to this many have a partition each, and their starts (two numbers a bucket: some MB) are broadcast; more
#: share MAX_PARTITIONS partitions.
BROADCAST_BUCKETS, MAX_PARTITIONS = 100_000, 100_000
#: Hot keys up to this many (of 64-bit ids: some MB) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def _size(text: str):
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def scatter(df: DataFrame, buckets: int, per_bucket: int, key: str, seed: int, into: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with its bucket, and the records of each bucket counted from keys alone."""
    cold = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)).cast("int")
    hot = df.groupBy(key).count().where(F.col("count") > per_bucket).select(F.col(key).alias("hot_key"))
    n_hot = hot.count()
    if not n_hot:
        dealt = df.withColumn(into, cold)
        return dealt, df.select(cold.alias(into)).groupBy(into).count()
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    same = F.col(key).eqNullSafe(F.col("hot_key"))
    n, copy = spare(df, "n_copies"), spare(df, "copy")
    rows = df.join(hot, same, "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias(n))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    rows = rows.withColumn(into, F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns], F.col(copy)), F.lit(buckets)).cast("int")).drop(n, copy)
    dealt = df.join(hot, same, "left_anti").withColumn(into, cold).unionByName(rows)
    return dealt, dealt.groupBy(into).count()


def external_shuffle(df: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``df`` plus size, shard and slot (renamed with a leading _ if taken)."""
    need(df, key, text)
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    n_rows, n_bytes = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_size(text)), F.lit(0))).first()
    buckets = max(1, math.ceil(n_bytes / bucket_bytes))
    per_bucket = max(64, math.ceil(n_rows / buckets))
    b, row, pos, start, place = (spare(df, x) for x in ("bucket", "row", "pos", "start", "place"))
    dealt, counts = scatter(df, buckets, per_bucket, key, seed, b)
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(b, F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias(start))  # a row for each bucket
    if buckets <= BROADCAST_BUCKETS:  # a bucket is a partition, so a task holds one; by hash several would meet in some
        moved, starts = dealt.repartitionById(buckets, F.col(b)), F.broadcast(starts)
    else:  # rows and starts meet by the same hash, without another shuffle
        moved = dealt.repartition(MAX_PARTITIONS, b)
    packed = moved.groupBy(b).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in [key, *[c for c in df.columns if c != key]]]))).alias(row))
    mixed = packed.sortWithinPartitions(b).select(b, F.posexplode(F.shuffle(row, F.lit(seed))).alias(pos, row))
    mixed = mixed.join(starts, b).withColumn(place, F.col(start) + F.col(pos))
    size, shard, slot = (spare(df, x) for x in ("size", "shard", "slot"))
    out = mixed.select(*[F.col(f"`{row}`.`{c}`").alias(c) for c in df.columns], place)
    return out.select(*df.columns, _size(text).alias(size), F.pmod(F.col(place), F.lit(n_shards)).cast("int").alias(shard), F.floor(F.col(place) / n_shards).cast("long").alias(slot))


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder for each shard; files hold their records in slot order."""
    sharded.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Operators on half-open byte ranges [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose order value shares its upper bits are one bucket of a two-level running sum.
BUCKET_BITS = 12
#: Tiles whose number shares its upper bits are one row of tiles of a two-level running maximum.
ROW_BITS = 10


def running_offsets(df: DataFrame, order: str, size: str, start: str = "start", end: str = "end", bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Lay rows end to end by ``order``: [start, end) from a running sum of ``size``.

    Two levels, so no task sorts all rows: sums within a bucket of neighbouring order values, and over buckets.
    """
    bucket = F.shiftright(F.col(order), bucket_bits)
    tops = df.groupBy(bucket.alias("_b")).agg(F.sum(size).alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_b", bucket).join(tops, "_b").withColumn("_e", F.sum(size).over(within) + F.col("_o"))
    return out.withColumn(start, (F.col("_e") - F.col(size)).cast("long")).withColumn(end, F.col("_e").cast("long")).drop("_b", "_o", "_e")


def tensor_index(docs: DataFrame) -> DataFrame:
    """Documents as an index of named, typed byte ranges."""
    rows = docs.select(F.col("doc_id").alias("name"), F.col("source").alias("member"), F.col("lang").alias("dtype"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("nbytes"))
    return running_offsets(rows, "name", "nbytes")


def merge_ranges(spans: DataFrame, by: list[str] = [], start: str = "start", end: str = "end") -> DataFrame:  # noqa: B006
    """Ranges of each group, merged where they touch or overlap; empty ranges count as points."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = spans.select(*by, F.col(start).alias("lo"), F.col(end).alias("hi"))
    before = w.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.col("lo") - 1)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(w.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "island").agg(F.min("lo").alias(start), F.max("hi").alias(end)).drop("island")


def merge_ranges_by_tile(spans: DataFrame, tile: int, start: str = "start", end: str = "end", levels: int = 2, widen: int = 1024) -> DataFrame:
    """merge_ranges() of one large group: within tiles of the address space first. What touches no border of its tile is
    merged by then; the rest goes on to tiles ``widen`` times as wide, and only borders of the widest tiles meet in one task."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    pieces = spans.select(F.explode(F.sequence(F.floor(F.col(start) / tile), F.floor(last / tile))).alias("tile"), F.col(start).alias("s"), F.col(end).alias("e"))
    pieces = pieces.select("tile", F.greatest("s", F.col("tile") * tile).cast("long").alias("s"), F.least("e", (F.col("tile") + 1) * tile).cast("long").alias("e"))
    local = merge_ranges(pieces, ["tile"], "s", "e")
    border = (F.col("s") == F.col("tile") * tile) | (F.col("e") == (F.col("tile") + 1) * tile)
    inner, rest = (local.where(x).select(F.col("s").alias(start), F.col("e").alias(end)) for x in (~border, border))
    return inner.unionByName(merge_ranges_by_tile(rest, tile * widen, start, end, levels - 1, widen) if levels > 1 else merge_ranges(rest, [], start, end))


def units_of(index: DataFrame, chunk: int, start: str = "start", end: str = "end", step: int = 1 << 16) -> DataFrame:
    """(off, len): pieces of ``chunk`` bytes of all bytes that the index covers from 0 on, the last one short.

    Each range gives the pieces that begin in it, ``step`` of them at a time, so no row holds the pieces of the whole.
    """
    first, last = F.ceil(F.col(start) / chunk).cast("long"), (F.ceil(F.col(end) / chunk) - 1).cast("long")
    rows = index.where(F.col(start) < F.col(end)).select(first.alias("_a"), last.alias("_z")).where("_a <= _z")
    rows = rows.select("_z", F.explode(F.sequence("_a", "_z", F.lit(step).cast("long"))).alias("_a"))
    rows = rows.select(F.explode(F.sequence("_a", F.least("_z", F.col("_a") + step - 1))).alias("_i"))
    total = index.agg(F.max(end).alias("_n"))  # one row
    return rows.join(F.broadcast(total)).select((F.col("_i") * chunk).alias("off"), F.least(F.lit(chunk).cast("long"), F.col("_n") - F.col("_i") * chunk).alias("len"))


def overlapping_units(units: DataFrame, spans: DataFrame, chunk: int, total: int | None = None) -> DataFrame:
    """Units [dst, dst + rlen) that overlap any span, each once.

    Spans are cut at multiples of ``chunk`` and meet units by tile number, an equi semi join instead of a nested loop.
    """
    lo = F.greatest(F.col("start"), F.lit(0))
    hi = F.least(F.col("end"), F.lit(total)) if total is not None else F.col("end")
    s = spans.select(lo.alias("lo"), hi.alias("hi")).where("lo < hi")
    s = s.select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / chunk), F.floor((F.col("hi") - 1) / chunk))).alias("tile"))
    u = units.where("rlen > 0").withColumn("tile", F.explode(F.sequence(F.floor(F.col("dst") / chunk), F.floor((F.col("dst") + F.col("rlen") - 1) / chunk))))
    hit = u.join(s, (u["tile"] == s["tile"]) & (u["dst"] < s["hi"]) & (u["dst"] + u["rlen"] > s["lo"]), "left_semi").drop("tile")
    return hit.dropDuplicates(["off"])


def cover(units: DataFrame) -> DataFrame:
    """One row: the least range that holds all units, (0, 0) without any."""
    return units.agg(F.coalesce(F.min("dst"), F.lit(0)).cast("long").alias("lo"), F.coalesce(F.max(F.col("dst") + F.col("rlen")), F.lit(0)).cast("long").alias("hi"))


def clip(spans: DataFrame, lo, hi, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges cut to [lo, hi); empty ones go."""
    return spans.withColumn(start, F.greatest(F.col(start), F.lit(lo))).withColumn(end, F.least(F.col(end), F.lit(hi))).where(F.col(start) < F.col(end))


def placed_bytes(units: DataFrame, lo, hi) -> DataFrame:
    """Per unit: bytes that land inside [lo, hi), the overhang, and the whole length that counts as decoded."""
    inside = F.greatest(F.least(F.col("dst") + F.col("rlen"), F.lit(hi)) - F.greatest(F.col("dst"), F.lit(lo)), F.lit(0))
    return units.where((F.col("dst") < hi) & (F.col("dst") + F.col("rlen") > lo)).withColumn("inside", inside).withColumn("scratch", F.col("rlen") - inside)


def fixed_chunks(total: Column, chunk: int) -> Column:
    """Array of (off, len): pieces of ``chunk`` bytes, the last one short."""
    n = F.ceil(total / chunk).cast("long")
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((i * chunk).alias("off"), F.least(F.lit(chunk).cast("long"), total - i * chunk).alias("len")))
    return F.when(total > 0, pieces).otherwise(F.array().cast("array<struct<off:bigint,len:bigint>>"))


def even_split(total: Column, target: int) -> Column:
    """Array of (off, len): about total / target equal pieces without runts; the last takes the remainder."""
    n = F.greatest(F.lit(1).cast("long"), F.floor(total / target))
    step = F.floor(total / n)
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((i * step).cast("long").alias("off"), F.when(i == n - 1, total - i * step).otherwise(step).cast("long").alias("len")))
    return F.when(total > 0, pieces).otherwise(F.array().cast("array<struct<off:bigint,len:bigint>>"))


def sample_regions(size: Column, sample: int, n: int) -> Column:
    """Array of n region starts spread over ``size``; all 0 if one sample holds everything."""
    step = F.greatest(F.lit(1).cast("long"), F.floor((size - sample) / max(1, n - 1)))
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(i * step, size - sample).cast("long"))
    return F.when(size <= sample, F.array_repeat(F.lit(0).cast("long"), n)).otherwise(spread)


def complement(extents: DataFrame, total: Column | int, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Extents and the gaps between them and up to ``total``: (by, start, end, kind); overlap or excess is an error."""
    size = F.lit(total) if isinstance(total, int) else total
    w = Window.partitionBy(*by).orderBy("s", "e")
    rows = extents.select(*by, size.alias("size"), F.col(start).alias("s"), F.col(end).alias("e"))
    rows = rows.withColumn("prev", F.coalesce(F.lag("e").over(w), F.lit(0))).withColumn("next", F.lead("s").over(w))
    rows = rows.withColumn("prev", F.when(F.col("s") < F.col("prev"), F.raise_error(F.lit("extents overlap")).cast("long")).otherwise(F.col("prev")))
    rows = rows.withColumn("e", F.when(F.col("e") > F.col("size"), F.raise_error(F.lit("extent past the end")).cast("long")).otherwise(F.col("e")))
    row = lambda a, b, kind: F.struct(a.cast("long").alias(start), b.cast("long").alias(end), F.lit(kind).alias("kind"))
    parts = F.array(row(F.col("prev"), F.col("s"), "clear"), row(F.col("s"), F.col("e"), "payload"), F.when(F.col("next").isNull(), row(F.col("e"), F.col("size"), "clear")))
    return rows.select(*by, F.explode(parts).alias("x")).where("x is not null").select(*by, "x.*").where(F.col(start) < F.col(end))


def member_range(index: DataFrame, member: str) -> DataFrame:
    """One row with the range of a member; a missing member is an error."""
    row = index.where(F.col("member") == member).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return row.select(F.when(F.col("start").isNull(), F.raise_error(F.lit(f"no member {member}")).cast("long")).otherwise(F.col("start")).alias("start"), "end")


def floor_lookup(points: DataFrame, starts: DataFrame, point: str, start: str, keep: list[str], tile: int) -> DataFrame:
    """As-of join backward: for each point the last row of ``starts`` at or before it.

    Both sides go to tiles of the axis; within a tile the last start so far is carried by a window, and a start that
    reigns over whole tiles is carried by a running maximum over tile heads, in two levels.
    """
    p = points.withColumn("_t", F.floor(F.col(point) / tile)).withColumn("_x", F.col(point)).withColumn("_k", F.lit(1))
    s = starts.select(F.col(start).alias("_x"), F.struct(F.col(start).alias("s"), *keep).alias("_v")).withColumn("_t", F.floor(F.col("_x") / tile)).withColumn("_k", F.lit(0))
    heads = s.groupBy("_t").agg(F.max("_v").alias("_h"))
    tiles = heads.select("_t").union(p.select("_t")).distinct().join(heads, "_t", "left")
    # The last start so far among the tiles of a row of tiles, else the last of the rows before; rows are few.
    row = F.shiftright("_t", ROW_BITS)
    near = Window.partitionBy("_r").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    far = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    rows = heads.groupBy(row.alias("_r")).agg(F.max("_h").alias("_h")).unionByName(tiles.select(row.alias("_r")).distinct(), allowMissingColumns=True)
    rows = rows.groupBy("_r").agg(F.max("_h").alias("_h")).select("_r", F.max("_h").over(far).alias("_far"))
    tiles = tiles.withColumn("_r", row).withColumn("_near", F.max("_h").over(near)).join(rows, "_r").select("_t", F.coalesce("_near", "_far").alias("_c"))
    w = Window.partitionBy("_t").orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = p.join(tiles, "_t").unionByName(s, allowMissingColumns=True).withColumn("_f", F.coalesce(F.last("_v", ignorenulls=True).over(w), F.col("_c")))
    return both.where("_k = 1").select(*points.columns, F.col("_f.s").alias(f"floor_{start}"), *[F.col(f"_f.{c}").alias(f"floor_{c}") for c in keep])


def tensors_by_name(index: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """Rows of the index that are asked for by name."""
    return index.join(wanted.select(F.col(name).alias("_w")).distinct(), F.col("name") == F.col("_w"), "left_semi")


def largest(index: DataFrame, n: int = 20) -> DataFrame:
    """The n largest tensors; ties by name."""
    return index.orderBy(F.col("nbytes").desc(), "name").limit(n)


def device_spans(index: DataFrame, wanted: DataFrame | None, tile: int) -> DataFrame:
    """(start, end) that a device load must cover: one range with all of it, or the merged ranges of what is wanted."""
    if wanted is None:
        return index.agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merge_ranges_by_tile(wanted.select("start", "end"), tile)

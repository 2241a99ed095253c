"""Sealed files as rows: extents of a file in order, some clear, the others sealed each on its own.

A read of a byte range opens only the extents that it overlaps. Extents meet ranges by file and tile of the plain
address, so no range is compared with all extents of its file; what a read gives back is bounded by what it asks for.
"""

from __future__ import annotations

import hmac
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import FOR_STRUCTURE, hkdf
from ..functions.sealing import open_sealed, seal

TAG = 16


def seal_file(extents: DataFrame, keys: DataFrame) -> DataFrame:
    """(file, ord, start, len, clear, content) with stored bytes: as they are where clear, else sealed with their tag."""
    out = seal(extents, keys, "content", "ord")
    return out.select("file", "ord", "start", "len", "clear", F.when(F.col("clear"), F.col("content")).otherwise(F.col("sealed")).alias("stored"))


def overlapping(extents: DataFrame, ranges: DataFrame, tile: int) -> DataFrame:
    """Extents of each (file, lo, hi) that they overlap, once each."""
    steps = lambda lo, hi: F.explode(F.sequence(F.floor(lo / tile), F.floor((hi - 1) / tile)))
    r = ranges.where("lo < hi").select(F.col("file").alias("_f"), "lo", "hi", steps(F.col("lo"), F.col("hi")).alias("_t"))
    e = extents.where("len > 0").withColumn("_u", steps(F.col("start"), F.col("start") + F.col("len")))
    both = e.join(r, (F.col("file") == F.col("_f")) & (F.col("_u") == F.col("_t")) & (F.col("start") < F.col("hi")) & (F.col("start") + F.col("len") > F.col("lo")))
    first = F.greatest(F.floor(F.col("lo") / tile), F.floor(F.col("start") / tile))  # they may share several tiles
    return both.where(F.col("_t") == first).drop("_f", "_t", "_u")


def read(stored: DataFrame, keys: DataFrame, ranges: DataFrame, tile: int = 1 << 20) -> DataFrame:
    """(file, lo, hi, content) of each range; a sealed extent that was changed gives NULL."""
    hit = open_sealed(overlapping(stored, ranges, tile), keys, "stored", "ord")
    plain = F.when(F.col("clear"), F.col("stored")).otherwise(F.col("opened"))
    at, end = F.greatest("start", "lo"), F.least(F.col("start") + F.col("len"), F.col("hi"))
    piece = F.substring(plain, (at - F.col("start") + 1).cast("int"), (end - at).cast("int"))
    rows = hit.select("file", "lo", "hi", at.alias("at"), piece.alias("piece"))
    whole = rows.groupBy("file", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.hex("piece"), F.lit("")).alias("x")))).alias("l"), F.count_if(F.col("piece").isNull()).alias("bad"))
    return whole.select("file", "lo", "hi", F.when(F.col("bad") == 0, F.unhex(F.array_join(F.transform("l", lambda x: x["x"]), ""))).alias("content"))


def stored_length(length: Column, clear: Column) -> Column:
    return F.when(clear, length).otherwise(length + TAG)


def structure_mac(stored: DataFrame, key: bytes) -> DataFrame:
    """(file, mac): HMAC over the clear bytes of a file in order, and then its extent table, so that nothing outside the
    sealed extents can be changed or moved. Rows of a file pass once, in order; the state is one HMAC."""
    own = hkdf(key, b"", FOR_STRUCTURE)
    clear = stored.where("clear").select("file", F.lit(0).alias("part"), "ord", F.col("stored").alias("data"))
    row = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in (F.col("start"), F.col("len"), F.octet_length("stored").cast("long"))], F.when(F.col("clear"), F.lit(b"\x00")).otherwise(F.lit(b"\x01")))
    rows = clear.unionByName(stored.select("file", F.lit(1).alias("part"), "ord", row.alias("data")))
    kind = dict(stored.dtypes)["file"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema: list[pa.DataType] = []

        def stream() -> Iterator[tuple]:
            for b in batches:
                schema[:] = [b.schema.types[0]]
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

        for file, own_rows in groupby(stream(), key=lambda r: r[0]):
            mac = hmac.new(own, digestmod="sha256")
            for _, data in own_rows:
                mac.update(data)
            yield pa.RecordBatch.from_arrays([pa.array([file], schema[0]), pa.array([mac.hexdigest()])], ["file", "mac"])

    ordered = rows.repartition("file").sortWithinPartitions("file", "part", "ord").select("file", "data")
    return ordered.mapInArrow(run, f"file {kind}, mac string")


def altered(stored: DataFrame, declared: DataFrame, key: bytes) -> DataFrame:
    """(code, path, detail) of files whose structure does not have the declared MAC."""
    rows = declared.select("file", F.col("mac").alias("_m")).join(structure_mac(stored, key), "file", "left")
    return rows.where(~F.coalesce(F.col("mac") == F.col("_m"), F.lit(False))).select(F.lit("structure").alias("code"), F.col("file").cast("string").alias("path"), F.col("mac").alias("detail"))

"""Index of files that begin with a little-endian length and a JSON header of named tensors, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>"
HEADER_LIMIT = 64 << 20


def header_length(content: Column) -> Column:
    """The first eight bytes as a little-endian number."""
    hexes = F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.hex(F.substring(content, i + 1, F.lit(1))))
    return F.conv(F.array_join(hexes, ""), 16, 10).cast("decimal(20,0)")


def tensors(files: DataFrame, tolerant: bool = False) -> DataFrame:
    """(path, name, dtype, shape, start, end) from (path, content); a bad header is an error, or gives no rows."""
    n = header_length(F.col("content"))
    rows = files.select("path", "content", n.alias("n"), F.octet_length("content").alias("size"))
    good = (F.col("n") > 0) & (F.col("n") <= F.least(F.col("size") - 8, F.lit(HEADER_LIMIT)))
    rows = rows.where(F.coalesce(good, F.lit(False))) if tolerant else rows.withColumn("n", F.when(good, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("bad header in "), "path")).cast("decimal(20,0)")))
    text = F.decode(F.expr("substring(content, 9, cast(n as int))"), "UTF-8")
    entries = rows.select("path", "n", F.explode(F.from_json(text, HEADER)).alias("name", "t")).where("name <> '__metadata__'")
    base = F.col("n").cast("long") + 8
    return entries.select("path", "name", F.col("t.dtype").alias("dtype"), F.col("t.shape").alias("shape"), (base + F.col("t.data_offsets")[0]).alias("start"), (base + F.col("t.data_offsets")[1]).alias("end"))


def read(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    return tensors(spark.read.format("binaryFile").load(path).select("path", "content"), tolerant)


def sharded(spark: SparkSession, index_json: str, tensors_: DataFrame) -> DataFrame:
    """Tensors of a sharded model, each from the shard its index file names."""
    return from_shards(spark.read.text(index_json, wholetext=True), tensors_)


def from_shards(index: DataFrame, tensors_: DataFrame) -> DataFrame:
    """Rows (path, name, ..) that the index text ``value`` assigns to their file; the shard stays in the key, as offsets are its own."""
    doc = index.select(F.explode(F.from_json("value", "struct<weight_map:map<string,string>>").getField("weight_map")).alias("name", "shard"))
    own = tensors_.withColumn("shard", F.element_at(F.split("path", "/"), -1))
    return own.join(doc, ["name", "shard"])


def pick_files(files: DataFrame, suffixes: tuple[str, ...] = (".rloom", ".safetensors")) -> DataFrame:
    """Files of the first suffix that any file of a folder has."""
    rank = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(suffixes))):
        rank = F.when(F.col("path").endswith(s), i).otherwise(rank)
    rows = files.withColumn("rank", rank).where("rank is not null").withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    best = rows.groupBy("folder").agg(F.min("rank").alias("rank"))
    return rows.join(best, ["folder", "rank"]).drop("folder", "rank")


def open_kinds(files: DataFrame, index: str = "model.safetensors.index.json", suffixes: tuple[str, ...] = (".rloom", ".safetensors")) -> DataFrame:
    """(folder, kind, path): how each folder of a listing is opened: as shards where an index names them, as its one file
    where there is one of the first suffix that any has, else not at all."""
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.element_at(F.split("path", "/"), -1)
    every = files.select(folder.alias("folder"), "path", (name == index).alias("is_index"))
    per = every.groupBy("folder").agg(F.bool_or("is_index").alias("sharded"), F.min(F.when(F.col("is_index"), F.col("path"))).alias("index"))
    own = pick_files(files, suffixes).select(folder.alias("_f"), "path").groupBy("_f").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("one"))
    rows = per.join(own, F.col("folder") == F.col("_f"), "left")
    kind = F.when(F.col("sharded"), "sharded").when(F.col("n") == 1, "single").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return rows.select("folder", kind.alias("kind"), F.when(F.col("sharded"), F.col("index")).when(F.col("n") == 1, F.col("one")).alias("path"))

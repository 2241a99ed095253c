"""A container of independently compressed chunks, as a Spark data source and sink.

Layout: magic, version; chunks one after another; a zlib-compressed JSON index (chunks, members, sizes); a footer with
the index's place and a tail. Each chunk is compressed alone and has the CRC-32 of its plain bytes, so any byte range
is read from the chunks that overlap it. The reader finds the footer first, prunes chunks by range, groups neighbouring
chunks into reads of about ``target`` bytes, and makes a partition of each group.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType

from ..operators.folds import coalesced
from ..operators.ranges import fixed_chunks

MAGIC, TAIL, VERSION = b"RLOOMARC", b"RLOOMTAI", 1
HEAD, FOOT = "<8sI", "<QQ8s"
CHUNK, TARGET = 4 << 20, 4 << 20
OPTIONS = {"level", "chunk"}
#: First bytes of a Zstandard frame.
ZSTD = b"\x28\xb5\x2f\xfd"


class CorruptArchive(ValueError):
    pass


def encode(members: Iterable[tuple[str, bytes]], path: str, **options) -> dict:
    """Write members, one at a time, to a new container; an option that is not declared is an error. Returns the index."""
    unknown = set(options) - OPTIONS
    if unknown:
        raise ValueError(f"options {sorted(unknown)} are not declared; there are {sorted(OPTIONS)}")
    level, chunk = int(options.get("level", 1)), int(options.get("chunk", CHUNK))
    rows, names, seen, dst = [], [], set(), 0
    try:
        with open(path, "xb") as f:
            f.write(struct.pack(HEAD, MAGIC, VERSION))
            for name, data in members:
                if name in seen:
                    raise ValueError("member names repeat")
                seen.add(name)
                names.append({"path": name, "size": len(data), "dst": dst})
                for at in range(0, len(data), chunk):
                    plain = data[at : at + chunk]
                    coded = zlib.compress(plain, level)
                    rows.append([f.tell(), len(coded), dst + at, len(plain), zlib.crc32(plain)])
                    f.write(coded)
                dst += len(data)
            index = {"chunks": rows, "members": names, "plain": dst}
            body, at = zlib.compress(json.dumps(index, sort_keys=True, separators=(",", ":")).encode()), f.tell()
            f.write(body + struct.pack(FOOT, at, len(body), TAIL))
    except ValueError:
        os.unlink(path)
        raise
    return index


def expand(path: str, member: str | None, out: str, overwrite: bool = False) -> int:
    """A member, or all, of a container as a plain file, chunk by chunk; an existing file is refused. Returns its bytes."""
    index = read_index(path)
    lo, hi = 0, index["plain"]
    if member is not None:
        own = next((m for m in index["members"] if m["path"] == member), None)
        if own is None:
            raise KeyError(f"no member {member}")
        lo, hi = own["dst"], own["dst"] + own["size"]
    reader = ArchiveReader({"path": path, "start": str(lo), "end": str(hi)})
    with open(out, "wb" if overwrite else "xb") as f:
        for part in reader.partitions():
            for _, _, _, plain in reader.read(part):
                f.write(plain)
    return hi - lo


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow reads by its address, or of this machine."""
    files, place = (pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path))
    return files.open_input_file(place)


def is_archive(path: str) -> bool:
    with opened(path) as f:
        return f.read(len(MAGIC)) == MAGIC


def read_index(path: str) -> dict:
    with opened(path) as f:
        size = f.size()
        if size < struct.calcsize(HEAD) + struct.calcsize(FOOT):
            raise CorruptArchive(f"{path}: too short")
        f.seek(0)
        magic, version = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
        f.seek(size - struct.calcsize(FOOT))
        at, n, tail = struct.unpack(FOOT, f.read(struct.calcsize(FOOT)))
        if magic != MAGIC or tail != TAIL or version != VERSION or at + n + struct.calcsize(FOOT) != size:
            raise CorruptArchive(f"{path}: not a container of version {VERSION}")
        f.seek(at)
        return json.loads(zlib.decompress(f.read(n)))


def runs(chunks: list[list[int]], target: int) -> list[list[list[int]]]:
    """Chunks that one read takes together, by the rule of coalesce_runs()."""
    out, at = [], 0
    for _, _, _, _, n in coalesced(((c[0], c[1]) for c in chunks), target):
        out.append(chunks[at : at + n])
        at += n
    return out


class _Run(InputPartition):
    def __init__(self, path: str, chunks: list[list[int]]):
        self.path, self.chunks = path, chunks


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.lo = int(options.get("start", 0))
        self.hi = int(options["end"]) if "end" in options else None
        self.target = int(options.get("target", TARGET))

    def partitions(self) -> list[InputPartition]:
        index = read_index(self.path)
        hi = index["plain"] if self.hi is None else self.hi
        touched = [c for c in index["chunks"] if c[2] < hi and c[2] + c[3] > self.lo]
        return [_Run(self.path, r) for r in runs(touched, self.target)] or [_Run(self.path, [])]

    def read(self, partition: _Run) -> Iterator[tuple]:
        if not partition.chunks:
            return
        first, last = partition.chunks[0], partition.chunks[-1]
        with opened(partition.path) as f:
            f.seek(first[0])
            payload = f.read(last[0] + last[1] - first[0])
        for off, clen, dst, rlen, crc in partition.chunks:
            plain = zlib.decompress(payload[off - first[0] : off - first[0] + clen])
            if len(plain) != rlen or zlib.crc32(plain) != crc:
                raise CorruptArchive(f"{partition.path}: chunk at {off} does not match its checksum")
            lo, hi = max(dst, self.lo), dst + rlen if self.hi is None else min(dst + rlen, self.hi)
            yield off, clen, lo, plain[lo - dst : hi - dst]


@dataclass
class _Written(WriterCommitMessage):
    path: str
    members: int
    plain: int


class ArchiveWriter(DataSourceWriter):
    """A folder with a container of each task's rows (path, content); names must differ. Containers appear when all tasks are
    done, and what a failed job left goes."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.options = options["path"], {k: options[k] for k in OPTIONS if k in options}
        unknown = set(options) - OPTIONS - {"path"}
        if unknown:
            raise ValueError(f"options {sorted(unknown)} are not declared; there are {sorted(OPTIONS)}")
        if os.path.isdir(self.folder) and any(n.endswith(".rloom") for n in os.listdir(self.folder)) and not overwrite:
            raise FileExistsError(f"{self.folder} has containers already")
        self.overwrite = overwrite

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.rloom.part")
        index = encode(((r["path"], bytes(r["content"])) for r in iterator), path, **self.options)
        return _Written(path, len(index["members"]), index["plain"])

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for n in os.listdir(self.folder):
                if n.endswith(".rloom"):
                    os.unlink(os.path.join(self.folder, n))
        for m in messages:
            if m is not None and m.members:
                os.rename(m.path, m.path.removesuffix(".part"))
            elif m is not None:
                os.unlink(m.path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.unlink(m.path)


class ArchiveSource(DataSource):
    """spark.read.format("rangeloom_archive").option("start", a).option("end", b).load(path), and
    df.select("path", "content").write.format("rangeloom_archive").mode("append").save(folder) on a folder that all share."""

    @classmethod
    def name(cls) -> str:
        return "rangeloom_archive"

    def schema(self) -> str:
        return "off long, clen long, start long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options, overwrite)


def plain_chunks(rows: DataFrame, key: str, content: str, chunk: int = CHUNK) -> DataFrame:
    """(key, dst, rlen, crc, content): the contents in pieces of ``chunk`` bytes, with the checksum of each."""
    pieces = rows.select(key, content, F.inline(fixed_chunks(F.octet_length(content).cast("long"), chunk)))
    own = F.substring(F.col(content), (F.col("off") + 1).cast("int"), F.col("len").cast("int"))
    out = pieces.select(F.col(key), F.col("off").alias("dst"), F.col("len").alias("rlen"), own.alias("content"))
    return out.select(key, "dst", "rlen", F.crc32("content").alias("crc"), "content")


def encode_chunks(rows: DataFrame, key: str, content: str, chunk: int = CHUNK, level: int = 1) -> DataFrame:
    """(key, dst, rlen, crc, clen, coded): a container as rows, chunks compressed alone. Spark's own writers are its sink, so
    encoding has as many tasks as there are contents."""

    @F.pandas_udf(BinaryType())
    def press(plain: pd.Series) -> pd.Series:
        return plain.map(lambda x: zlib.compress(x, level))

    out = plain_chunks(rows, key, content, chunk).withColumn("coded", press("content").alias("coded"))
    return out.select(key, "dst", "rlen", "crc", F.octet_length("coded").cast("long").alias("clen"), "coded")


@F.pandas_udf(BinaryType())
def inflate(coded: pd.Series) -> pd.Series:
    """Plain bytes, by the coder that the first bytes tell: Zstandard's frame, else deflate."""
    import zstandard

    return coded.map(lambda x: zstandard.ZstdDecompressor().decompressobj().decompress(x) if x[:4] == ZSTD else zlib.decompress(x))


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """Rows of encode_chunks() with their contents; a length or checksum that differs is an error."""
    out = chunks.withColumn("content", inflate("coded"))
    right = (F.octet_length("content") == F.col("rlen")) & (F.crc32("content") == F.col("crc"))
    return out.withColumn("content", F.when(right, F.col("content")).otherwise(F.raise_error(F.lit("checksum differs")).cast("binary"))).drop("coded", "clen")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def index_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, members) of a container, for the range operators."""
    index = read_index(path)
    chunks = spark.createDataFrame(index["chunks"], "off long, clen long, dst long, rlen long, crc long")
    return chunks, spark.createDataFrame([(m["path"], m["size"], m["dst"]) for m in index["members"]], "path string, size long, dst long")


# Tasks get this module by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

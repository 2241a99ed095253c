"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Paths that keep() wrote, by the scratch() that they were written in.
_scopes: list[list[str]] = []
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all is one process, as in tests,
    may it be unset; a folder of this machine then does."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: these operators need a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="rangeloom-")
    return _local[app]


def keep(df: DataFrame, name: str, up: int | None = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and any executor may be lost after.

    It goes with the scratch() around, or one ``up`` scopes further out; None: it stays.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if up is not None and up < len(_scopes):
        _scopes[-1 - up].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a written table is worked on in one task.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """A written table as it is, or in one partition if it has FEW rows at most: sums and joins of such need no exchange."""
    return df.coalesce(1) if df.count() <= FEW else df


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_kept(*tables: DataFrame) -> None:
    """Remove the files of tables that keep() wrote and nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What keep() writes in here goes at the end; results must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def lean(run: Callable) -> Callable:
    """A function over batches for mapInArrow; its process gives memory back when its task ends, as it may wait idle."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def slices(texts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts with at most so many rows, and about so many bytes unless one text has more."""
    import numpy as np

    n = len(texts)
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < n:
        before = int(ends[lo - 1]) if lo else 0
        hi = min(n, lo + rows, max(lo + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield lo, hi - lo
        lo = hi


class Remembered(dict):
    """Values of words, made once and forgotten when their bytes would pass ``limit``."""

    def __init__(self, limit: int, make: Callable):
        super().__init__()
        self.limit, self.make, self.used = limit, make, 0

    def of(self, words: list) -> Iterator:
        """The value of each word in turn."""
        try:
            return iter(list(map(self.__getitem__, words)))
        except KeyError:
            distinct = set(words)
            fresh = [w for w in distinct if w not in self]
            cost = self._cost(fresh)
            if self.used + cost > self.limit:
                self.clear()
                self.used, fresh = 0, distinct
                cost = self._cost(fresh)
                if cost > self.limit:
                    own = {w: self.make(w) for w in distinct}
                    return map(own.__getitem__, words)
            self.update((w, self.make(w)) for w in fresh)
            self.used += cost
            return map(self.__getitem__, words)

    @staticmethod
    def _cost(words) -> int:
        return sum(map(len, words)) + 120 * len(words)  # about what an entry takes beside the word


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def spare(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that ``df`` doesn't have, whatever the case of letters."""
    taken, name = {c.lower() for c in df.columns}, wanted
    while name.lower() in taken:
        name = "_" + name
    return name

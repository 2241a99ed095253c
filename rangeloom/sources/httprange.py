"""An object behind HTTP as a Spark data source: ranges are partitions, each fetched by its own task.

    spark.read.format("rangeloom_http").option("part", 8 << 20).load("https://host/object")

That a server serves ranges is shown by a range of one byte that it answers with 206, not by a header. One that does
not is read as a whole in one partition. A task tries again TRIES times, and Spark runs a lost task anew.
"""

from __future__ import annotations

import json
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART, TRIES, TIMEOUT = 8 << 20, 3, 30.0


def fetch(url: str, headers: dict[str, str], lo: int | None = None, hi: int | None = None) -> tuple[int, bytes, str | None]:
    """(status, body, content range) of bytes [lo, hi), or of all; 416 is an empty object."""
    own = dict(headers) | ({"Range": f"bytes={lo}-{hi - 1}"} if lo is not None else {})
    for left in range(TRIES - 1, -1, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=own), timeout=TIMEOUT) as r:
                return r.status, r.read(), r.headers.get("Content-Range")
        except urllib.error.HTTPError as e:
            if e.code == 416:
                return 416, b"", None
            if e.code < 500 or not left:
                raise OSError(f"the server answered {e.code}") from None  # an address may hold a credential
        except OSError as e:
            if not left:
                raise OSError(f"no answer: {type(e).__name__}") from None
        time.sleep(0.1 * 2 ** (TRIES - left))
    raise AssertionError


def size_of(url: str, headers: dict[str, str]) -> int | None:
    """The object's size, or None if the server does not serve ranges of it."""
    status, _, told = fetch(url, headers, 0, 1)
    if status == 416:
        return 0
    return int(told.rpartition("/")[2]) if status == 206 and told and not told.endswith("/*") else None


class _Part(InputPartition):
    def __init__(self, lo: int | None, hi: int | None):
        self.lo, self.hi = lo, hi


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.part = options["path"], int(options.get("part", PART))
        self.headers = json.loads(options.get("headers", "{}"))
        self.lo, self.hi = int(options.get("start", 0)), int(options["end"]) if "end" in options else None

    def partitions(self) -> list[InputPartition]:
        size = size_of(self.url, self.headers)
        if size is None:
            return [_Part(None, None)]
        hi = size if self.hi is None else min(size, self.hi)
        return [_Part(at, min(at + self.part, hi)) for at in range(self.lo, hi, self.part)] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.lo is None:  # no ranges: the whole body once, cut here
            body = fetch(self.url, self.headers)[1][self.lo : self.hi]
            for at in range(0, len(body), self.part):
                yield self.lo + at, body[at : at + self.part]
        elif partition.hi > partition.lo:
            status, body, _ = fetch(self.url, self.headers, partition.lo, partition.hi)
            if len(body) != partition.hi - partition.lo:
                raise EOFError(f"{len(body)} bytes in place of {partition.hi - partition.lo}")
            yield partition.lo, body


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rangeloom_http"

    def schema(self) -> str:
        return "start long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)


# Tasks get this module by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

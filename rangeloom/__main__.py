"""python -m rangeloom VERB ...

list | run NAME SF_DIR | explain NAME SF_DIR     queries
write OUT FILE... | info ARCHIVE                 containers
get ARCHIVE MEMBER OUT | cat ARCHIVE START END
plan PLAIN CODED SOURCE DECODE                   whether to read coded (sizes in bytes, rates as 450MB/s; - if unknown)
probe CODER                                      rates of a coder on this machine
doctor                                           the session
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import functions as F

from . import catalog
from .functions.text import rate, size_text
from .operators import campaign, profile
from .plans import cost
from .session import session
from .sources import archive


def _local():
    spark = session(master="local[2]")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def write(out: str, *files: str) -> None:
    index = archive.encode(((os.path.basename(f), open(f, "rb").read()) for f in files), out)
    print(f"{len(index['members'])} members, {index['plain']} bytes, {os.path.getsize(out)} stored")


def info(path: str) -> None:
    chunks, members = archive.index_frames(_local(), path)
    members.orderBy(F.col("size").desc(), "path").limit(20).select("path", size_text(F.col("size")).alias("size")).show(truncate=False)
    chunks.agg(F.count(F.lit(1)).alias("chunks"), (F.sum("clen") / F.sum("rlen")).alias("ratio")).show()


def get(path: str, member: str, out: str) -> None:
    print(archive.expand(path, member, out))


def cat(path: str, start: str, end: str) -> None:
    reader = archive.ArchiveReader({"path": path, "start": start, "end": end})
    for part in reader.partitions():
        for row in reader.read(part):
            sys.stdout.buffer.write(row[3])


def plan(plain: str, coded: str, source: str, decode: str) -> None:
    whole = lambda x: F.lit(None if x == "-" else int(x)).cast("long")
    per_second = lambda x: rate(F.lit(None if x == "-" else x).cast("string"))
    none = F.lit(None).cast("double")
    case = _local().range(1).select(F.lit("plan").alias("case_id"), whole(plain).alias("plain"), whole(coded).alias("coded"), per_second(source).alias("source"), per_second(decode).alias("decode"), none.alias("decrypt"), none.alias("expand_write"))
    routes = cost.routes(cost.read_stages(case))
    routes.show(truncate=False)
    cost.decide(routes).show(truncate=False)


def probe(name: str) -> None:
    campaign.best_threads(profile.measure(_local(), name), ["codec", "what"], "threads", "rate").show(truncate=False)


def doctor() -> None:
    spark = _local()
    print(f"Spark {spark.version}, ANSI {spark.conf.get('spark.sql.ansi.enabled')}, AQE {spark.conf.get('spark.sql.adaptive.enabled')}")


VERBS = {"write": (write, 2, None), "info": (info, 1, 1), "get": (get, 3, 3), "cat": (cat, 3, 3), "plan": (plan, 4, 4), "probe": (probe, 1, 1), "doctor": (doctor, 0, 0)}


def main(args: list[str]) -> int:
    verb, given = (args[0] if args else ""), args[1:]
    if verb == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if verb in ("run", "explain") and len(given) == 2 and given[0] in catalog.QUERIES:
        df = catalog.QUERIES[given[0]](session(), given[1])
        df.explain("formatted") if verb == "explain" else df.show(50, truncate=False)
        return 0
    if verb in VERBS:
        run, least, most = VERBS[verb]
        if len(given) >= least and (most is None or len(given) <= most):
            run(*given)
            return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

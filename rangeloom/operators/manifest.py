"""Bundle manifests: reading, identity, and the rules that a manifest as a whole must meet.

A manifest is a JSON text. Fields have older names too (``name`` for ``path``, ``size`` or ``bytes`` for ``length``,
``digest`` for ``sha256``, ``identity`` for ``id``, ``artifacts`` for ``entries``); the first that is there counts. What
breaks a rule is a row (code, path, detail), never an exception, so one bad manifest does not stop the others.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import digest_is_valid, path_is_safe
from .bundle import ROLES, cycles, entry_id, schema_version

#: The schema that is read, and the newest minor version of it.
MAJOR, MINOR = 1, 0
#: Keys that do not count for a manifest's identity, as they state it.
IDENTITY_KEYS = ("manifest_sha256", "identity", "canonical_sha256")

_DEP = "struct<path:string,entry:string,name:string,id:string,identity:string,offset:bigint,length:bigint>"
_ENTRY = f"struct<path:string,name:string,role:string,length:string,decoded_bytes:string,size:string,bytes:string,sha256:string,digest:string,id:string,identity:string,dependencies:array<{_DEP}>,depends_on:array<{_DEP}>>"
SCHEMA = f"struct<schema:string,version:string,entry_point:string,graph:string,manifest_sha256:string,identity:string,entries:array<{_ENTRY}>,artifacts:array<{_ENTRY}>>"


def read(manifests: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, m): each manifest parsed; m has no entries where the text is no manifest."""
    return manifests.select(key, text, F.from_json(text, SCHEMA).alias("m"))


def entries(parsed: DataFrame, key: str) -> DataFrame:
    """(key, ord, path, role, length, sha256, id, dependencies), a row for each entry."""
    rows = parsed.select(key, F.posexplode(F.coalesce("m.entries", "m.artifacts")).alias("ord", "e"))
    first = lambda *names: F.coalesce(*[F.col(f"e.{n}") for n in names])
    path = first("path", "name")
    return rows.select(
        key, "ord", path.alias("path"), F.coalesce("e.role", F.lit("opaque")).alias("role"), first("length", "decoded_bytes", "size", "bytes").try_cast("long").alias("length"),
        F.lower(first("sha256", "digest")).alias("sha256"), F.coalesce(first("id", "identity"), entry_id(path)).alias("id"), first("dependencies", "depends_on").alias("dependencies"),
    )


@F.pandas_udf(StringType())
def identity(texts: pd.Series) -> pd.Series:
    """SHA-256 of the manifest as JSON with sorted keys and no blanks, without the keys that state it; NULL if it is none.

    Spark's to_json keeps a fixed set of fields in their order; an identity has all fields, sorted.
    """

    def one(text: str | None) -> str | None:
        try:
            m = json.loads(text)
        except (TypeError, ValueError):
            return None
        if not isinstance(m, dict):
            return None
        body = m["bundle"] if isinstance(m.get("bundle"), dict) else m
        body = {k: v for k, v in body.items() if k not in IDENTITY_KEYS}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    return texts.map(one)


def violations(parsed: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, path, detail) of manifests as a whole: shape, schema, declared identity, entry point."""
    rows = parsed.withColumn("all", F.coalesce("m.entries", "m.artifacts"))
    major, minor = schema_version(F.trim(F.coalesce("m.schema", "m.version", F.lit("1.0"))))
    point = F.coalesce("m.entry_point", "m.graph")
    paths = F.transform("all", lambda e: F.coalesce(e["path"], e["name"]))
    declared = F.coalesce("m.manifest_sha256", "m.identity")
    rows = rows.withColumns({"major": major, "minor": minor, "point": point, "declared": F.lower(declared), "own": F.when(declared.isNotNull(), identity(F.col(text)))})
    row = lambda when, code, path, detail: F.when(when, F.struct(F.lit(code).alias("code"), path.cast("string").alias("path"), detail.cast("string").alias("detail")))
    none = F.lit(None)
    shape = F.col("all").isNull() | (F.size("all") <= 0) | F.col("major").isNull()
    found = F.array(
        row(shape, "manifest_shape", none, none),
        row(F.col("major") != MAJOR, "unsupported_major", none, F.col("major")),
        row((F.col("major") == MAJOR) & (F.col("minor") > MINOR), "unsupported_minor", none, F.col("minor")),
        row(F.col("declared") != F.col("own"), "manifest_identity", none, F.col("declared")),
        row(F.col("point").isNotNull() & ~F.coalesce(F.array_contains(paths, F.col("point")), F.lit(False)), "missing_entry", F.col("point"), none),
    )
    return rows.select(key, F.explode(F.array_compact(found)).alias("v")).select(key, "v.*")


def entry_violations(rows: DataFrame, key: str) -> DataFrame:
    """(key, code, path, detail) of single entries: path, role, length, digest, and paths and ids that repeat."""
    row = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("code"), F.col("path").alias("path"), detail.cast("string").alias("detail")))
    found = F.array(
        row(~path_is_safe(F.col("path")), "unsafe_path", F.lit(None)),
        row(~F.col("role").isin(*ROLES), "unsupported_role", F.col("role")),
        row(F.col("length").isNull() | (F.col("length") < 0), "manifest_shape", F.col("length")),
        row(~digest_is_valid(F.col("sha256")), "manifest_shape", F.col("sha256")),
    )
    out = rows.select(key, F.explode(F.array_compact(found)).alias("v")).select(key, "v.*")
    for column, code in (("path", "duplicate_path"), ("id", "duplicate_identity")):
        again = rows.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("p")).where("n > 1")
        out = out.unionByName(again.select(key, F.lit(code).alias("code"), F.col("p").alias("path"), F.col("n").cast("string").alias("detail")))
    return out


def entry_points(rows: DataFrame, key: str, declared: str, path: str = "path", role: str = "role", order: str = "ord") -> DataFrame:
    """(key, entry): the declared path where it is an entry, else the first entry whose role is graph."""
    named = F.min(F.when(F.col(path) == F.col(declared), F.struct(order, path)))
    graph = F.min(F.when(F.col(role) == "graph", F.struct(order, path)))
    return rows.groupBy(key).agg(F.coalesce(named, graph).alias("e")).select(key, F.col(f"e.{path}").alias("entry"))


def changed_sources(before: DataFrame, now: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(code, path, detail): sources whose generation is not what it was, or cannot be told; NULL is no identity."""
    n = now.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = before.join(n, F.col(key) == F.col("_k"), "left")
    same = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f) == F.col(f"_{f}"), F.lit(False)), F.lit(f)) for f in fields])), ",")
    return rows.select(F.lit("source_changed").alias("code"), F.col(key).cast("string").alias("path"), same.alias("detail")).where("detail <> ''")


def cache_hits(sources: DataFrame, entries_: DataFrame, fields: list[str], entry: str = "entry") -> DataFrame:
    """Each source with the cached entry of exactly its generation, else NULL. A negative or missing number is no identity."""
    whole = [F.col(f) >= 0 for f in fields if dict(sources.dtypes)[f] in ("int", "bigint")]
    ok = F.coalesce(F.forall(F.array(*whole), lambda x: x), F.lit(False)) if whole else F.lit(True)
    e = entries_.groupBy(*[F.col(f).alias(f"_{f}") for f in fields]).agg(F.min(entry).alias(entry))
    cond = ok
    for f in fields:
        cond = cond & (F.col(f) == F.col(f"_{f}"))
    return sources.join(e, cond, "left").drop(*[f"_{f}" for f in fields])


def build(rows: DataFrame, key: str, entry_point: str | None = None) -> DataFrame:
    """(key, manifest) from entries (key, path, role, length, sha256): a manifest that read() takes, with its identity."""
    entry = F.struct(F.col("path"), F.col("length"), F.col("role"), F.col("sha256"))
    per = rows.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # one manifest is one row
    fields = [F.lit(f"{MAJOR}.{MINOR}").alias("schema"), F.col("entries")] + ([F.lit(entry_point).alias("entry_point")] if entry_point else [])
    bare = per.select(key, "entries", F.to_json(F.struct(*fields)).alias("_bare"))
    return bare.select(key, F.to_json(F.struct(*fields, identity(F.col("_bare")).alias("manifest_sha256"))).alias("manifest"))


class Provider(ABC):
    """What opens bundles of one kind: their manifests, and the files that these name, as (key, path, length, sha256)."""

    @abstractmethod
    def manifests(self) -> DataFrame:
        """(key, text)"""

    @abstractmethod
    def files(self) -> DataFrame:
        """(key, path, length, sha256) of what is there."""

    def inventory(self, strict: bool = True) -> DataFrame:
        """(key, path, role, length, sha256, valid); without ``strict`` no file is looked at and valid is NULL."""
        rows = entries(read(self.manifests(), "key", "text"), "key").select("key", "path", "role", "length", "sha256")
        if not strict:
            return rows.withColumn("valid", F.lit(None).cast("boolean"))
        there = self.files().select(F.col("key").alias("_k"), F.col("path").alias("_p"), F.col("length").alias("_l"), F.lower("sha256").alias("_d"))
        same = F.coalesce((F.col("length") == F.col("_l")) & (F.col("sha256") == F.col("_d")), F.lit(False))
        return rows.join(there, (F.col("key") == F.col("_k")) & (F.col("path") == F.col("_p")), "left").withColumn("valid", same).drop("_k", "_p", "_l", "_d")

    def validate(self) -> DataFrame:
        """(key, code, path, detail) of all that is wrong, none if all is well."""
        parsed = read(self.manifests(), "key", "text")
        rows = entries(parsed, "key")
        deps = rows.select("key", "path", F.explode("dependencies").alias("d")).select("key", "path", F.coalesce("d.path", "d.entry", "d.name").alias("dep"), F.coalesce("d.id", "d.identity").alias("dep_id"))
        by_path = rows.select(F.col("key").alias("_k"), F.col("path").alias("_p"), F.col("id").alias("_own"))
        by_id = rows.select(F.col("key").alias("_j"), F.col("id").alias("_i"), F.col("path").alias("_q"))
        found = deps.join(by_path, (F.col("key") == F.col("_k")) & (F.col("dep") == F.col("_p")), "left").join(by_id, (F.col("key") == F.col("_j")) & (F.col("dep_id") == F.col("_i")), "left")
        code = F.when(F.col("_p").isNull() & F.col("_q").isNull(), "missing_dependency").when(F.col("_p").isNotNull() & (F.col("dep_id") != F.col("_own")), "ambiguous_dependency")
        wrong = found.select("key", code.alias("code"), "path", F.coalesce("dep", "dep_id").alias("detail")).where("code is not null")
        edges = found.select(F.concat_ws("\0", "key", "path").alias("a"), F.concat_ws("\0", "key", F.coalesce("_p", "_q")).alias("b")).where("b is not null")
        ring = cycles(edges, "a", "b").select(F.substring_index("node", "\0", 1).alias("key"), F.lit("dependency_cycle").alias("code"), F.substring_index("node", "\0", -1).alias("path"), F.lit(None).cast("string").alias("detail"))
        bad = self.inventory().where("not valid").select("key", F.lit("content").alias("code"), "path", F.lit(None).cast("string").alias("detail"))
        key = F.col("key").cast("string").alias("key")
        out = [violations(parsed, "key", "text"), entry_violations(rows, "key"), wrong, ring, bad]
        first, *rest = [x.select(key, "code", "path", "detail") for x in out]
        for x in rest:
            first = first.unionByName(x)
        return first


class TableProvider(Provider):
    """Bundles whose manifests and contents are tables: (key, text), and (key, path, content)."""

    def __init__(self, manifests: DataFrame, contents: DataFrame):
        self._manifests, self._contents = manifests, contents

    def manifests(self) -> DataFrame:
        return self._manifests

    def files(self) -> DataFrame:
        return self._contents.select("key", "path", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))

    def materialize(self, destination: str) -> None:
        """Write the contents that manifests name, once all is valid; an existing destination is refused, and it appears
        as a whole or not at all."""
        wrong = self.validate().limit(5).collect()
        if wrong:
            raise ValueError(f"not valid: {[(r['code'], r['path']) for r in wrong]}")
        spark = self._contents.sparkSession
        named = self.inventory(strict=False).select("key", "path")
        place = spark._jvm.org.apache.hadoop.fs.Path
        files = place(destination).getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(place(destination)):
            raise FileExistsError(destination)
        stage = f"{destination}.stage-{uuid.uuid4().hex}"
        self._contents.join(named, ["key", "path"], "left_semi").write.parquet(stage)
        if not files.rename(place(stage), place(destination)):
            raise FileExistsError(destination)


def cached(sidecars: DataFrame, there: DataFrame, source: str | None = None) -> DataFrame:
    """Entries that sidecars tell of, all or those of one source, with whether the entry itself is there."""
    rows = sidecars if source is None else sidecars.where(F.col("source") == source)
    return rows.join(there.select(F.col("entry").alias("_e")).distinct(), F.col("entry") == F.col("_e"), "left").withColumn("present", F.col("_e").isNotNull()).drop("_e")


@F.pandas_udf(StringType())
def bounded(values: pd.Series) -> pd.Series:
    """A JSON text cut down to what a record may hold: five levels, 24 items each, keys of 80 and texts of 240 characters;
    a text that is no JSON counts as a text."""

    def cut(x, left: int = 4):
        if left < 0:
            return "<truncated>"
        if isinstance(x, str):
            return x[:240]
        if isinstance(x, list):
            return [cut(y, left - 1) for y in x[:24]]
        if isinstance(x, dict):
            return {k[:80]: cut(y, left - 1) for k, y in list(x.items())[:24]}
        return x

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        return json.dumps(cut(value), separators=(",", ":"), ensure_ascii=False)

    return values.map(one)


def provider_violations(rows: DataFrame, key: str) -> DataFrame:
    """(key, code, path, detail) of entries (key, path, role, length, size, sha256) that another program reported: what it
    says of an entry must agree with itself."""
    good = path_is_safe(F.col("path")) & F.col("role").isin(*ROLES) & (F.col("length") >= 0) & (F.coalesce("size", "length") == F.col("length")) & digest_is_valid(F.col("sha256"))
    bad = rows.where(~F.coalesce(good, F.lit(False))).select(key, F.lit("provider_result").alias("code"), "path", F.col("length").cast("string").alias("detail"))
    again = rows.groupBy(key, "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bad.unionByName(again.select(key, F.lit("provider_result").alias("code"), "path", F.lit("repeated").alias("detail")))

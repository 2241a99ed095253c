"""Checks and digests of bundle manifests. Checks give rows (code, path, detail), none if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# The roles that an entry may have.
ROLES = ("graph", "weights", "config", "preprocess", "vocabulary", "calibration", "opaque")


def violation(rows: DataFrame, code: str, path: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.col(path).alias("path"), detail.cast("string").alias("detail"))


def duplicates(entries: DataFrame, column: str, code: str) -> DataFrame:
    d = entries.groupBy(column).count().where("count > 1")
    return violation(d, code, column, F.col("count"))


def unsupported_roles(entries: DataFrame, role: str, path: str, roles=ROLES) -> DataFrame:
    return violation(entries.where(~F.col(role).isin(*roles) | F.col(role).isNull()), "unsupported_role", path, F.col(role))


def path_conflicts(entries: DataFrame, path: str) -> DataFrame:
    """A file that another path uses as a directory. Every path gives its parents, which meet files by equality."""
    parts = F.split(path, "/")
    parents = entries.select(F.col(path).alias("below"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(i < F.size(parts), F.array_join(F.slice(parts, 1, i), "/")))).alias("parent")).where("parent is not null")
    hit = parents.join(entries.select(F.col(path).alias("file")).distinct(), F.col("parent") == F.col("file"))
    return violation(hit, "path_conflict", "file", F.col("below"))


def missing_dependencies(deps: DataFrame, entries: DataFrame, dep: str, key: str, path: str) -> DataFrame:
    return violation(deps.join(entries.select(F.col(key).alias("_k")), F.col(dep) == F.col("_k"), "left_anti"), "missing_dependency", path, F.col(dep))


def resolve_dependencies(deps: DataFrame, entries: DataFrame, dep_path: str, dep_id: str, path: str, ident: str) -> DataFrame:
    """The entry that each dependency names, by path, else by id. Two equi joins instead of one with OR."""
    by_path = entries.select(F.col(path).alias("_p"), F.col(ident).alias("id_by_path"))
    by_id = entries.select(F.col(ident).alias("_i"), F.col(path).alias("path_by_id"))
    rows = deps.join(by_path, F.col(dep_path) == F.col("_p"), "left").join(by_id, F.col(dep_id) == F.col("_i"), "left")
    return rows.withColumn("target", F.coalesce("_p", "path_by_id")).withColumn("ambiguous", F.col("_p").isNotNull() & F.col("path_by_id").isNotNull() & (F.col("_p") != F.col("path_by_id"))).drop("_p", "_i")


def invalid_ranges(deps: DataFrame, entries: DataFrame, dep: str, key: str, size: str, offset: str, length: str, path: str) -> DataFrame:
    e = entries.select(F.col(key).alias("_k"), F.col(size).alias("_size"))
    rows = deps.join(e, F.col(dep) == F.col("_k")).where((F.col(offset) < 0) | (F.col(length) < 0) | (F.col(offset) + F.col(length) > F.col("_size")))
    return violation(rows, "invalid_range", path, F.concat_ws("+", offset, length))


def cycles(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node): nodes that reach themselves, on cycles of any length.

    Nodes that nothing reaches or that reach nothing go, again and again. Then each node takes the largest node that
    reaches it; what leads back to such a node among those that took it is on a cycle with it. These go too, until no
    edge is left. Every step is a join with a row for each node at most, and nothing but counts comes to the driver.
    """
    rows = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    rows = cut(rows, "edges")
    found = [rows.where("a = b").select(F.col("a").alias("node"))]
    rows = rows.where("a <> b")
    while True:
        rows, n = _trimmed(rows)
        if not n:
            break
        took = _settled(rows.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("top")), rows)
        same = rows.join(took.select(F.col("node").alias("a"), F.col("top").alias("ta")), "a").join(took.select(F.col("node").alias("b"), F.col("top").alias("tb")), "b")
        same = cut(same.where("ta = tb").select("a", "b", F.col("ta").alias("top")), "edges")
        back = took.where("node = top").select("node")
        size = -1
        while (now := back.count()) != size:
            size = now
            back = cut(back.unionByName(same.join(back.withColumnRenamed("node", "b"), "b", "left_semi").select(F.col("a").alias("node"))).distinct(), "cycle-nodes")
        # A top alone among those that lead back to it is on no cycle.
        tops = back.join(took, "node").groupBy("top").agg(F.count(F.lit(1)).alias("n"))
        found.append(back.join(took, "node").join(tops.where("n > 1"), "top", "left_semi").select("node"))
        rows = cut(rows.join(back.withColumnRenamed("node", "a"), "a", "left_anti").join(back.withColumnRenamed("node", "b"), "b", "left_anti"), "edges")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges between nodes that are both reached and reaching, and how many there are."""
    n, size = edges.count(), -1
    while n and n != size:
        edges = cut(edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi"), "edges")
        n, size = edges.count(), n
    return edges, n


def _settled(took: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, top): the largest top that edges carry to each node."""
    while True:
        come = edges.join(took.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("top").alias("come"))
        new = cut(took.join(come, "node", "left").select("node", F.greatest("top", "come").alias("top"), (F.col("come") > F.col("top")).alias("moved")), "cycle-tops")
        took = new.select("node", "top")
        if new.where("moved").isEmpty():
            return took


def schema_version(text: Column) -> tuple[Column, Column]:
    """(major, minor) of "M" or "M.m"; NULL if it is neither."""
    ok = text.rlike(r"^\d+(\.\d+)?$")
    major = F.when(ok, F.regexp_extract(text, r"^(\d+)", 1).cast("int"))
    return major, F.when(ok, F.coalesce(F.nullif(F.regexp_extract(text, r"\.(\d+)$", 1), F.lit("")), F.lit("0")).cast("int"))


def mismatches(declared: DataFrame, found: DataFrame, path: str, length: str, digest: str) -> DataFrame:
    """Entries whose length or digest is not as declared, and files that are missing."""
    f = found.select(F.col(path).alias("_p"), F.col(length).alias("_l"), F.col(digest).alias("_d"))
    rows = declared.join(f, F.col(path) == F.col("_p"), "left")
    code = F.when(F.col("_p").isNull(), "missing_entry").when(F.col(length) != F.col("_l"), "length_mismatch").when(F.lower(digest) != F.lower("_d"), "digest_mismatch")
    return rows.select(code.alias("code"), F.col(path).alias("path"), F.concat_ws(" ", F.col(length).cast("string"), F.col("_l").cast("string")).alias("detail")).where("code is not null")


def over_ceiling(entries: DataFrame, path: str, size: str, entry_limit: int, total_limit: int, count_limit: int) -> DataFrame:
    one = violation(entries.where(F.col(size) > entry_limit), "resource_limit", path, F.col(size))
    total = entries.agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n"))
    return one.unionByName(violation(total.where(F.col("s") > total_limit).withColumn("p", F.lit("*bytes")), "resource_limit", "p", F.col("s"))).unionByName(violation(total.where(F.col("n") > count_limit).withColumn("p", F.lit("*entries")), "resource_limit", "p", F.col("n")))


def entry_id(path: Column) -> Column:
    return F.concat(F.lit("entry-"), F.substring(F.sha2(path.cast("binary"), 256), 1, 32))


def bundle_digest(entries: DataFrame, by: list[str], path: str, size: str, sha: str) -> DataFrame:
    """SHA-256 over entries in path order: path, a zero byte, the length as 8 bytes, the digest. One manifest is one group."""
    rows = entries.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(path).alias("p"), F.col(size).alias("n"), F.col(sha).alias("s")))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: F.concat(F.hex(x["p"].cast("binary")), F.lit("00"), F.lpad(F.hex(x["n"]), 16, "0"), x["s"])), "")
    return rows.select(*by, F.sha2(F.unhex(joined), 256).alias("digest"))


def inventory_difference(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys on one side only, or with a field that differs (NULL equals NULL)."""
    r = right.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = left.select(key, *fields).join(r, F.col(key) == F.col("_k"), "full_outer")
    diff = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields])), ",")
    side = F.when(F.col("_k").isNull(), "left").when(F.col(key).isNull(), "right").when(diff != "", diff)
    return rows.select(F.coalesce(key, "_k").alias(key), side.alias("difference")).where("difference is not null")


def agreement(rows: DataFrame, by: list[str], digest: Column) -> DataFrame:
    """Per group: how many different digests, how many rows, and whether all agree. Two levels, so equal ones fold first."""
    each = rows.groupBy(*by, digest.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("forms"), F.sum("_n").alias("n")).withColumn("agree", F.col("forms") == 1)

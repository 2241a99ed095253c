"""Approximate nearest neighbours: multiprobe p-stable hashing, and exact distances for the candidates.

Each of ``tables`` hash tables cuts ``dims`` Gaussian projections of the direction of a vector into bins of ``width``.
A query visits the buckets of a table in the order of the estimated chance that a neighbour at distance ``radius`` lies
there (the product over projections of the normal mass of each bin), until these chances sum to ``success``; so the
share of buckets follows from the target, not from a cap. Candidates of all tables merge, and cosines on the original
vectors, in double precision, rank them.

Equal vectors go through the tables once: of each such group only the ``k + 1`` smallest ids can be among a query's k
nearest, and the limit is applied before rows move. Buckets are grouped by their first projections; a group with
more vectors than CHUNK is dealt over chunks, and a query visits each; queries are dealt over portions of CHUNK too, so a task
holds CHUNK vectors and CHUNK queries or so, whatever the number of either. A query with fewer than k found is compared
with all vectors, in the same chunks.

Defined cases: vectors that are null, empty, zero, or with a null or non-finite part take no part, nor do vectors of
another length than the first one in id order; ties go to the smaller id; a repeated id counts with its vectors as
given and is never its own neighbour; fewer than k other vectors give them all. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, lean, need, table

TABLES, DIMS, WIDTH, BINS, RADIUS, SUCCESS, SEED = 4, 6, 1.1, 5, 1.0, 0.8, 7
#: Projections whose bins name a group of buckets, and vectors of a chunk.
LEAD, CHUNK = 2, 20_000


class Tables:
    """Projections and offsets, from a seed; the outer bins are open to the sides."""

    def __init__(self, size: int, tables: int = TABLES, dims: int = DIMS, width: float = WIDTH, bins: int = BINS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dims, size))
        self.b = rng.uniform(0, width, (tables, dims)) if bins % 2 == 0 else rng.uniform(-width / 4, width / 4, (tables, dims))
        self.width, self.bins, self.tables, self.dims = width, bins, tables, dims
        self.edges = (np.arange(1, bins) - bins / 2) * width
        self.combos = np.stack(np.meshgrid(*[np.arange(bins)] * dims, indexing="ij"), -1).reshape(-1, dims)

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Projections of unit vectors: [row, table, dim]."""
        return np.einsum("rs,tds->rtd", unit, self.a) + self.b

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Bucket numbers: [row, table]."""
        h = np.searchsorted(self.edges, self.places(unit))
        return (h * self.bins ** np.arange(self.dims - 1, -1, -1)).sum(-1)

    def probes(self, unit: np.ndarray, radius: float, success: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, table, bucket numbers in order of estimated success)."""
        at = self.places(unit)
        cdf = np.vectorize(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))))
        upper = cdf((self.edges - at[..., None]) / radius)
        mass = np.diff(np.concatenate([np.zeros((*upper.shape[:-1], 1)), upper, np.ones((*upper.shape[:-1], 1))], -1), axis=-1)
        for r in range(len(unit)):
            for t in range(self.tables):
                p = np.ones(1)
                for d in range(self.dims):
                    p = np.multiply.outer(p, mass[r, t, d]).ravel()
                order = np.argsort(-p, kind="stable")
                yield r, t, order[: int(np.searchsorted(np.cumsum(p[order]), success)) + 1]


def _clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    return rows


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(score) > 4 * k:  # ties with the k-th stay
        keep_ = np.flatnonzero(score >= np.partition(score, -k)[-k] - 1e-9)
    else:
        keep_ = np.arange(len(score))
    return keep_[np.lexsort((ids[keep_], -score[keep_]))][:k]


def _cosine(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact cosines of rows with q; each row's sum runs in the same order wherever it stands."""
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * math.sqrt(float((q * q).sum())))


def search(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", radius: float = RADIUS, success: float = SUCCESS, **shape) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` selects, its k nearest among the others."""
    need(df, key, vector)
    spark = df.sparkSession
    rows = _clean(df, key, vector)
    head = rows.select(F.min_by(F.size("v"), "id")).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if head is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == head)
    # Of equal vectors the k + 1 smallest ids; the limit works before the shuffle too.
    rn = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = keep(rows.withColumn("n", rn).where(F.col("n") <= k + 1), "nearest-members")
    reps = members.where("n = 1").select("id", "v")
    asked = rows.where(is_query(F.col("id"))).select("id", "v").distinct()
    asked = keep(asked, "nearest-queries")
    queries = keep(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "nearest-distinct")
    sub = Tables(head, **shape)
    low = sub.bins ** (sub.dims - LEAD)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lsh = Tables(head, **shape)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                x = np.array(part.column(1).flatten()).reshape(-1, head)
                c = lsh.codes(x / np.linalg.norm(x, axis=1, keepdims=True))
                for t in range(lsh.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(c[:, t] // low, pa.int32()), pa.array(c[:, t], pa.int32()), part.column(0), part.column(1)], ["t", "g", "code", "id", "v"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lsh = Tables(head, **shape)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                x = np.array(part.column(1).flatten()).reshape(-1, head)
                out: dict[str, list] = {"t": [], "g": [], "codes": [], "q": [], "v": []}
                vs, qs = part.column(1).to_pylist(), part.column(0).to_pylist()
                for r, t, codes in lsh.probes(x / np.linalg.norm(x, axis=1, keepdims=True), radius, success):
                    codes = np.sort(codes)
                    for g, own in zip(*_split(codes, low), strict=True):
                        for name, value in (("t", t), ("g", int(g)), ("codes", own.tolist()), ("q", qs[r]), ("v", vs[r])):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("t", pa.int32()), ("g", pa.int32()), ("codes", pa.list_(pa.int32())), ("q", pa.int64()), ("v", pa.list_(pa.float64()))]))

    index = reps.mapInArrow(lean(hashed), "t int, g int, code int, id long, v array<double>")
    # A row for each table and group of buckets: tables * bins ** LEAD at most.
    sizes = index.groupBy("t", "g").count().select("t", "g", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    sizes = keep(sizes, "nearest-sizes")
    portions = max(1, math.ceil(queries.count() / CHUNK))
    index = index.join(F.broadcast(sizes), ["t", "g"]).select("t", "g", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "code", "id", "v")
    index = index.withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))
    probes = queries.select("q", "v").mapInArrow(lean(probed), "t int, g int, codes array<int>, q long, v array<double>")
    there = sizes.select(F.col("t").alias("p_t"), F.col("g").alias("p_g"), F.col("chunks").alias("p_chunks"))
    probes = probes.join(F.broadcast(there), (F.col("t") == F.col("p_t")) & (F.col("g") == F.col("p_g")))
    probes = probes.select("t", "g", F.explode(F.sequence(F.lit(0), F.col("p_chunks") - 1)).alias("chunk"), "codes", "q", "v")
    probes = probes.withColumn("portion", F.pmod(F.xxhash64("q"), F.lit(portions)).cast("int"))

    def visit(key_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            x = np.array(left["v"].combine_chunks().flatten()).reshape(-1, head)
            ids, code = left["id"].to_numpy(), left["code"].to_numpy()
            seen = np.zeros(sub.bins**sub.dims + 1, bool)
            for q, codes, v in zip(right["q"].to_pylist(), right["codes"].to_pylist(), right["v"].to_pylist(), strict=True):
                seen[codes] = True
                at = np.flatnonzero(seen[code])
                seen[codes] = False
                if len(at):
                    s = _cosine(x[at], np.array(v))
                    best = _top(s, ids[at], k + 1)
                    out["q"] += [q] * len(best)
                    out["id"] += ids[at][best].tolist()
                    out["score"] += s[best].tolist()
        return pa.table({"q": pa.array(out["q"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    by = ["t", "g", "chunk", "portion"]
    found = index.groupBy(*by).cogroup(probes.groupBy(*by)).applyInArrow(visit, "q long, id long, score double")
    found = keep(found.groupBy("q", "id").agg(F.max("score").alias("score")), "nearest-found")
    few = queries.join(found.groupBy("q").count().where(F.col("count") > k), "q", "left_anti")
    if not few.isEmpty():
        found = found.unionByName(_all(reps, few, head, k)).groupBy("q", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", "id", "score")
    same = members.select("v", "id").join(members.where("n = 1").select("v", F.col("id").alias("rep")), "v").select("rep", F.col("id").alias("vec_id"))
    pairs = found.join(same, found["id"] == same["rep"]).select("q", "vec_id", "score")
    each = asked.select(F.col("id").alias("query_id"), "v").join(queries.select("q", "v"), "v").select("query_id", "q")
    out = each.join(pairs, "q").where(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _split(codes: np.ndarray, low: int) -> tuple[np.ndarray, list[np.ndarray]]:
    g, first = np.unique(codes // low, return_index=True)
    return g, np.split(codes, first[1:])


def _all(reps: DataFrame, queries: DataFrame, head: int, k: int) -> DataFrame:
    """The k + 1 best of all vectors for the given queries, chunk by chunk."""
    n = max(1, math.ceil(reps.count() / CHUNK))
    portions = max(1, math.ceil(queries.count() / CHUNK))
    chunked = reps.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n))).withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(portions - 1).cast("long"))))
    asked = queries.select("q", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("chunk"), F.pmod(F.xxhash64("q"), F.lit(portions)).alias("portion"))

    def visit(key_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "id": [], "score": []}
        if left.num_rows:
            x = np.array(left["v"].combine_chunks().flatten()).reshape(-1, head)
            ids = left["id"].to_numpy()
            for q, v in zip(right["q"].to_pylist(), right["v"].to_pylist(), strict=True):
                s = _cosine(x, np.array(v))
                best = _top(s, ids, k + 1)
                out["q"] += [q] * len(best)
                out["id"] += ids[best].tolist()
                out["score"] += s[best].tolist()
        return pa.table({"q": pa.array(out["q"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return chunked.groupBy("chunk", "portion").cogroup(asked.groupBy("chunk", "portion")).applyInArrow(visit, "q long, id long, score double")


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)

"""N-gram Jaccard join by vertical partitioning, and the groups that its links make.

Shingles are put in one global order, rare ones first (by a frequency class from a fixed-size count table, then by
hash). Any order gives the same links; this one keeps frequent shingles out of prefixes. The order is cut into
fragments of about equal weight. Two documents whose similarity reaches the threshold must share a shingle among the
first ``n - ceil(t n) + 1`` of each, so these make the candidates. A shingle of a prefix that no other document has in
its prefix stands in no overlap with a document that it could link with, so ``n`` less the number of such shingles
bounds each overlap: pairs whose smaller bound is below the overlap that their sizes need are not made at all. Sizes and
the number of shared prefix shingles prune the rest. For candidate pairs the overlap is counted separately in each
fragment and summed per pair, exactly.

Documents with equal shingle sets are one class, and only its smallest id goes on. Not all pairs of a group are made:
first each candidate is compared with the document of the largest bound that shares a shingle of its prefix (a star),
then components are made, and only pairs of different components that share a prefix shingle are compared, least
component against the rest. Pairs within a component cannot change it, so the groups are exact, whatever the size of a
group.

Defined cases: null and empty texts, and texts without words, have no shingle and link with nothing, not even each
other; texts with fewer words than n have their whole sequence as the one shingle; repeated rows with the same id are
one document if their texts are equal, and the larger set stands for the id if not; null ids have a row each with a
null component; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, drop_kept, few, keep, lean, need, slices, spare, table
from .components import components
from .repeats import _has as in_bitmap
from .repeats import bitmap

N, THRESHOLD, FRAGMENTS = 4, Fraction(85, 100), 4
#: The count table: 2 ** SLOT_BITS counters, summed in pieces of 2 ** PIECE_BITS.
SLOT_BITS, PIECE_BITS = 22, 16
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of words whose hashes a task remembers.
KNOWN_BYTES = 24 << 20
#: Bits of the bitmaps of ids and of shingles that pass before rows move; both of fixed size. Beyond MOST_KEYS keys they
#: would let most rows pass, and a semi join by shuffle does it.
ID_BITS, TOKEN_BITS, MOST_KEYS = 24, 26, 1 << 24
#: Documents, and bytes of text, that a task holds at a time.
ROWS, BYTES = 1000, 4 << 20
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class Hasher:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, n: int = N):
        import xxhash

        self.n = n
        self.known = Remembered(KNOWN_BYTES, xxhash.xxh3_64_intdigest)

    def shingles(self, text: str | None) -> np.ndarray:
        words = WORDS.findall((text or "").encode("utf-8", "replace").translate(UPPER))
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(self.known.of(words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(h) - n + 1, np.uint64(len(words) if len(words) < self.n else self.n))
        for j in range(n):
            out = (out ^ h[j : len(h) - n + 1 + j]) * _ODD[j % len(_ODD)]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def in_order(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hashes in the global order: by frequency class, then by their low bits (the high ones chose the class)."""
    return h[np.lexsort((h * _ODD[0], classes[_slots(h)]))]


class Fragments:
    """Equal shares of the global order by weight, a class c counting 2 ** c for each slot."""

    def __init__(self, classes: np.ndarray, fragments: int):
        self.classes, self.fragments = classes, fragments
        weight = np.bincount(classes, minlength=64).astype(float) * 2.0 ** np.arange(64)
        self.share = weight / weight.sum()
        self.before = np.cumsum(self.share) - self.share

    def of(self, h: np.ndarray) -> np.ndarray:
        """The fragment of each hash."""
        c = self.classes[_slots(h)]
        place = self.before[c] + self.share[c] * ((h * _ODD[0]) >> np.uint64(11)).astype(float) * 2.0**-53
        return np.minimum((place * self.fragments).astype(np.int64), self.fragments - 1)


def document_sets(docs: DataFrame, key: str, text: str, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, set_id) of each row, and the pieces of the count table, from one pass over the texts."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher, counts = Hasher(n), np.zeros(1 << SLOT_BITS, np.uint32)
        kinds = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])
        for b in batches:
            sizes, s1, s2 = [], [], []
            for t in b.column(1):  # a text at a time
                h = hasher.shingles(t.as_py())
                np.add.at(counts, _slots(h), np.uint32(1))
                sizes.append(len(h))
                d = xxhash.xxh3_128_intdigest(h.tobytes())
                s1.append((d >> 64) - (1 << 63))
                s2.append((d & ((1 << 64) - 1)) - (1 << 63))
            none = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=kinds)
        step = 1 << PIECE_BITS
        for i in range(0, len(counts), step):
            part = counts[i : i + step]
            if part.any():
                yield pa.RecordBatch.from_pydict({"id": [None], "n": [None], "s1": [None], "s2": [None], "piece": [i // step], "counts": [zlib.compress(np.minimum(part, 255).astype(np.uint8).tobytes(), 1)]}, kinds)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    both = keep(rows.mapInArrow(lean(run), "id long, n long, s1 long, s2 long, piece int, counts binary"), "shingle-sets")
    return both.where("piece is null").select("id", F.col("n").alias("n_shingles"), "s1", "s2"), both.where("piece is not null").select("piece", "counts")


def frequency_classes(pieces: DataFrame) -> np.ndarray:
    """Class of each slot, by the power of two of its count; 2 ** SLOT_BITS bytes whatever the corpus."""
    import zlib

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PIECE_BITS, np.int64)
        for part in parts:
            for x in part.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([key[0].as_py()], pa.int32()), "classes": pa.array([np.where(total > 0, np.log2(np.maximum(total, 1)) + 1, 0).astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in pieces.groupBy("piece").applyInArrow(add, "piece int, classes binary").toLocalIterator():
        at = r["piece"] << PIECE_BITS
        out[at : at + (1 << PIECE_BITS)] = np.frombuffer(r["classes"], np.uint8)
    return out


def least_overlap(a, b, t: Fraction = THRESHOLD):
    """Shared shingles that sets of these sizes need: ceil(t / (1 + t) * (a + b)), in whole numbers."""
    return F.ceil((a + b) * t.numerator / F.lit(float(t.numerator + t.denominator)) - 1e-9)


def _sieve(rows: DataFrame, keys: DataFrame, bits: int) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """Rows, and a function over their batches that leaves those whose first column may be among the keys, by a bitmap of
    fixed size; so others go before they are worked on or moved."""
    first, name = rows.columns[0], keys.columns[0]
    keys = keys.distinct()
    if keys.count() > MOST_KEYS:
        return rows.join(keys.select(F.col(name).alias("_key")), F.col(first) == F.col("_key"), "left_semi"), lambda b: b
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(keys, bits))
    return rows, lambda b: b.filter(pa.array(in_bitmap(sent.value, b.column(0).to_numpy().view(np.uint64))))


def _wanted_texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """_sieve() of rows (h, id, t) of documents that may be among the ids, without a shuffle of texts."""
    rows = docs.where(F.col(key).isNotNull()).select(F.xxhash64(F.col(key).cast("long")).alias("h"), F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return _sieve(rows, ids.select(F.xxhash64("id").alias("h")), ID_BITS)


def prefix_bound(a, b, t: Fraction):
    """Shingles that prefixes of two sets of these sizes share at least, if the sets reach the threshold."""
    return least_overlap(a, b, t) - F.ceil(F.greatest(a, b) * t.numerator / F.lit(float(t.denominator)) - 1e-9) + 1


def jaccard_links(docs: DataFrame, reps: DataFrame, classes: np.ndarray, key: str, text: str, n: int = N, t: Fraction = THRESHOLD, repeated: bool = True) -> DataFrame:
    """Components (node, root) over representatives, from verified links only. repeated: whether ids may repeat."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)  # 2 ** SLOT_BITS bytes
    num, den = t.numerator, t.denominator
    rows, wanted = _wanted_texts(docs, reps, key, text)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(n)
        for b in map(wanted, batches):
            for lo, many in slices(b.column(2), ROWS, BYTES):
                part = b.slice(lo, many)
                ids, sizes, token = [], [], []
                for i, x in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    h = in_order(hasher.shingles(x.as_py()), sent.value)
                    p = h[: len(h) - -(-len(h) * num // den) + 1] if len(h) else h
                    ids.append(np.full(len(p), i, np.int64))
                    sizes.append(np.full(len(p), len(h), np.int32))
                    token.append(p.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, ids, sizes)], ["token", "id", "n"])

    tokens = keep(rows.mapInArrow(lean(prefixes), "token long, id long, n int"), "prefixes")
    # A shingle that only one representative has in its prefix makes no pair: most rows go before they are moved.
    heads = keep(tokens.groupBy("token").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("token"), "prefix-tokens")
    rows, may = _sieve(tokens, heads, TOKEN_BITS)
    many = rows.mapInArrow(lean(lambda batches: map(may, batches)), "token long, id long, n int").join(heads, "token", "left_semi")
    many = few(keep(many.groupBy("token", "id").agg(F.max("n").alias("n")), "prefix-many"))  # repeated rows count once
    # m bounds the overlap of a document with any that it could link with.
    alone = F.greatest(F.col("n") - F.ceil(F.col("n") * num / F.lit(float(den)) - 1e-9) + 1 - F.count(F.lit(1)), F.lit(0))
    own = many.groupBy("id", "n").agg((F.col("n") - alone).cast("int").alias("m"))
    shared = few(keep(many.join(own.groupBy("id").agg(F.max("m").alias("m")), "id"), "prefix-shared"))
    drop_kept(tokens, heads, many)
    fits = lambda a, b, ma, mb: (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num) & (F.least(ma, mb) >= least_overlap(F.col(a), F.col(b), t))
    # Star: each document against the hub that it shares most shingles with. What this misses, the second round finds.
    hubs = shared.groupBy("token").agg(F.max_by(F.struct(F.col("id").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma")), F.struct(F.col("m") / F.col("n"), -F.col("id"))).alias("hub")).select("token", "hub.*")
    stars = shared.join(hubs, "token").where((F.col("id") != F.col("a")) & fits("na", "n", "ma", "m"))
    stars = stars.groupBy("a", F.col("id").alias("b"), "na", F.col("n").alias("nb")).agg(F.count(F.lit(1)).alias("k"))
    stars = stars.where(2 * F.col("k") >= prefix_bound(F.col("na"), F.col("nb"), t))
    stars = stars.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a"))
    links = verify(docs, stars.select("a", "b"), classes, key, text, n, t, repeated=repeated)
    found = components(links)
    # Second round: only shingles whose holders are in different components can be common to a pair that is left. The
    # component with most holders stays out of one side, so a large group meets only the few others. Among these
    # shingles, put in order by their holders, a pair that has ``least`` in common has one of them in common within the
    # first ``s - least + 1`` of each document; it is made there, not at every shingle that it shares.
    held = shared.join(found.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", F.coalesce("root", "id").alias("root"))
    mixed = held.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("holders")).where("low <> high")
    held = few(keep(held.join(mixed.select("token", "holders"), "token"), "prefix-mixed"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("holders", "token"))
    own = held.groupBy("id").agg(F.count(F.lit(1)).alias("s"))
    alone = F.greatest(F.col("n") - F.ceil(F.col("n") * num / F.lit(float(den)) - 1e-9) + 1 - F.col("s"), F.lit(0))
    ranked = few(keep(held.withColumn("r", rank).join(own, "id").withColumn("m", F.col("n") - alone), "prefix-ranked"))
    per_root = held.groupBy("token", "root").agg(F.count(F.lit(1)).alias("many"))
    main = per_root.groupBy("token").agg(F.max_by("root", F.struct("many", "root")).alias("main"))
    side = lambda x, rows: rows.select("token", *[F.col(c).alias(c + x) for c in ("id", "n", "m", "r", "s", "root")])
    left = side("a", ranked).join(main, "token").where("roota <> main")
    once = (F.col("rootb") == F.col("main")) | (F.col("ida") < F.col("idb"))
    least = F.greatest(prefix_bound(F.col("na"), F.col("nb"), t), F.lit(1))
    early = (F.col("ra") <= F.col("sa") - least + 1) & (F.col("rb") <= F.col("sb") - least + 1)
    pairs = left.join(side("b", ranked), "token").where((F.col("roota") != F.col("rootb")) & once & fits("na", "nb", "ma", "mb") & early)
    pairs = pairs.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()
    lists = held.groupBy("id").agg(F.max("n").alias("n"), F.collect_list("token").alias("tokens"))  # a document's own prefix
    both = pairs.join(lists.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a").join(lists.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
    pairs = both.where(F.size(F.array_intersect("ta", "tb")) >= prefix_bound(F.col("na"), F.col("nb"), t)).select("a", "b")
    more = verify(docs, pairs, classes, key, text, n, t, repeated=repeated)
    out = components(links.select("a", "b").unionByName(more.select("a", "b"))) if not more.isEmpty() else found
    drop_kept(shared, held, ranked, links, more)
    return out


def verify(docs: DataFrame, pairs: DataFrame, classes: np.ndarray, key: str, text: str, n: int, t: Fraction, fragments: int = FRAGMENTS, repeated: bool = True) -> DataFrame:
    """Pairs whose overlap, counted in each fragment of the global order and summed, reaches the threshold."""
    pairs = few(keep(pairs, "jaccard-pairs"))
    rows, wanted = _wanted_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), key, text)
    sent = docs.sparkSession.sparkContext.broadcast(classes)  # 2 ** SLOT_BITS bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, order = Hasher(n), Fragments(sent.value, fragments)
        for b in map(wanted, batches):
            for lo, many in slices(b.column(2), ROWS, BYTES):
                part = b.slice(lo, many)
                out: dict[str, list] = {"id": [], "frag": [], "n": [], "seg": []}
                for i, x in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    h = hasher.shingles(x.as_py())
                    frag = order.of(h)
                    for f in range(fragments):
                        out["id"].append(i)
                        out["frag"].append(f)
                        out["n"].append(len(h))
                        out["seg"].append(h[frag == f].view(np.int64))
                yield pa.RecordBatch.from_pydict(out, pa.schema([("id", pa.int64()), ("frag", pa.int32()), ("n", pa.int32()), ("seg", pa.list_(pa.int64()))]))

    segments = rows.mapInArrow(lean(cut), "id long, frag int, n int, seg array<long>")
    segments = few(keep(segments, "jaccard-segments"))
    one = segments
    if repeated:  # of repeated ids the largest set stands
        one = segments.groupBy("id", "frag").agg(F.max(F.struct("n", "seg")).alias("s")).select("id", "frag", "s.n", "s.seg")
    sa = one.select(F.col("id").alias("a"), "frag", F.col("n").alias("na"), F.col("seg").alias("seg_a"))
    sb = one.select(F.col("id").alias("b"), "frag", F.col("n").alias("nb"), F.col("seg").alias("seg_b"))
    part = pairs.join(sa, "a").join(sb, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("seg_a", "seg_b")).alias("shared"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    union = F.col("na") + F.col("nb") - F.col("shared")
    out = few(keep(total.where(F.col("shared") * t.denominator >= union * t.numerator), "jaccard-links"))
    drop_kept(pairs, segments)
    return out


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, t: Fraction = THRESHOLD) -> DataFrame:
    """(key, n_shingles, component_id) for every document."""
    need(docs, key, text)
    sets, pieces = document_sets(docs, key, text, n)
    classes = frequency_classes(pieces)
    nameless = sets.where("id is null").select(F.col("id").alias(key), "n_shingles", F.col("id").alias("component_id"))
    sets = sets.where("id is not null").groupBy("id").agg(F.max(F.struct("n_shingles", "s1", "s2")).alias("s"), F.count(F.lit(1)).alias("times")).select("id", "times", "s.*")
    full = sets.where("n_shingles > 0")
    reps = keep(full.groupBy("n_shingles", "s1", "s2").agg(F.min("id").alias("id")), "jaccard-reps")
    found = jaccard_links(docs, reps.select("id", "n_shingles"), classes, key, text, n, t, not sets.where("times > 1").isEmpty())
    roots = reps.join(found.withColumnRenamed("node", "id"), "id", "left").select("n_shingles", "s1", "s2", F.coalesce("root", "id").alias("r"))
    out = sets.drop("times").join(roots, ["n_shingles", "s1", "s2"], "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("r", "id").alias("component_id")).unionByName(nameless)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, t: Fraction = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; null ids stay. Rows that share an id go only
    if they are equal or near copies: the longer text stands first, then by text and the other columns."""
    need(docs, key, text)
    named, nameless = docs.where(F.col(key).isNotNull()), docs.where(F.col(key).isNull())
    if named.groupBy(key).count().where("count > 1").isEmpty():
        return _without_copies(named, key, text, n, t).unionByName(nameless)
    row = spare(docs, "row")
    others = [F.to_json(F.struct(*rest))] if (rest := [c for c in docs.columns if c not in (key, text)]) else []
    # Ids of rows in the order of the documents' ids; written, so that each use sees the same.
    rows = keep(named.orderBy(key, F.length(text).desc(), text, *others).withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")
    once = rows.groupBy(key, text).agg(F.min(row).alias(row)).select(row)  # texts without shingles are no near copies
    return _without_copies(rows.join(once, row, "left_semi"), row, text, n, t).select(*docs.columns).unionByName(nameless)


def _without_copies(docs: DataFrame, key: str, text: str, n: int, t: Fraction) -> DataFrame:
    groups = near_groups(docs, key, text, n, t)
    name = spare(docs, "gone")
    gone = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(name))
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))

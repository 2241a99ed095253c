"""Repeated substrings over a corpus by prefix-free parsing: every byte in a string of LENGTH bytes that starts twice.

Parse. The trigger of each window of LENGTH bytes is the place in it whose rolling hash over SEED bytes is least, so
equal windows have their trigger at the same offset wherever they are. Consecutive windows with one trigger make a
phrase: the bytes that these windows cover. The parse of a document is its phrases in order, about one for each
hundred bytes, and the dictionary has each different phrase once, with its number of uses.

Dictionary. What repeats is told by the order of the dictionary's suffixes of LENGTH bytes or more: those that have LENGTH
bytes in common with a neighbour, and all of a phrase that is used twice. Most suffixes need no place in the order. One
can only have such a neighbour in a phrase that shares its core to the left or to the right of the trigger; cores that
several phrases share go into a bitmap of fixed size. Suffixes of phrases with such a core are taken in blocks of
neighbouring starts; equal blocks are repeated as a whole, and only blocks that share what all their suffixes have in
common with another, unlike block are opened. Their suffixes are sorted: by the name of the block's common string, the
offset from it, and then byte by byte by the bytes around it, so that suffixes with LENGTH bytes in common are next to
each other. The order is made by range, so a name with many suffixes is dealt over tasks, and neighbours are compared
in one pass over each range.

Combine. Each suffix in a run of the order, and each use of a repeated phrase or block in the parse, gives a span.

Counts come from sums with partial sums, each task gives a phrase's suffixes once, and spans meet their own document
only, so no repeated passage gathers in a task. Long texts are parsed in parts that overlap by a window; a phrase cut
there is like one at the end of a text. Phrases and blocks are compared by two 64-bit hashes, of all their bytes and of
their cores, and the bytes around a name as they are.

Defined cases: a null text is empty: 0 bytes, nothing removed; texts below LENGTH bytes lose nothing; repeated rows are
documents like others, so a repeated row of LENGTH bytes or more loses all; null ids are kept; an empty table gives no
rows; other columns are not read (spans) or kept (dedup).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep, lean, need, slices, spare, table

LENGTH, SEED = 200, 16
#: Offsets from the trigger that make a block of windows.
BLOCK = 16
#: Bits of the bitmap of shared cores and of documents with spans; both are of fixed size.
CORE_BITS, DOC_BITS = 26, 24
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
#: Windows of a text that are parsed at a time, and bits for a place among them.
PART, POSITION_BITS = 1 << 18, 19
#: Rows, and bytes of text, that a task holds at a time; phrases that it remembers to have given.
ROWS, BYTES, GIVEN = 256, 2 << 20, 200_000


class Powers:
    """Powers of the base and of its inverse, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, x in (("up", _BASE), ("down", _BACK)):
                step = np.full(n, np.uint64(x))
                step[0] = 1
                setattr(self, name, np.multiply.accumulate(step))
        return self.up, self.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Text:
    """Hashes of all substrings of a text, and its parse."""

    def __init__(self, raw: bytes, powers: Powers, length: int = LENGTH):
        self.n, self.length = len(raw), length
        if self.n < length:
            self.start = self.stop = self.trigger = np.zeros(0, np.int64)
            return
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * up[: self.n], out=self.sums[1:])
        seeds = self.hash(np.arange(self.n - SEED + 1), SEED)
        order = (seeds >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS) | np.arange(len(seeds), dtype=np.uint64)
        wide = length - SEED + 1
        blocks = -(-len(order) // wide)
        padded = np.full(blocks * wide, np.uint64(2**64 - 1))
        padded[: len(order)] = order
        grid = padded.reshape(blocks, wide)
        left = np.minimum.accumulate(grid, 1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        windows = self.n - length + 1
        least = np.minimum(right[:windows], left[wide - 1 : wide - 1 + windows])
        trigger = (least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        cut = np.flatnonzero(trigger[1:] != trigger[:-1]) + 1
        self.start = np.append(0, cut)  # first and last window of each phrase
        self.stop = np.append(cut - 1, windows - 1)
        self.trigger = trigger[self.start]

    def hash(self, at: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[at + length] - self.sums[at]) * self.down[at])

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each phrase, and of its left and right core (0: no window reaches that far)."""
        half = (self.length - SEED) // 2
        n = self.stop - self.start
        whole = self.hash(self.start, n + self.length) ^ (n.astype(np.uint64) * np.uint64(_BASE))
        left, right = np.zeros_like(whole), np.zeros_like(whole)
        far = self.trigger - self.start >= half
        left[far] = self.hash(self.trigger[far] - half, half + SEED) | np.uint64(1)
        near = self.trigger - self.stop < half
        right[near] = (self.hash(self.trigger[near], self.length - half + 1) | np.uint64(1)) ^ np.uint64(2)
        return whole, left, right


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _raw(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "replace")


def _parts(raw: bytes, powers: Powers) -> Iterator[tuple[int, Text]]:
    """The parse of a text, in parts of PART windows; with the place where each part begins."""
    for lo in range(0, max(0, len(raw) - LENGTH) + 1, PART):
        yield lo, Text(raw[lo : lo + PART + LENGTH - 1], powers)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for b in batches:
        for lo, many in slices(b.column(1), ROWS, BYTES):
            part = b.slice(lo, many)
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for uid, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                for base, x in _parts(_raw(t), powers):
                    if len(x.start):
                        for c, v in zip(cols, (*x.phrases(), np.full(len(x.start), uid, np.int64), (x.start + base).astype(np.int32), (x.stop - x.start).astype(np.int16)), strict=True):
                            c.append(v)
            if cols[0]:
                h, kl, kr, uid, s, n = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(kl), _signed(kr), pa.array(uid), pa.array(s), pa.array(n)], ["h", "kl", "kr", "uid", "s", "n"])


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size, in words of 64, that has the upper bits of every key; summed by Spark, a row for a word."""
    place = F.shiftrightunsigned(keys.columns[0], 64 - bits)
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    got = keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("i"), one.alias("m")).groupBy("i").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["i"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
    return out


def _has(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys >> np.uint64(64 - (len(words).bit_length() + 5))
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _with_uid(docs: DataFrame, key: str, text: str, rest: list[str] | None = None) -> DataFrame:
    """Rows known by their content: equal rows share a number, and null ids have one."""
    return docs.select(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0null")), F.col(text)).alias("uid"), F.struct(*[F.col(c) for c in rest or [key]]).alias("k"), F.col(text).alias("t"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, s, e): spans of repeated windows, not merged; uid is the number that _with_uid gives a row."""
    need(docs, key, text)
    rows = _with_uid(docs, key, text).select("uid", "t")
    spark = docs.sparkSession
    parse = keep(rows.mapInArrow(lean(_parse), "h long, kl long, kr long, uid long, s int, n short"), "phrases")
    words = parse.groupBy("h", "kl", "kr").agg(F.count(F.lit(1)).alias("uses"))
    dictionary = keep(words.select("h", "kl", "kr", F.least(F.col("uses"), F.lit(2)).cast("byte").alias("uses")), "dictionary")
    cores = dictionary.select(F.explode(F.array("kl", "kr")).alias("core"), "uses").where("core <> 0")
    cores = cores.groupBy("core").agg(F.count(F.lit(1)).alias("phrases"), F.min("uses").alias("least")).where("phrases > 1 and least = 1")
    sent = spark.sparkContext.broadcast(bitmap(cores.select("core"), CORE_BITS))  # 2 ** CORE_BITS bits
    # Suffixes of such phrases in blocks of BLOCK starts; a block used twice is repeated as a whole.
    blocks = keep(rows.mapInArrow(lean(_blocks(sent)), "bh long, place long, uid long, s int, n byte, d byte, around binary"), "blocks")
    uses = keep(blocks.groupBy("place", "bh").agg(F.count(F.lit(1)).alias("uses")), "block-uses")
    opened = uses.groupBy("place").agg(F.count(F.lit(1)).alias("blocks"), F.min("uses").alias("least")).where("blocks > 1 and least = 1").select("place")
    end = (F.col("s") + F.col("n") + LENGTH).alias("e")
    full = parse.join(dictionary.where("uses > 1").select("h", "kl", "kr"), ["h", "kl", "kr"], "left_semi").select("uid", "s", end)
    most = blocks.join(uses.where("uses > 1").select("place", "bh"), ["place", "bh"], "left_semi").select("uid", "s", end)
    few = neighbours(blocks.join(opened, "place", "left_semi"))
    # Equal rows have equal spans, so after this a row's group is bounded by its own length.
    out = keep(full.unionByName(most).unionByName(few).groupBy("uid", "s").agg(F.max("e").alias("e")), "spans")
    drop_kept(parse, dictionary, blocks, uses)
    return out


def neighbours(blocks: DataFrame) -> DataFrame:
    """(uid, s, e) of the blocks' suffixes that have LENGTH bytes in common with a neighbour in the order of suffixes."""
    one = blocks.select("place", "uid", "s", "d", "around", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("i"))
    one = one.select("place", (F.col("d") - F.col("i")).cast("byte").alias("d"), F.expr(f"substring(around, {BLOCK} - d + i, {BLOCK - 1})").alias("bytes"), "uid", (F.col("s") + F.col("i")).cast("int").alias("s"))
    one = keep(one, "suffixes")
    order = ["place", "d", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last suffix so far: key, uid, start, whether it is like the one before
        for b in batches:
            if not b.num_rows:
                continue
            n = b.num_rows
            place, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            text = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(n, BLOCK - 1)
            uid, s = b.column(3).to_numpy(), b.column(4).to_numpy()
            like = np.zeros(n + 1, bool)  # with the one before; the last is not known yet
            like[1:n] = (place[1:] == place[:-1]) & (d[1:] == d[:-1]) & (text[1:] == text[:-1]).all(1)
            first = (int(place[0]), int(d[0]), text[0].tobytes())
            like[0] = held is not None and held[0] == first
            if held is not None and (held[3] or like[0]):
                yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int32())], ["uid", "s"])
            hit = (like[:-1] | like[1:])[: n - 1]
            yield pa.RecordBatch.from_arrays([pa.array(uid[:-1][hit]), pa.array(s[:-1][hit])], ["uid", "s"])
            held = (int(place[-1]), int(d[-1]), text[-1].tobytes()), int(uid[-1]), int(s[-1]), bool(like[n - 1])
        if held is not None and held[3]:
            yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int32())], ["uid", "s"])

    # Equal keys are in one range, so runs of the order do not cross tasks.
    found = one.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(run), "uid long, s int")
    return found.select("uid", "s", (F.col("s") + LENGTH).alias("e"))


def _blocks(sent):
    """Blocks of the suffixes of phrases with a shared core, with the bytes around what the suffixes have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, given, half = Powers(), set(), (LENGTH - SEED) // 2
        for b in batches:
            for lo, many in slices(b.column(1), ROWS, BYTES):
                part = b.slice(lo, many)
                out: list[list] = [[], [], [], [], [], [], []]
                for uid, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    raw = _raw(t)
                    for base, x in _parts(raw, powers):
                        if len(x.start):
                            _open(x, sent.value, given, half, uid, base, raw[base : base + x.n], out)
                if len(given) > GIVEN:  # a phrase that is given again is one that is there twice
                    given.clear()
                if out[0]:
                    bh, place, uids, s, n, d = (np.concatenate(c) for c in out[:6])
                    around = np.concatenate(out[6])
                    offsets = np.arange(0, around.size + 1, around.shape[1], dtype=np.int32)
                    around = pa.Array.from_buffers(pa.binary(), len(around), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(around.tobytes())])
                    yield pa.RecordBatch.from_arrays([_signed(bh), _signed(place), pa.array(uids), pa.array(s), pa.array(n), pa.array(d), around], ["bh", "place", "uid", "s", "n", "d", "around"])

    return run


def _open(x: Text, shared: np.ndarray, given: set, half: int, uid: int, base: int, raw: bytes, out: list[list]) -> None:
    h, kl, kr = x.phrases()
    firsts, lasts, triggers = [], [], []
    # Windows that reach the left core start half or more before the trigger; the others have the right one.
    for keys, first, last in ((kl, x.start, np.minimum(x.stop, x.trigger - half)), (kr, np.maximum(x.start, x.trigger - half + 1), x.stop)):
        for i in np.flatnonzero((keys != 0) & _has(shared, keys)).tolist():
            name = int(h[i]) ^ int(keys[i])
            if name not in given:
                given.add(name)
                firsts.append(first[i])
                lasts.append(last[i])
                triggers.append(x.trigger[i])
    if not firsts:
        return
    first, last, trigger = np.array(firsts), np.array(lasts), np.array(triggers)
    # A block has the windows whose offsets from the trigger share all but their low bits.
    top, low = (trigger - first) // BLOCK, (trigger - last) // BLOCK
    many = top - low + 1
    of = np.repeat(np.arange(len(first)), many)
    slot = top[of] - (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
    common = trigger[of] - slot * BLOCK  # where what all windows of a block have in common begins
    begin = np.maximum(first[of], common - BLOCK + 1)
    n = np.minimum(last[of], common) - begin
    out[0].append(x.hash(begin, n + LENGTH) ^ _mix(((common - begin) * 512 + n).astype(np.uint64)))  # equal at the same offsets only
    out[1].append(x.hash(common, LENGTH - BLOCK + 1) ^ _mix(slot.astype(np.uint64) + np.uint64(1)))
    out[2].append(np.full(len(of), uid, np.int64))
    out[3].append((begin + base).astype(np.int32))
    out[4].append(n.astype(np.int8))
    out[5].append((common - begin).astype(np.int8))
    # The bytes around it; those beyond the text belong to no window.
    padded = np.zeros(x.n + 2 * BLOCK, np.uint8)
    padded[BLOCK : BLOCK + x.n] = np.frombuffer(raw, np.uint8)
    side = np.arange(BLOCK - 1)
    left = padded[(common + 1)[:, None] + side]
    right = padded[(common + LENGTH - BLOCK + 1 + BLOCK)[:, None] + side]
    out[6].append(np.concatenate([left, right], 1))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap become one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with n_bytes, spans (removed) and kept (the bytes that stay); a row for each row."""
    need(docs, key, text)
    spark = docs.sparkSession
    spans = repeated_spans(docs, key, text)
    marked = bitmap(spans.select("uid"), DOC_BITS)
    sent = spark.sparkContext.broadcast(marked)
    rest = [c for c in docs.columns if c != text]
    rows = _with_uid(docs, key, text, rest)
    kind = rows.schema["k"].dataType.simpleString()
    names = [spare(docs, x) for x in ("n_bytes", "spans", "kept")]

    def out_batch(ids: pa.Array, raws: list[bytes], cuts: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        kept = []
        for raw, cut in zip(raws, cuts, strict=True):
            parts, at = [], 0
            for s, e in cut:
                parts.append(raw[at:s])
                at = e
            kept.append(b"".join([*parts, raw[at:]]) if cut else raw)
        span = pa.array([[{"s": s, "e": e} for s, e in c] for c in cuts], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
        return pa.RecordBatch.from_arrays([ids, pa.array([len(r) for r in raws], pa.int64()), span, pa.array(kept, pa.binary())], ["k", "n_bytes", "spans", "kept"])

    schema = f"k {kind}, n_bytes long, spans array<struct<s:long,e:long>>, kept binary"

    def split(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = sent.value
            for b in batches:
                yield b.filter(pa.array(_has(bits, b.column(0).to_numpy().view(np.uint64)) == hit))

        return run

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in split(False)(batches):
            for lo, many in slices(b.column(2), ROWS, BYTES):
                part = b.slice(lo, many)
                raws = [_raw(t) for t in part.column(2)]
                yield out_batch(part.column(1), raws, [[] for _ in raws])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, many in slices(b.column(1), ROWS, BYTES):
                part = b.slice(lo, many)
                cuts = [merge([(r["s"], r["e"]) for r in x or []]) for x in part.column(2).to_pylist()]
                yield out_batch(part.column(0), [_raw(t) for t in part.column(1)], cuts)

    shape = f"uid long, k {kind}, t string"
    clean = rows.mapInArrow(lean(whole), schema)
    own = spans.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))
    hit = rows.mapInArrow(lean(split(True)), shape).join(own, "uid", "left").select("k", "t", "cuts").mapInArrow(lean(cut), schema)
    both = clean.unionByName(hit)
    return both.select(*[F.col(f"k.`{c}`").alias(c) for c in rest], *[F.col(a).alias(b) for a, b in zip(("n_bytes", "spans", "kept"), names, strict=True)])


def kept_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text that stays; characters that a removed span cuts in two go, null texts become empty."""
    out = dedup(docs, key, text)
    whole = out.columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.decode("utf-8", "ignore") for x in (v.as_py() for v in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["k", "t"])

    rest = [c for c in docs.columns if c != text]
    packed = out.select(F.struct(*rest).alias("k"), F.col(whole).alias("kept"))
    kind = packed.schema["k"].dataType.simpleString()
    flat = packed.mapInArrow(lean(run), f"k {kind}, t string").select(*[F.col(f"k.`{c}`").alias(c) for c in rest], F.col("t").alias(text))
    return flat.select(*docs.columns)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

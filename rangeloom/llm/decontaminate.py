"""Benchmark decontamination: q-gram lemma filtering over diagonal bands, verified by banded alignment.

Texts and items are lower-cased, runs of white space become one blank, and are compared as UTF-8 bytes. An item of up
to WINDOW bytes is one window, a longer one is cut into overlapping windows. A window of w bytes with an edit budget of
e shares at least ``w + 1 - q - q * e`` q-grams with any region within that budget (q-gram lemma), all on diagonals that
differ by e at most. So shared q-grams are counted in overlapping bands of 2 (e + 1) diagonals, bands that reach the
bound are kept, and an alignment within the band decides. No match within the budget is lost, and no text is cut: a long
one is looked up in parts that overlap by more than a region.

Items below SHORT bytes have no edit budget: they are found exactly, where no letter or digit goes on before or after.

The benchmark is a query set: it goes to all documents in blocks of BLOCK_BYTES, each block one scan of the documents
with no shuffle before the matches. A q-gram that many windows share meets its places in portions of POSTINGS.

Defined cases: null and empty texts have no match; items that are null or blank are not searched; equal items each
match; repeated documents give their rows each time they occur, summed by id; an empty table of either kind gives no
rows. Other columns are not read (matches) or kept (clean).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need, slices, spare, table

Q, WINDOW, STRIDE, BUDGET, SHORT = 8, 100, 50, 0.1, 32
#: Bytes of normalised items that one scan of the documents carries; an index takes about 30 times as much.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that are looked up at a time, and pairs of places and windows that are counted at a time.
BUFFER, POSTINGS = 4 << 20, 4 << 20
BITS = 20
#: Between texts in a buffer, and what texts cut in parts have in common; more than a region has.
GAP = b"\x00" * (2 * WINDOW)


def normalise(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def windows_of(item: bytes) -> list[tuple[int, bytes]]:
    if len(item) < SHORT:
        return []
    if len(item) <= WINDOW:
        return [(0, item)]
    starts = sorted({*range(0, len(item) - WINDOW, STRIDE), len(item) - WINDOW})
    return [(s, item[s : s + WINDOW]) for s in starts]


def budget(w: int) -> int:
    return min(int(w * BUDGET), (w - Q) // Q)


def align(window: bytes, region: bytes, e: int) -> tuple[int, int] | None:
    """(edits, end in region) of the best occurrence of the window within the band of the region, if within e edits.

    The band is as wide as the region is longer than the window; cell b of row i stands for the place i + b.
    """
    at = region.find(window)
    if at >= 0:
        return 0, at + len(window)
    w = np.frombuffer(window, np.uint8)
    last = e + len(region) - len(window)  # the last cell whose place is in the region at the end
    if last < 0:
        return None
    wide = last + 1 + e
    r = np.full(len(window) + wide, 256, np.int16)  # e places before the region, and those past it, match nothing
    r[e : e + len(region)] = np.frombuffer(region, np.uint8)
    b = np.arange(wide)
    row = np.zeros(wide, np.int64)  # an occurrence may begin anywhere
    for i in range(len(w)):
        new = row + (r[i : i + wide] != w[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - b) + b
        if row.min() > e:
            return None
    best = int(row[: last + 1].argmin())
    return (int(row[best]), max(0, best + len(w) - e)) if row[best] <= e else None


class Index:
    """Q-grams of all windows of a block of items, and its short items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        import ahocorasick

        self.windows = [(item, at, w) for item, text in items for at, w in windows_of(text)]
        grams = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(w, np.uint8), Q).copy().view("<u8").ravel() for _, _, w in self.windows]
        codes = np.concatenate(grams) if grams else np.zeros(0, "<u8")
        owner = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams]) if grams else np.zeros(0, np.int32)
        offset = np.concatenate([np.arange(len(g), dtype=np.int16) for g in grams]) if grams else np.zeros(0, np.int16)
        order = np.argsort(codes, kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(codes)))
        self.e = np.array([budget(len(w)) for _, _, w in self.windows], np.int64)
        self.least = np.array([len(w) + 1 - Q - Q * budget(len(w)) for _, _, w in self.windows], np.int64)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self._slot(self.codes)] = True
        self.short = ahocorasick.Automaton()
        for item, text in items:
            if 0 < len(text) < SHORT:
                word = text.decode("latin-1")
                self.short.add_word(word, (len(word), [*(self.short.get(word)[1] if word in self.short else []), item]))
        if len(self.short):
            self.short.make_automaton()

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)

    def search_short(self, buffer: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of short items in the buffer that no letter or digit goes on around."""
        if not len(self.short):
            return
        goes_on = lambda c: c >= 128 or chr(c).isalnum()
        for last, (n, items) in self.short.iter(buffer.decode("latin-1")):
            lo, hi = last + 1 - n, last + 1
            if not (lo and goes_on(buffer[lo - 1]) and goes_on(buffer[lo])) and not (hi < len(buffer) and goes_on(buffer[hi]) and goes_on(buffer[last])):
                for item in items:
                    yield item, lo, hi

    def search(self, buffer: bytes) -> Iterator[tuple[int, int, int]]:
        """(window, end, edits) of regions of the buffer within the budget."""
        if len(buffer) < Q or not len(self.codes):
            return
        codes = np.lib.stride_tricks.as_strided(np.frombuffer(buffer, np.uint8)[: Q].view("<u8"), (len(buffer) - Q + 1,), (1,))
        at = np.flatnonzero(self.bits[self._slot(codes)])
        if not len(at):
            return
        own = codes[at]
        k = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        good = self.codes[k] == own
        at, k = at[good], k[good]
        many = np.cumsum(self.count[k])
        keys, hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(many, (many[lo - 1] if lo else 0) + POSTINGS, "right")))
            more, seen = self._counted(at[lo:hi], k[lo:hi])
            keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
            hits = np.bincount(back, np.concatenate([hits, seen]), len(keys)).astype(np.int64)
            lo = hi
        win, band = keys >> 40, keys & ((1 << 40) - 1)
        enough = hits >= self.least[win]
        for w, b in zip(win[enough].tolist(), band[enough].tolist(), strict=True):
            e = int(self.e[w])
            start = b * (e + 1) - (1 << 20)
            low, high = max(0, start - e), start + 2 * (e + 1) + len(self.windows[w][2]) + e
            found = align(self.windows[w][2], buffer[low:high], e)
            if found:
                yield w, low + found[1], found[0]

    def _counted(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and bands (in one number) that the q-grams at these places meet, and how often."""
        n = self.count[k]
        post = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        win = self.owner[post].astype(np.int64)
        band = (np.repeat(at, n) - self.offset[post] + (1 << 20)) // (self.e[win] + 1)
        return np.unique(np.concatenate([win << 40 | band, win << 40 | (band - 1)]), return_counts=True)


def parts_of(texts: pa.Array) -> Iterator[tuple[bytes, list[tuple[int, int, int, int, bool]]]]:
    """Buffers of about BUFFER bytes, each with (start in it, end, row, start in the text, whether its last) of what it holds."""
    held: list[bytes] = []
    places: list[tuple[int, int, int, int, bool]] = []
    size = 0
    for row, value in enumerate(texts):
        text = normalise(value.as_py())
        for lo in range(0, max(1, len(text) - len(GAP)), BUFFER):
            piece = text[lo : lo + BUFFER + len(GAP)]
            places.append((size, size + len(piece), row, lo, lo + len(piece) == len(text)))
            held += [piece, GAP]
            size += len(piece) + len(GAP)
            if size >= BUFFER:
                yield b"".join(held), places
                held, places, size = [], [], 0
    if held:
        yield b"".join(held), places


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, n_windows, edits, first_end, last_end): documents with a region close to a window of an item."""
    need(docs, key, text)
    need(benchmark, item, item_text)
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    kind = dict(docs.dtypes)[key]
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r["i"], normalise(r["t"])) for r in part.toLocalIterator()])  # BLOCK_BYTES or so

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for b in batches:
                for lo, many in slices(b.column(1), 1 << 20, BUFFER):
                    ids = b.column(0).slice(lo, many)
                    found: dict[tuple[int, int], list] = {}
                    for buffer, places in parts_of(b.column(1).slice(lo, many)):
                        starts = [x[0] for x in places]

                        def place(end: int, starts=starts, places=places) -> tuple[int, int, int, int, bool]:
                            return places[int(np.searchsorted(starts, end, "left")) - 1]

                        for w, end, edits in index.search(buffer):
                            begin, stop, row, at, _ = place(end)
                            if begin < end <= stop:
                                found.setdefault((row, index.windows[w][0]), []).append((w, at + end - begin, edits))
                        for item, start, end in index.search_short(buffer):
                            begin, stop, row, at, final = place(end)
                            # Where parts overlap, one of them sees what is around: the first up to the middle.
                            middle = len(GAP) // 2
                            if end <= stop and (not at or start - begin >= middle) and (final or start - begin < BUFFER + middle):
                                found.setdefault((row, item), []).append((-1, at + end - begin, 0))
                    if found:
                        rows = sorted(found)
                        hits = [found[r] for r in rows]
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([d for d, _ in rows])), pa.array([i for _, i in rows], pa.int64()), pa.array([len({w for w, _, _ in h}) for h in hits], pa.int64()),
                             pa.array([min(x for _, _, x in h) for h in hits], pa.int64()), pa.array([min(x for _, x, _ in h) for h in hits], pa.int64()), pa.array([max(x for _, x, _ in h) for h in hits], pa.int64())],
                            ["k", "item_id", "n_windows", "edits", "first_end", "last_end"],
                        )

        one = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(lean(run), f"k {kind}, item_id long, n_windows long, edits long, first_end long, last_end long")
        out = one if out is None else out.unionByName(one)
    out = out.groupBy("k", "item_id").agg(F.max("n_windows").alias("n_windows"), F.min("edits").alias("edits"), F.min("first_end").alias("first_end"), F.max("last_end").alias("last_end"))
    return out.withColumnRenamed("k", key)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a match, with all their columns. Null keys stay if their text has no match."""
    name = spare(docs, "hit_key")
    hit = matches(docs, benchmark, key, text).select(F.col(key).alias(name)).distinct()
    return docs.join(hit, F.col(key).eqNullSafe(F.col(name)), "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

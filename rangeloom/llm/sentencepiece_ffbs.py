"""Sampled segmentation into pieces of a public vocabulary, and lossless decoding.

A text is a lattice of pieces. Forward filtering sums the weight of all paths to each place; backward sampling then
draws one path from the end, each step with the chance its paths have. Weights follow Zipf's law over the vocabulary's
merge ranks, smoothed by a power. Draws come from a counter-based generator keyed by seed, row key, unit and step, so a row's segmentation
does not depend on partitions, batches or other rows.

No piece has a mark after another character, so the lattice splits into units without losing a path: blanks with the
characters up to the next blank, however many. Units of up to SHORT characters are filtered once for each different one,
and sampled for all occurrences at once. Longer ones, such as sentences of scripts without blanks, are filtered in
logarithms over a rolling window that carries the last values on, and sampled alone. Blanks become the mark; what the
vocabulary lacks, the mark itself included, becomes byte pieces, so decoding gives back every text exactly.

Defined cases: null text gives null ids, empty text no ids; null keys share one stream of draws; equal rows get equal
ids; other columns are kept, and new columns avoid their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need, slices, spare, table
from .piece_table import PieceTable

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(MARK + "| *[^ " + MARK + "]+| +", re.S)
#: Characters of a unit that is filtered with others, and of a part of a longer one that is looked up at a time.
SHORT, PART, SEED = 48, 1 << 15, 11
HALF = re.compile(f"[^ {MARK}]{{{SHORT // 2}}}| {{{SHORT // 2}}}")
#: Power of the weights: 1 samples by the weights themselves, 0 all paths alike.
SMOOTHING = 0.5
UNKNOWN_WEIGHT = 1e-5
#: Units, and edges of their lattices, that a worker remembers at most; rows and bytes that it samples, and ids that it decodes, at a time.
CACHED, EDGES, ROWS, BYTES, DECODED = 200_000, 4_500_000, 2000, 2 << 20, 1 << 20


class Vocabulary:
    def __init__(self, name: str = VOCABULARY, smoothing: float = SMOOTHING):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.size = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.text: list[bytes] = [b""] * self.size
        self.byte = [0] * 256
        ranks = np.zeros(self.size)
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                n = int(p[3:5], 16)
                self.byte[n], self.text[i] = i, bytes([n])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.text[i] = p.replace(MARK, " ").encode()
                ranks[i] = -sp.get_score(i)
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {p!r} has a mark after another character; units would cut it")
                self.ids[p] = i
        self.longest = max(map(len, self.ids))
        self.table = PieceTable(self.ids, self.longest)
        weight = 1 / (ranks + 100.0)
        self.blob = None
        self.weight = np.append(np.append(weight / weight.sum(), UNKNOWN_WEIGHT) ** smoothing, 0.0)  # then: a character that is no piece; no edge

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' bytes in a row, where each begins, and how many it has."""
        if self.blob is None:
            width = np.array([len(x) for x in self.text], np.int64)
            self.blob = np.frombuffer(b"".join(self.text), np.uint8), np.cumsum(width) - width, width
        return self.blob


@lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(name)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Filtered lattices of the units seen, and sampling of many units at once."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}  # unit -> its last node
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.nodes = 0

    def learn(self, units: set[str]) -> None:
        fresh = [u for u in units if u not in self.known]
        if self.known and (len(self.known) + len(fresh) > CACHED or sum(len(x[0]) for x in self.parts) > EDGES):
            self._clear()
            fresh = list(units)
        fresh.sort(key=len)
        for lo in range(0, len(fresh), 3072):
            self._filter(fresh[lo : lo + 3072])
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))]

    def _filter(self, units: list[str]) -> None:
        voc = self.voc
        length = len(units[-1])
        chars = np.array(units, f"U{length}").view(np.uint32).reshape(len(units), length).astype(np.int64)
        size = np.array([len(u) for u in units])
        chars[np.arange(length)[None, :] >= size[:, None]] = -1
        chars[chars == ord(" ")] = ord(MARK)
        chars[[i for i, u in enumerate(units) if u == MARK], 0] = -2  # the mark as text is no piece
        most, many = min(voc.longest, length), len(units)
        # Places first and units last, so that each step below runs over neighbouring numbers.
        ids = np.full((length + 1, most, many), voc.size + 1, np.int32)
        for k, w, e, piece in voc.table.find(chars):
            ids[e + 1, k - 1, w] = piece
        code = np.where(chars == -2, ord(MARK), chars).T
        ids[1:, 0] = np.where((ids[1:, 0] > voc.size) & (chars.T != -1), voc.size, ids[1:, 0])
        weight = voc.weight[ids]
        weight[0] = 0
        alpha = np.zeros((length + 1, many))
        alpha[0] = 1
        for e in range(1, length + 1):
            k = min(e, most)
            weight[e, :k] *= alpha[e - k : e][::-1]
            weight[e, k:] = 0
            alpha[e] = weight[e, :k].sum(0)
        weight = np.ascontiguousarray(weight.transpose(0, 2, 1))
        at = np.flatnonzero(weight)
        node, k = np.divmod(at, most)  # a node is a place of a unit: its number is place * many + unit
        e, w = np.divmod(node, many)
        own = weight.ravel()[at] / alpha.ravel()[node]
        first = np.append(True, node[1:] != node[:-1])  # of its node
        cum = np.cumsum(own)
        cum -= (cum[first] - own[first])[np.cumsum(first) - 1]
        cum[np.append(first[1:], True)] = 1.0  # rounding must not leave a gap
        piece = ids[e, k, w]
        piece = np.where(piece == voc.size, voc.size + code[e - 1, w], piece)
        node += self.nodes
        self.parts.append((node + cum, (node - (k + 1) * many).astype(np.int32), piece.astype(np.int32), e == k + 1))
        for i, u in enumerate(units):
            self.known[u] = self.nodes + len(u) * many + i
        self.nodes += many * (length + 1)

    def sample(self, ends: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and how many each has. stream: a number for each unit."""
        key, before, piece, first = self.parts[0]
        at = np.argsort(ends)  # equal units together: neighbours in the tables
        node, step, found = ends[at], 0, []
        count = np.zeros(len(ends), np.int64)
        while len(at):
            u = (_mix(stream[at] + np.uint64(0x9E3779B97F4A7C15 * (step + 1) % 2**64)) >> np.uint64(12)) * 2.0**-52
            j = np.searchsorted(key, node + u, "right")
            found.append((at, piece[j]))
            count[at] += 1
            more = ~first[j]
            at, node, step = at[more], before[j][more], step + 1
        stop = np.cumsum(count)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.int64)
        for s, (at, p) in enumerate(found):
            out[stop[at] - 1 - s] = p
        odd = np.flatnonzero(out >= self.voc.size)
        if len(odd):
            owner = np.searchsorted(stop, odd, "right")
            raw = [chr(c).encode("utf-8", "replace") for c in (out[odd] - self.voc.size).tolist()]
            width = np.ones(len(out), np.int64)
            width[odd] = [len(r) for r in raw]
            np.add.at(count, owner, width[odd] - 1)
            begin = np.cumsum(width) - width
            out = np.repeat(out, width)
            for b, r in zip(begin[odd].tolist(), raw, strict=True):
                out[b : b + len(r)] = [self.voc.byte[x] for x in r]
        return out, count


    def sample_long(self, unit: str, stream: int) -> list[int]:
        """Ids of one unit of any length; its lattice is never held as a whole, only a logarithm for each place."""
        voc, n = self.voc, len(unit)
        mark = unit == MARK  # the mark as text is no piece
        weight = np.log(voc.weight[:-1])

        def edges(lo: int, hi: int) -> list[list[tuple[int, float, int]]]:
            """(length, log weight, piece) of the edges that end at each place from lo + 1 to hi."""
            begin = max(0, lo + 1 - voc.longest)
            code = np.frombuffer(unit[begin:hi].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            chars = np.where(code == ord(" "), ord(MARK), code)
            out: list[list[tuple[int, float, int]]] = [[] for _ in range(hi - lo)]
            if not mark:
                for k, _, e, piece in voc.table.find(chars[None, :]):
                    at = e + 1 + begin - lo
                    for a, p, w in zip(at.tolist(), piece.tolist(), weight[piece].tolist(), strict=True):
                        if a >= 1:
                            out[a - 1].append((k, w, p))
            for a, own in enumerate(out):
                if not own or own[0][0] != 1:
                    own.insert(0, (1, float(weight[voc.size]), voc.size + int(code[a + lo - begin])))
            return out

        alpha = [0.0] * (n + 1)
        for lo in range(0, n, PART):
            for e, own in enumerate(edges(lo, min(n, lo + PART)), lo + 1):
                v = [alpha[e - k] + w for k, w, _ in own]
                top = max(v)
                alpha[e] = top + math.log(sum(math.exp(x - top) for x in v))
        out, at, lo, step, own = [], n, n, 0, []
        while at:
            if at <= lo:
                lo = (at - 1) // PART * PART
                own = edges(lo, at)
            u = float(_mix(np.array([(stream + 0x9E3779B97F4A7C15 * (step + 1)) % 2**64], np.uint64))[0] >> np.uint64(12)) * 2.0**-52
            choice = own[at - lo - 1]
            for k, w, piece in choice:
                u -= math.exp(alpha[at - k] + w - alpha[at])
                if u < 0:
                    break
            out.append(piece)
            at, step = at - k, step + 1
        ids: list[int] = []
        for piece in reversed(out):
            ids += [piece] if piece < voc.size else [voc.byte[x] for x in chr(piece - voc.size).encode("utf-8", "replace")]
        return ids


def _row_stream(keys: list, seed: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(repr(k).encode(), seed) for k in keys], np.uint64)


def segment(texts: list[str], keys: list, sampler: Sampler, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has."""
    units = [UNIT.findall(t) for t in texts]
    n = np.array([len(us) for us in units], np.int64)
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    every = list(chain.from_iterable(units))
    ordinal = np.arange(len(every)) - np.repeat(np.cumsum(n) - n, n)
    stream = _mix(np.repeat(_row_stream(keys, seed), n) + ordinal.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    # Only texts with half a long unit of blanks or of other characters can have one.
    begin = (np.cumsum(n) - n).tolist()
    long = np.array([at + j for t, us, at in zip(texts, units, begin, strict=True) if HALF.search(t) for j, u in enumerate(us) if len(u) > SHORT], np.int64)
    short = every
    if len(long):
        rest = np.delete(np.arange(len(every)), long)
        short = [every[i] for i in rest.tolist()]
    sampler.learn(set(short))
    ends = np.fromiter(map(sampler.known.__getitem__, short), np.int64, len(short))
    if not len(long):
        ids, count = sampler.sample(ends, stream)
    else:
        own, few = sampler.sample(ends, stream[rest]) if len(rest) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        count = np.zeros(len(every), np.int64)
        count[rest] = few
        apart = [sampler.sample_long(every[i], int(stream[i])) for i in long.tolist()]
        count[long] = [len(x) for x in apart]
        stop = np.cumsum(count)
        ids = np.zeros(int(stop[-1]), np.int64)
        is_long = np.zeros(len(every), bool)
        is_long[long] = True
        ids[~np.repeat(is_long, count)] = own
        for i, x in zip(long.tolist(), apart, strict=True):
            ids[stop[i] - len(x) : stop[i]] = x
    return ids, np.add.reduceat(np.append(count, 0), np.minimum(np.cumsum(n) - n, len(count))) * (n > 0)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, name: str = VOCABULARY, into: str = "ids") -> DataFrame:
    """``docs`` with the sampled ids of each text."""
    need(docs, key, text)
    into = spare(docs, into)
    k, t = docs.columns.index(key), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(vocabulary(name))
        for b in batches:
            for lo, many in slices(b.column(t), ROWS, BYTES):
                part = b.slice(lo, many)
                texts = part.column(t).to_pylist()
                ids, count = segment([x or "" for x in texts], part.column(k).to_pylist(), sampler, seed)
                offsets = np.concatenate(([0], np.cumsum(count)))
                none = [x is None for x in texts]
                offsets = pa.array(offsets, pa.int32(), mask=np.append(none, False)) if any(none) else pa.array(offsets, pa.int32())
                values = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*b.schema.names, into])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    return docs.mapInArrow(lean(run), f"{fields}, `{into}` array<int>")


def decode_ids(ids: list[int], voc: Vocabulary) -> str:
    return b"".join(map(voc.text.__getitem__, ids)).decode("utf-8", "replace")


def decode_lists(lists: pa.ListArray, voc: Vocabulary) -> pa.Array:
    """The texts of many lists of ids at once; bytes that are no UTF-8 are replaced."""
    blob, start, width = voc.bytes_of()
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    w = width[ids]
    ends = np.concatenate(([0], np.cumsum(w)))
    data = blob[np.repeat(start[ids] - ends[:-1], w) + np.arange(ends[-1])]
    count = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
    offsets = ends[np.concatenate(([0], np.cumsum(count)))].astype(np.int64)
    none = np.array(lists.is_null())
    raw = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    try:
        out = raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())
    return pa.compute.if_else(pa.array(none), pa.scalar(None, pa.string()), out) if none.any() else out


def decode(encoded: DataFrame, ids: str = "ids", name: str = VOCABULARY, into: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids stand for."""
    need(encoded, ids)
    into, at = spare(encoded, into), encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(name)
        for b in batches:
            ends = np.cumsum(np.array(pa.compute.fill_null(pa.compute.list_value_length(b.column(at)), 0), np.int64))
            lo = 0
            while lo < b.num_rows:
                most = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + DECODED, "right"))
                part = b.slice(lo, max(1, min(most - lo, 250)))
                lo += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, decode_lists(part.column(at), voc)], [*b.schema.names, into])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in encoded.dtypes)
    return encoded.mapInArrow(lean(run), f"{fields}, `{into}` string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))

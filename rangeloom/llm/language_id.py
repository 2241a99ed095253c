"""Language ID: unigram models over the pieces of a fixed public vocabulary, summed over all segmentations.

Words are runs of letters and the marks on them in lower case, however long, with the mark that begins a word. A
language gives each piece a probability; the forward algorithm sums the probability of a word over all its segmentations
into pieces, and a text's is the product over its words. Piece probabilities are fitted by expectation maximisation from
the word counts of all training documents, partial sums first; the model has a number for each piece and language,
whatever the corpus. Scoring is one pass without a shuffle. Words of up to SHORT letters are summed many at a time;
longer ones alone, over a rolling window with its scale kept apart, so that nothing underflows.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is all if nothing can be learned from.
Ties go to the first language in order. Repeated rows give a row each. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep, lean, need, slices, table
from .piece_table import PieceTable

#: A letter, and letters with what is written on them. Numerals such as one half are no letters.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII = re.compile("[a-z]+")
VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Letters of a word that is summed with others, and of a part of a longer one that is looked up at a time.
SHORT, PART = 48, 1 << 15
ROUNDS, SMOOTH, FLUSH, BLOCK = 2, 200.0, 400_000, 2048
#: Bytes of words that a task remembers, and rows and bytes of text that it takes at a time.
KNOWN_BYTES, ROWS, BYTES = 64 << 20, 256, 2 << 20


def words_of(text: str | None) -> list[str]:
    s = (text or "").lower()
    return ASCII.findall(s) if s.isascii() else WORD.findall(s)


@lru_cache(maxsize=2)
def pieces(name: str = VOCABULARY) -> dict[str, int]:
    """Pieces of letters, with or without the mark, numbered by their place in the vocabulary; the last number is for other letters."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    out: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and p == p.lower() and (p == MARK or WORD.fullmatch(p.removeprefix(MARK))):
            out[p] = len(out)
    return out


@lru_cache(maxsize=2)
def piece_table(name: str = VOCABULARY) -> PieceTable:
    return PieceTable(pieces(name), max(map(len, pieces(name))))


def lattice(words: list[str], vocabulary: dict[str, int], name: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """ids[w, e, k]: number of the piece of k + 1 characters that ends at character e of word w, or one past the last; and lengths."""
    marked = [MARK + w for w in words]
    n = np.array([len(w) for w in marked])
    length = int(n.max(initial=1))
    chars = np.array(marked, f"U{length}").view(np.uint32).reshape(len(marked), length).astype(np.int64)
    chars[np.arange(length)[None, :] >= n[:, None]] = -1
    other, none = len(vocabulary), len(vocabulary) + 1
    found = piece_table(name)
    ids = np.full((len(words), length + 1, min(found.longest, length)), none, np.int32)
    for k, w, e, piece in found.find(chars):
        ids[w, e + 1, k - 1] = piece
    ids[:, 1:, 0] = np.where((ids[:, 1:, 0] == none) & (chars != -1), other, ids[:, 1:, 0])
    return ids, n


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[w, e, l]: probability of the first e characters under language l. p has a row for each piece, and zeros last."""
    alpha = np.zeros((ids.shape[0], ids.shape[1], p.shape[1]))
    alpha[:, 0] = 1
    for e in range(1, ids.shape[1]):
        for k in range(min(e, ids.shape[2])):
            alpha[:, e] += alpha[:, e - k - 1] * p[ids[:, e, k]]
    return alpha


def expected(ids: np.ndarray, n: np.ndarray, p: np.ndarray, lang: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
    """Add the expected uses of each piece in words of one language each: into[piece, language]."""
    own = p[ids, lang[:, None, None]]
    rows = np.arange(len(n))
    alpha = np.zeros(ids.shape[:2])
    beta = np.zeros(ids.shape[:2])
    alpha[:, 0], beta[rows, n] = 1, 1
    for e in range(1, ids.shape[1]):
        for k in range(min(e, ids.shape[2])):
            alpha[:, e] += alpha[:, e - k - 1] * own[:, e, k]
    for e in range(ids.shape[1] - 1, 0, -1):
        for k in range(min(e, ids.shape[2])):
            beta[:, e - k - 1] += beta[:, e] * own[:, e, k]
    scale = weight / np.maximum(alpha[rows, n], 1e-300)
    w, e, k = np.nonzero(ids < p.shape[0] - 1)
    use = alpha[w, e - k - 1] * own[w, e, k] * beta[w, e] * scale[w]
    into += np.bincount(ids[w, e, k] * into.shape[1] + lang[w], use, into.size).reshape(into.shape)


def _parts(word: str, name: str, ends: Iterator[tuple[int, int]]) -> Iterator[tuple[int, list[list[tuple[int, int]]]]]:
    """For each (lo, hi) of ``ends``: lo, and the (length, piece) that end at each place from lo + 1 to hi of the marked word."""
    found, other = piece_table(name), len(pieces(name))
    for lo, hi in ends:
        begin = max(0, lo + 1 - found.longest)
        chars = np.frombuffer(word[begin:hi].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
        for k, _, e, piece in found.find(chars[None, :]):
            for a, x in zip((e + begin - lo).tolist(), piece.tolist(), strict=True):
                if a >= 0:
                    out[a].append((k, x))
        for own in out:
            if not own or own[0][0] != 1:
                own.insert(0, (1, other))
        yield lo, out


def forward_long(word: str, p: np.ndarray, name: str = VOCABULARY) -> np.ndarray:
    """Log probability of a word of any length under each language; only a window of the sums is held."""
    marked, longest = MARK + word, piece_table(name).longest
    ring = np.zeros((longest, p.shape[1]))  # sums to the last places, over a common scale for each language
    ring[-1] = 1
    scale = np.zeros(p.shape[1])
    for _, ends in _parts(marked, name, ((lo, min(lo + PART, len(marked))) for lo in range(0, len(marked), PART))):
        for own in ends:
            new = sum(ring[-k] * p[x] for k, x in own)
            ring[:-1] = ring[1:]
            ring[-1] = new
            top = ring.max(0)
            if (top < 1e-100).any():
                top = np.where(top > 0, top, 1.0)
                ring /= top
                scale += np.log(top)
    return scale + np.log(np.maximum(ring[-1], 1e-300))


def expected_long(word: str, p: np.ndarray, l: int, weight: float, into: np.ndarray, name: str = VOCABULARY) -> None:
    """expected() of one word of any length, with a logarithm for each place."""
    marked = MARK + word
    n = len(marked)
    logs = np.log(np.maximum(p[:, l], 1e-300)).tolist()
    steps = [(lo, min(lo + PART, n)) for lo in range(0, n, PART)]
    alpha, beta = [0.0] * (n + 1), [-math.inf] * n + [0.0]
    for lo, ends in _parts(marked, name, iter(steps)):
        for e, own in enumerate(ends, lo + 1):
            v = [alpha[e - k] + logs[x] for k, x in own]
            top = max(v)
            alpha[e] = top + math.log(sum(math.exp(y - top) for y in v))
    for lo, ends in _parts(marked, name, reversed(steps)):
        for e in range(lo + len(ends), lo, -1):
            for k, x in ends[e - lo - 1]:
                into[x, l] += weight * math.exp(alpha[e - k] + logs[x] + beta[e] - alpha[n])
                y = beta[e] + logs[x]
                high, low = max(y, beta[e - k]), min(y, beta[e - k])
                beta[e - k] = high + math.log1p(math.exp(low - high))


def word_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])
            seen.clear()

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen.setdefault(name, Counter()).update(words_of(t.as_py()))
                if sum(map(len, seen.values())) > FLUSH:
                    yield from out()
        yield from out()

    part = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(lean(run), "lang string, word string, n long")
    return part.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities with a column for each language."""
    need(docs, lang, text)
    counts = keep(word_counts(docs.where(F.col(lang).isNotNull()), lang, text), "language-words")
    try:
        names = sorted(r[0] for r in counts.select("lang").distinct().collect())
        size = len(pieces(vocabulary))
        p = np.full((size + 2, max(1, len(names))), 1.0 / (size + 1))
        p[-1] = 0
        at = {x: i for i, x in enumerate(names)}

        for _ in range(rounds if names else 0):

            def step(batches: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
                voc, total = pieces(vocabulary), np.zeros(p.shape)
                for b in batches:
                    for lo, many in slices(b.column(1), 8 * BLOCK, BYTES):
                        part = b.slice(lo, many)
                        order = sorted(zip(part.column(1).to_pylist(), part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True), key=lambda r: len(r[0]))
                        while order and len(order[-1][0]) > SHORT:
                            word, name, n = order.pop()
                            expected_long(word, p, at[name], n, total, vocabulary)
                        for j in range(0, len(order), BLOCK):  # words of like length together
                            rows = order[j : j + BLOCK]
                            ids, n = lattice([r[0] for r in rows], voc, vocabulary)
                            expected(ids, n, p, np.array([at[r[1]] for r in rows]), np.array([r[2] for r in rows], float), total)
                piece, l = np.nonzero(total)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "l": pa.array(l, pa.int32()), "c": pa.array(total[piece, l], pa.float64())})

            got = counts.mapInArrow(lean(step), "piece int, l int, c double").groupBy("piece", "l").agg(F.sum("c").alias("c")).toPandas()  # a row for each piece and language at most
            c = np.zeros(p.shape)
            c[got["piece"].to_numpy(), got["l"].to_numpy()] = got["c"].to_numpy()
            whole = c.sum(1, keepdims=True)
            back = (whole + 0.01) / (whole + 0.01).sum()
            p = (c + SMOOTH * back) / (c.sum(0, keepdims=True) + SMOOTH)
            p[-1] = 0
        return names, p
    finally:
        drop_kept(counts)


def identify(docs: DataFrame, names: list[str], p: np.ndarray, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, lang_pred, score)."""
    need(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, table_ = pieces(vocabulary), sent.value
        known: dict[str, int] = {}
        logs = np.zeros((0, max(1, len(names))))
        held = 0
        for b in batches:
            for lo, many in slices(b.column(1), ROWS, BYTES):
                part = b.slice(lo, many)
                texts = [words_of(t.as_py()) for t in part.column(1)]
                distinct = set().union(*texts)
                fresh = [w for w in distinct if w not in known]
                size = sum(map(len, fresh)) + 200 * len(fresh)  # a word, its place in the table, and its logarithms
                if held + size > KNOWN_BYTES and known:
                    known, logs, held = {}, logs[:0], 0
                    fresh = list(distinct)
                    size = sum(map(len, fresh)) + 200 * len(fresh)
                held += size
                fresh.sort(key=len)
                few = next((i for i, w in enumerate(fresh) if len(w) > SHORT), len(fresh))
                more = [logs]
                for j in range(0, few, BLOCK):
                    ids, n = lattice(fresh[j : min(j + BLOCK, few)], voc, vocabulary)
                    more.append(np.log(np.maximum(forward(ids, table_)[np.arange(len(n)), n], 1e-300)))
                more += [forward_long(w, table_, vocabulary)[None, :] for w in fresh[few:]]
                known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                logs = np.concatenate(more)
                pred, score = [], []
                for ws in texts:
                    if not ws or not names:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = logs[np.fromiter(map(known.__getitem__, ws), int, len(ws))].sum(0)
                    best = int(total.argmax())
                    pred.append(names[best])
                    score.append(float(1 / np.exp((total - total[best]) / max(1.0, len(ws) / 20)).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["k", "lang_pred", "score"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(lean(run), f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    names, p = fit(docs.where(rest != 2))
    return identify(docs, names, p).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")

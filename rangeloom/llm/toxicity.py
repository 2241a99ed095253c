"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration.

Fit, on a bounded sample of labelled rows (``max_per_class`` of each class, those with the least hash of their id):
each word has a log-odds of the toxic class under a Dirichlet prior centred on the class share of the word's prefix,
itself smoothed to the class share of all tokens. A token scores its log-odds less a drift, so clean text drifts down.

Score, over every whole text: a linear-time scan finds all maximal-scoring segments (Ruzzo and Tompa 1999). Under
clean text, the number of segments of score s in n tokens is about K n exp(-lambda s) (Karlin and Altschul 1990);
lambda solves E[exp(lambda score)] = 1 over clean tokens and K is the rate seen. Segments with an expected count below
``e_value`` are significant, and a document's evidence is the sum statistic of its significant segments (or its best
segment, if none is). Evidence becomes a score in 0 to 1 by a logistic curve that crosses CUT where the F1 of documents
held out within the sample is largest.

The model is bounded by the sample, whatever the corpus: a 64-bit hash and a score for each word and prefix. Counts and
histograms are summed by Spark; the driver gets the model, the histogram's few hundred steps, and a number for each
sampled row. Scoring is one pass without a shuffle.

Defined cases: null and empty texts, and those without a word, have no segment and the evidence of n = 1; a label that
is null is no label; if labels disagree on an id, toxic wins; without labels of both classes every score is 0. Repeated
rows give a row each; other columns are not read (op6_toxicity) or kept (score_documents).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, drop_kept, keep, lean, need, slices, spare, table

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows of each class that the fit reads at most.
MAX_PER_CLASS = 10_000
PREFIX, PRIOR, PREFIX_PRIOR, DRIFT, FLOOR, E_VALUE, CUT = 4, 3.0, 20.0, 2.0, -3.0, 0.05, 0.7
#: Bytes of words whose scores a task remembers, and counts that it sums before it hands them on.
KNOWN_BYTES, FLUSH = 32 << 20, 200_000
#: Rows, and bytes of text, that a task scores at a time.
ROWS, BYTES = 1000, 4 << 20
#: Folds within the sample; each is scored by a model of the others, to place the cut.
FOLDS = 4


def _empty() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(0, np.uint64), np.zeros(0, np.float32)


@dataclass
class Model:
    """words, prefixes: sorted hashes and their scores."""

    words: tuple[np.ndarray, np.ndarray] = field(default_factory=_empty)
    prefixes: tuple[np.ndarray, np.ndarray] = field(default_factory=_empty)
    default: float = FLOOR
    lam: float = 1.0
    k: float = 0.1
    cut: float = math.inf
    slope: float = 1.0
    fitted: bool = False


def hash_of(word: str) -> int:
    """What Spark's xxhash64 makes of the word."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)


def scores(model: Model) -> Remembered:
    """A score for each word: its own, else its prefix's, else the default."""

    def make(word: str) -> float:
        for (keys, values), x in ((model.words, word), (model.prefixes, word[:PREFIX])):
            h = np.uint64(hash_of(x))
            at = int(keys.searchsorted(h))
            if at < len(keys) and keys[at] == h:
                return float(values[at])
        return model.default

    return Remembered(KNOWN_BYTES, make)


def segments(values: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments as (score, start, end), in order; linear time in the number of values."""
    at = np.flatnonzero(values > 0)
    if not len(at):
        return []
    total = np.concatenate(([0.0], np.cumsum(values)))
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum through, index of the nearest segment with a smaller sum before
    for i in at.tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(right - left, start, end) for start, end, left, right, _ in stack]


def evidence(model: Model, scores: list[float], n: int) -> float:
    """Sum statistic of the significant segments, or the best one's normalised score."""
    base = math.log(max(model.k, 1e-9) * max(n, 1))
    z = sorted((model.lam * s - base for s in scores), reverse=True)
    sig = [x for x in z if x > -math.log(E_VALUE)]
    return sum(sig) + math.lgamma(len(sig) + 1) if sig else (z[0] if z else -base - 1.0)


def squash(model: Model, z: float) -> float:
    if not model.fitted:
        return 0.0
    x = model.slope * (z - model.cut) + math.log(CUT / (1 - CUT))
    return 1 / (1 + math.exp(-min(max(x, -500), 500)))


def _tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": [k[0] for k in seen], "toxic": pa.array([k[1] for k in seen], pa.int32()), "half": pa.array([k[2] for k in seen], pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    for b in batches:
        for text, y, half in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for w, n in Counter(_tokens(text.as_py())).items():
                seen[w, y, half] += n
        if len(seen) > FLUSH:
            yield out()
            seen.clear()
    if seen:
        yield out()


def _pairs(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows (h, v) as sorted hashes and scores."""
    got = rows.toArrow()
    h, v = got["h"].to_numpy().view(np.uint64), got["v"].to_numpy().astype(np.float32)
    order = np.argsort(h)
    return h[order], v[order]


def _log_odds(counts: DataFrame) -> Model:
    """Word and prefix scores from (word, toxic, n); words are in the sample, so the model is bounded by it."""
    c = counts.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("y0"))
    n1, n0 = c.agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return Model()
    base = n1 / (n1 + n0)
    logit = lambda r: F.greatest(F.lit(FLOOR), F.log(r / (1 - r)) - math.log(base / (1 - base)) - DRIFT)
    p = c.groupBy(F.substring("word", 1, PREFIX).alias("prefix")).agg(((F.sum("y1") + PREFIX_PRIOR * base) / (F.sum("y1") + F.sum("y0") + PREFIX_PRIOR)).alias("share"))
    w = c.withColumn("prefix", F.substring("word", 1, PREFIX)).join(p, "prefix")
    words = _pairs(w.select(F.xxhash64("word").alias("h"), logit((F.col("y1") + PRIOR * F.col("share")) / (F.col("y1") + F.col("y0") + PRIOR)).alias("v")))
    prefixes = _pairs(p.select(F.xxhash64("prefix").alias("h"), logit(F.col("share")).alias("v")))
    return Model(words, prefixes, max(FLOOR, -DRIFT))


def _sample(labels: DataFrame, train, max_per_class: int) -> DataFrame:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(train(F.col("doc_id")))
    h = F.xxhash64("doc_id")
    parts = [known.where(F.col("toxic") == y).orderBy(h, "doc_id").limit(max_per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("label_id"), "toxic", F.pmod(F.shiftright(F.xxhash64("doc_id"), 7), F.lit(FOLDS)).cast("int").alias("half"))


def fit(docs: DataFrame, labels: DataFrame, train, max_per_class: int = MAX_PER_CLASS, key: str = "doc_id", text: str = "text") -> Model:
    """The model; ``train`` is a function from the id column to the condition under which a label may be learned from."""
    need(docs, key, text)
    # Two columns of integers for 2 * max_per_class rows at most: a proven bound.
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(_sample(labels, train, max_per_class)), F.col("k") == F.col("label_id")).select("t", "toxic", "half")
    counts = rows.mapInArrow(lean(_word_counts), "word string, toxic int, half int, n long").groupBy("word", "toxic", "half").agg(F.sum("n").alias("n"))
    counts = keep(counts, "toxicity-words")
    halves = [_log_odds(counts.where(F.col("half") != h)) for h in range(FOLDS)]
    model = _log_odds(counts)
    drop_kept(counts)
    if not len(model.words[0]):
        return model

    sent = docs.sparkSession.sparkContext.broadcast(halves)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, hist = [scores(m) for m in sent.value], Counter()
        kinds = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("step", pa.float64()), ("hits", pa.int64())])
        for b in batches:
            for lo, many in slices(b.column(0), ROWS, BYTES):
                part = b.slice(lo, many)
                out: dict[str, list] = {"toxic": part.column(1).to_pylist(), "n": [], "s": [], "step": [None] * many, "hits": [None] * many}
                for t, y, half in zip(part.column(0), out["toxic"], part.column(2).to_pylist(), strict=True):
                    words = _tokens(t.as_py())
                    v = np.fromiter(tables[half].of(words), float, len(words))
                    if not y:
                        hist.update(np.round(v, 1).tolist())
                    out["n"].append(len(v))
                    out["s"].append([s for s, _, _ in segments(v)])
                yield pa.RecordBatch.from_pydict(out, kinds)
        none = [None] * len(hist)
        yield pa.RecordBatch.from_pydict({"toxic": none, "n": none, "s": none, "step": list(hist), "hits": list(hist.values())}, kinds)

    seen = keep(rows.mapInArrow(lean(scan), "toxic int, n long, s array<double>, step double, hits long"), "toxicity-segments")
    hist = seen.where("step is not null").groupBy("step").agg(F.sum("hits").alias("hits")).collect()  # steps of a tenth, from FLOOR to the largest log-odds
    x, p = np.array([r["step"] for r in hist]), np.array([r["hits"] for r in hist], float)
    if len(x) and (x > 0).any():
        p /= p.sum()
        low, high = 1e-3, 20.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * x)).sum() < 1 else (low, mid)
        model.lam = max(low, 0.05)
    floor = 1.0 / model.lam
    clean = seen.where("toxic = 0").agg(F.sum(F.size(F.filter("s", lambda x: x >= floor))), F.sum("n")).first()
    model.k = max(1e-6, (clean[0] or 0) / max(1e-9, (clean[1] or 0) * math.exp(-model.lam * floor)))
    sample = model.lam, model.k

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(lam=sample[0], k=sample[1])
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([evidence(own, s.as_py(), n) for s, n in zip(b.column(2), b.column(1).to_pylist(), strict=True)], pa.float64()), b.column(0)], ["z", "toxic"])

    z = [(r["z"], r["toxic"]) for r in seen.where("toxic is not null").select("toxic", "n", "s").mapInArrow(lean(weigh), "z double, toxic int").collect()]  # two numbers for each sampled row
    z.sort(reverse=True)
    sent.destroy()
    drop_kept(seen)
    total, caught, best = sum(y for _, y in z), 0, (-1.0, 0.0)
    for i, (v, y) in enumerate(z):
        caught += y
        if i + 1 == len(z) or z[i + 1][0] < v:
            below = z[i + 1][0] if i + 1 < len(z) else v - 1
            best = max(best, (2 * caught / (i + 1 + total), (v + below) / 2))
    spread = np.std([v for v, _ in z]) or 1.0
    model.cut, model.slope, model.fitted = best[1], float(1.0 / spread), True
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score, evidence and passages (start and end in characters, and score) of each text."""
    need(docs, text)
    at = docs.columns.index(text)
    names = [spare(docs, x) for x in ("score", "evidence", "passages")]
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        table_ = scores(model)
        for b in batches:
            for lo, many in slices(b.column(at), ROWS, BYTES):
                part = b.slice(lo, many)
                score, ev, spans = [], [], []
                for t in part.column(at):
                    s = (t.as_py() or "").lower()
                    words = WORD.findall(s)
                    found = segments(np.fromiter(table_.of(words), float, len(words)))
                    z = evidence(model, [x for x, _, _ in found], len(words))
                    least = (math.log(max(model.k, 1e-9) * max(len(words), 1)) - math.log(E_VALUE)) / model.lam
                    found = [f for f in found if f[0] > least]
                    if found:
                        places = [(m.start(), m.end()) for m in WORD.finditer(s)]
                        found = [(places[i][0], places[j - 1][1], x) for x, i, j in found]
                    score.append(squash(model, z))
                    ev.append(z)
                    spans.append([{"start": i, "end": j, "score": x} for i, j, x in found])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64()), pa.array(ev, pa.float64()), pa.array(spans, passage)], [*b.schema.names, *names])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    return docs.mapInArrow(lean(run), f"{fields}, `{names[0]}` double, `{names[1]}` double, `{names[2]}` array<struct<start:long,end:long,score:double>>")


def held_out(doc_id, folds: int = 3, fold: int = 1):
    """Whether an id belongs to the fold that nothing is learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    out = score_documents(docs, model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence", "passages")

"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Each document is encoded whole. Every partition hands on one (length, documents) row for each length that it met, so
what is shuffled is bounded by the number of different lengths, not by documents, and no group is collected. Totals,
quantiles and truncated totals for any context limit then come from the suffix sums.

Defined cases: a null text counts as length 0, like an empty one; repeated rows count each time; an empty table has an
empty histogram; other columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, lean, need, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Lengths that share their upper bits are one bucket of the two-level suffix sum.
BUCKET_BITS = 10


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder_length(name: str = VOCABULARY) -> Callable[[str], int]:
    """Length of a whole text in tokens of the named vocabulary.

    The library's matcher overflows its stack on very long white space; such texts are cut into the same pieces here.
    """
    import public_tokenizers
    import regex

    enc, pattern, blank = _encoding(name), regex.compile(public_tokenizers.PATTERN), re.compile(r"\s{1000}")

    def measure(text: str) -> int:
        if blank.search(text):
            return sum(len(enc._encode_single_piece(p)) for p in pattern.findall(text))
        return len(enc.encode_ordinary(text))

    return measure


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, length: Callable[[str], int] | None = None) -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length."""
    need(docs, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = length or encoder_length(vocabulary)
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                s = value.as_py()
                seen[measure(s) if s else 0] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "docs"])

    part = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(lean(count), "n_tokens long, docs long")
    return part.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length n: documents and tokens at n, in documents of n or more, and what a context limit of n leaves.

    The sums run over two levels, so no window holds all lengths: within a bucket of close lengths, and over buckets.
    """
    h = histogram.withColumn("bucket", F.shiftright("n_tokens", BUCKET_BITS)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    after = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    tops = h.groupBy("bucket").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    tops = tops.select("bucket", zero(F.sum("b_docs").over(after)).alias("above_docs"), zero(F.sum("b_tokens").over(after)).alias("above_tokens"))
    totals = h.agg(zero(F.sum("docs")).alias("all_docs"), zero(F.sum("tokens")).alias("all_tokens"))
    within = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(tops, "bucket").withColumns(
        {"docs_ge": F.sum("docs").over(within) + F.col("above_docs"), "tokens_ge": F.sum("tokens").over(within) + F.col("above_tokens")}
    )
    out = out.join(F.broadcast(totals))  # one row
    return out.select(
        "n_tokens",
        "docs",
        "tokens",
        "docs_ge",
        "tokens_ge",
        (F.col("all_docs") - F.col("docs_ge") + F.col("docs")).alias("docs_le"),
        (F.col("docs_ge") - F.col("docs")).alias("docs_truncated"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        "all_docs",
        "all_tokens",
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_truncated, truncated_total) for any limits, from suffix_sums()."""
    out = None
    for limit in sorted({int(x) for x in limits}):
        over = F.col("n_tokens") > limit
        kept: Column = F.coalesce(F.sum(F.when(~over, F.col("tokens"))), F.lit(0)) + limit * F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0))
        row = sums.agg(F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).cast("long").alias("docs_truncated"), kept.cast("long").alias("truncated_total"))
        row = row.select(F.lit(limit).cast("long").alias("context_limit"), "docs_truncated", "truncated_total")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no limits")
    return out


def quantiles(sums: DataFrame, fractions: list[float]) -> DataFrame:
    """(fraction, n_tokens): the least length that at least that share of the documents does not exceed."""
    picks = [F.struct(F.lit(float(f)).alias("fraction"), F.min(F.when(F.col("docs_le") >= F.ceil(F.lit(float(f)) * F.col("all_docs")), F.col("n_tokens"))).alias("n_tokens")) for f in fractions]
    return sums.agg(F.array(*picks).alias("q")).select(F.inline("q"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    # Written, as the sums read it more than once; it has a row for each length.
    return suffix_sums(keep(length_histogram(table(spark, sf_dir, "documents")), "lengths"))

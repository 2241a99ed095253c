"""A corpus run through stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last
adds the pieces of each text: ids, n_pieces and lossless. Columns that an operator or a stage adds take another name
where ``docs`` has one like it (a ``_`` before it), and no column of ``docs`` is ever read or lost in its place. Texts
may be null or empty in any stage: they are kept, with no pieces. An empty table gives an empty table. n_chars, where it
is there, follows the text that a stage cuts.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import decontaminate, ngram_join, repeats, sentencepiece_ffbs, toxicity
from rangeloom.llm.common import keep, scratch, spare, table

#: Words of a shingle, and the similarity from which documents are near copies.
WORDS, SIMILARITY = 5, Fraction(8, 10)


#: Rows that go to a Python process at a time. Texts are long, and both sides hold a batch; Spark's own 10,000 take tens of
#: MB on each side of each process. A stage's result is planned when it is written, so the session keeps the setting.
BATCH = 2000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut."""
    _small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda i: ~toxicity.held_out(i))
    scored = toxicity.score_documents(docs, model)
    score = scored.columns[len(docs.columns)]  # the first that the operator adds, whatever its name
    return scored.where(F.col(f"`{score}`") < toxicity.CUT).select(*_own(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    _small_batches(spark)
    return ngram_join.keep_one(docs, n=WORDS, t=SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat in the corpus; a character cut in two goes whole."""
    _small_batches(spark)
    out = repeats.kept_text(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    _small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def add_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each text, and whether they decode to it."""
    _small_batches(spark)
    encoded = sentencepiece_ffbs.encode(docs)
    ids = encoded.columns[-1]
    out = sentencepiece_ffbs.decode(encoded, ids)
    decoded = F.col(f"`{out.columns[-1]}`")
    added = [F.col(f"`{ids}`"), F.size(F.col(f"`{ids}`")).alias(spare(docs, "n_pieces")), decoded.eqNullSafe(F.col("text")).alias(spare(docs, "lossless"))]
    return out.select(*_own(docs), *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("sentencepiece", add_pieces),
]

#: SQL can't express scoring, sampling and approximate matching; tests/llm hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES:
            with scratch(spark):  # what a stage writes on its way goes when its result is there
                out = stage(spark, docs, sf_dir)
                docs = keep(out, f"pipeline-{name}", None if name == STAGES[-1][0] else 1)
    return docs

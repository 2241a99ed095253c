import os
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rangeloom.llm import decontaminate, registry, repeats, toxicity

from .conftest import HARD
from .test_operators import brute_groups, brute_repeats

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert set(columns) <= set(docs.columns)
    names = ["", *[n for n, _ in corpus_pipeline.STAGES]]
    assert names[1:] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"]

    before = seen[""]
    model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"), lambda i: ~toxicity.held_out(i))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(before, model).collect()}
    assert {i for i, _ in pairs(seen[names[1]])} == {i for i, s in scores.items() if s < toxicity.CUT}

    rows = pairs(seen[names[1]])
    groups = brute_groups(rows, 5, Fraction(8, 10))
    assert {i for i, _ in pairs(seen[names[2]])} == {i for i, (_, c) in groups.items() if i == c}

    rows = pairs(seen[names[2]])
    cut = {r[0]: r[1] - r[2] for r in brute_repeats(rows)}
    kept = dict(pairs(seen[names[3]]))
    assert set(kept) == set(cut) and all(cut[i] - 6 <= len(t.encode()) <= cut[i] for i, t in kept.items())

    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stay = {i for i, _ in pairs(seen[names[4]])}
    for i, t in kept.items():
        if any(b in decontaminate.normalise(t) for b in items):
            assert i not in stay
    assert len(stay) >= 0.95 * len(kept) - len(items)

    last = seen[names[5]].collect()
    assert {r["doc_id"] for r in last} == stay and all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in last)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_hard_rows_go_through(spark, hard):
    docs = hard.drop("size")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), "pipeline-test")
    got = [r["doc_id"] for r in docs.collect()]
    assert len(got) == len(set(got) - {None}) + got.count(None) and got.count(None) == 2
    assert len(got) <= len(HARD) - 2 and all(r["lossless"] for r in docs.collect())


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(registry.ORACLE_SQL) <= names


def test_merge():
    assert repeats.merge([(5, 9), (0, 5), (20, 22)]) == [(0, 9), (20, 22)]


CLASHES = ("score", "evidence", "passages", "_score", "component_id", "n_shingles", "row", "gone", "hit_key", "item_id", "ids", "decoded", "n_pieces", "lossless", "spans", "kept", "n_bytes", "uid", "k", "t", "cuts")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_clashing_columns_change_nothing(spark):
    """Columns of any name that a stage adds are the documents' own: kept as they are, and never read for the stage's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    more = docs
    for i, c in enumerate(CLASHES):
        more = more.withColumn(c, F.lit(9 + i))
    for name, stage in corpus_pipeline.STAGES:
        plain, clashed = corpus_pipeline.keep(stage(spark, docs, SF), "test"), corpus_pipeline.keep(stage(spark, more, SF), "test")
        assert pairs(plain.orderBy("doc_id")) == pairs(clashed.orderBy("doc_id")) and plain.count() > 0
        assert {tuple(r) for r in clashed.select(*CLASHES).distinct().collect()} == {tuple(9 + i for i in range(len(CLASHES)))}
        docs, more = plain, clashed
    own = {r["doc_id"]: (r["ids"], r["n_pieces"], r["lossless"]) for r in docs.collect()}
    assert {r["doc_id"]: (r["_ids"], r["_n_pieces"], r["_lossless"]) for r in more.collect()} == own


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_empty_table_goes_through(spark, empty):
    docs = empty.drop("size")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), "test")
        assert docs.count() == 0 and set(empty.columns) - {"size"} <= set(docs.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_clears_its_tables(spark, monkeypatch):
    """Of the tables that this run names, and others may share the folder, only its result is left."""
    import types
    import uuid

    from rangeloom.llm import common

    real = uuid.uuid4
    monkeypatch.setattr(common.uuid, "uuid4", lambda: types.SimpleNamespace(hex="feedfeedfeed" + real().hex))
    out = corpus_pipeline.run(spark, SF)
    left = [x for x in os.listdir(common.shared_folder(spark).removeprefix("file://").removeprefix("file:")) if "-feedfeedfeed" in x]
    assert out.count() > 0 and len(left) == 1 and left[0].startswith("pipeline-sentencepiece")
    common.drop_kept(out)

"""Each registered query as a whole, called as the driver calls it, against plain computations of the same contract."""

import math
import os
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rangeloom.llm import decontaminate, language_id, registry, sentencepiece_ffbs, token_counts, toxicity

from .test_operators import brute_forward, brute_groups, brute_repeats, brute_segments, check_shards

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    read = lambda t: duckdb.sql(f"select * from '{SF}/{t}.parquet'").fetchall()
    return {t: read(t) for t in ("documents", "labels", "benchmark", "embeddings")}


@pytest.fixture(scope="module")
def texts(tables):
    return [(r[0], r[1]) for r in tables["documents"]]


def result(spark, n):
    name = next(x for x in entry.queries() if x.startswith(f"op{n}_"))
    return entry.queries()[name](spark, SF)


def shape(df, *columns):
    kinds = dict(df.dtypes)
    return [kinds.get(c) for c in columns]


def test_op1(spark, texts):
    df = result(spark, 1)
    assert shape(df, "doc_id", "n_shingles", "component_id") == ["bigint"] * 3
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()} == brute_groups(texts, 4, Fraction(85, 100))


def test_op2(spark, texts):
    df = result(spark, 2)
    assert shape(df, "n_bytes", "n_removed", "n_spans", "kept_sha256") == ["bigint"] * 3 + ["string"]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()]
    assert sorted(got, key=repr) == brute_repeats(texts)


def test_op3(spark, texts):
    """Whole results against sampling of each unit alone, from the lattice written out as a table of its nodes."""
    voc = sentencepiece_ffbs.vocabulary()
    got = {r["doc_id"]: (r["ids"], r["lossless"], r["n_pieces"]) for r in result(spark, 3).collect()}
    s = sentencepiece_ffbs.Sampler(voc)
    for i, t in texts:
        ids, lossless, n = got[i]
        assert lossless and n == len(ids) and sentencepiece_ffbs.decode_ids(ids, voc) == (t or "")
    for i, t in texts[:12]:
        row = sentencepiece_ffbs._row_stream([i], sentencepiece_ffbs.SEED)
        want = []
        for k, unit in enumerate(sentencepiece_ffbs.UNIT.findall(t or "")):
            stream = sentencepiece_ffbs._mix(row + np.uint64(k) * np.array([0xD1342543DE82EF95], np.uint64))
            want += s.sample_long(unit, int(stream[0]))
        assert got[i][0] == want


def test_op4(spark, texts, tables):
    found = {(r["doc_id"], r["item_id"]) for r in result(spark, 4).collect()}
    items = [(r[0], decontaminate.normalise(r[1])) for r in tables["benchmark"]]
    exact = {(d, i) for d, t in texts for i, b in items if b and b in decontaminate.normalise(t)}
    assert exact <= found and exact
    for d, i in found - exact:  # an inexact match has a window within its budget
        text, item = decontaminate.normalise(dict(texts)[d]), dict(items)[i]
        assert any(_close(w, text, decontaminate.budget(len(w))) for _, w in decontaminate.windows_of(item))


def _close(window, text, e):
    w, t = np.frombuffer(window, np.uint8), np.frombuffer(text, np.uint8)
    j = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, int)
    for i in range(len(w)):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (t != w[i]), row[1:] + 1)
        row = np.minimum.accumulate(new - j) + j
    return row.min() <= e


def test_op5(spark, texts):
    df = result(spark, 5)
    assert shape(df, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard") == ["bigint", "bigint", "bigint", "string", "int", "bigint", "int"]
    rows = df.collect()
    check_shards(rows, len(texts), 16)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))]
    assert order != sorted(order) and sorted(order) != order[::-1]


def brute_model(rows):
    """Word and prefix scores from (text, toxic), with loops."""
    y = [Counter(), Counter()]
    for t, toxic in rows:
        y[toxic].update(re.findall(r"[^\W\d_]+", (t or "").lower()))
    n = [sum(c.values()) for c in y]
    base = n[1] / (n[0] + n[1])
    logit = lambda r: max(toxicity.FLOOR, math.log(r / (1 - r)) - math.log(base / (1 - base)) - toxicity.DRIFT)
    pre = [Counter(), Counter()]
    for k in (0, 1):
        for w, c in y[k].items():
            pre[k][w[: toxicity.PREFIX]] += c
    share = {p: (pre[1][p] + toxicity.PREFIX_PRIOR * base) / (pre[1][p] + pre[0][p] + toxicity.PREFIX_PRIOR) for p in pre[0] | pre[1]}
    words = {w: logit((y[1][w] + toxicity.PRIOR * share[w[: toxicity.PREFIX]]) / (y[1][w] + y[0][w] + toxicity.PRIOR)) for w in y[0] | y[1]}
    return words, {p: logit(x) for p, x in share.items()}


def test_op6(spark, texts, tables):
    df = result(spark, 6)
    assert shape(df, "doc_id", "held_out", "score", "predicted") == ["bigint", "boolean", "double", "int"]
    got = {r["doc_id"]: r for r in df.collect()}
    assert set(got) == {i for i, _ in texts}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    # The model's scores, and each document's score from them, by loops.
    text = dict(texts)
    words, prefixes = brute_model([(text[i], toxic) for i, _, toxic in tables["labels"] if i in text and not held(i) and toxic is not None])
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, lambda i: ~toxicity.held_out(i))
    assert dict(zip(model.words[0].tolist(), model.words[1].tolist(), strict=True)) == pytest.approx({toxicity.hash_of(w): v for w, v in words.items()}, abs=1e-5)
    for i, t in texts[:60]:
        own = [words.get(w, prefixes.get(w[: toxicity.PREFIX], model.default)) for w in re.findall(r"[^\W\d_]+", (t or "").lower())][:400]
        if len(re.findall(r"[^\W\d_]+", (t or "").lower())) > 400:
            continue
        z = toxicity.evidence(model, [s for s, _, _ in brute_segments(own)], len(own))
        assert got[i]["score"] == pytest.approx(toxicity.squash(model, z), abs=2e-3)
    empty = spark.createDataFrame([(1, ""), (2, None), (3, "123")], "doc_id long, text string")
    assert len({r["score"] for r in toxicity.score_documents(empty, model).collect()}) == 1


def test_op7_sql(spark):
    name = "op7_license_scan"
    df = entry.queries()[name](spark, SF)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = c.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_op8(spark, tables):
    df = result(spark, 8)
    assert shape(df, "query_id", "rank", "vec_id", "score") == ["bigint", "int", "bigint", "double"]
    rows = {(r["query_id"], r["rank"]): r for r in df.collect()}
    ids = np.array([r[0] for r in tables["embeddings"]])
    x = np.array([r[1] for r in tables["embeddings"]], float)
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        c = x @ x[ids == q][0] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[ids == q][0])
        want = [int(i) for i in ids[np.lexsort((ids, -c))] if i != q][:5]
        own = [rows[int(q), k] for k in range(1, 6)]
        assert all(r["score"] == pytest.approx(c[ids == r["vec_id"]][0], abs=1e-12) for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hit, total = hit + len({r["vec_id"] for r in own} & set(want)), total + 5
    assert hit / total >= 0.9 and len(rows) == total


def test_op9(spark, tables):
    df = result(spark, 9)
    assert shape(df, "doc_id", "held_out", "lang_pred", "score") == ["bigint", "boolean", "string", "double"]
    got = {r["doc_id"]: r for r in df.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    docs = tables["documents"]
    assert set(got) == {r[0] for r in docs} and all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    learned = {r[2] for r in docs if r[2] is not None and not held(r[0])}
    rest = [r for r in docs if held(r[0]) and r[2] is not None and got[r[0]]["lang_pred"] != "und"]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in rest) >= 0.95 * len(rest) and rest
    for i, t, *_ in docs:
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and got[i]["lang_pred"] in learned | {"und"}


def brute_fit(rows, voc, rounds):
    """Expectation maximisation over the words of (text, lang), a path sum for each piece of each word."""
    names = sorted({x for _, x in rows})
    p = {x: np.full((len(voc) + 2, 1), 1 / (len(voc) + 1)) for x in names}
    for _ in range(rounds):
        c = {x: np.zeros(len(voc) + 1) for x in names}
        for t, x in rows:
            for w in language_id.words_of(t):
                s, own = "▁" + w, p[x]
                own[-1] = 0
                number = lambda i, k, s=s: voc.get(s[i : i + k], len(voc) if k == 1 else None)
                alpha, beta = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
                steps = [(i, k, number(i, k)) for i in range(len(s)) for k in range(1, len(s) - i + 1) if number(i, k) is not None]
                for i, k, n in steps:
                    alpha[i + k] += alpha[i] * own[n, 0]
                for i, k, n in reversed(steps):
                    beta[i] += beta[i + k] * own[n, 0]
                for i, k, n in steps:
                    c[x][n] += alpha[i] * own[n, 0] * beta[i + k] / alpha[-1]
        whole = sum(c.values()) + 0.01
        back = np.append(whole / (sum(sum(v) for v in c.values()) + 0.01 * (len(voc) + 2)), 0.01 / (sum(sum(v) for v in c.values()) + 0.01 * (len(voc) + 2)))
        for x in names:
            p[x] = ((np.append(c[x], 0) + language_id.SMOOTH * back) / (c[x].sum() + language_id.SMOOTH))[:, None]
            p[x][-1] = 0
    return names, np.concatenate([p[x] for x in names], 1)


def test_fit_and_scores_by_loops(spark):
    rows = [("the cat and the hat", "en"), ("that thing there", "en"), ("der die und das", "de"), ("die katze und der hut", "de"), ("naturellement " + "a" * 60, "fr")]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    voc = language_id.pieces()
    names, p = language_id.fit(docs)
    want_names, want = brute_fit(rows, voc, language_id.ROUNDS)
    assert names == want_names and np.allclose(p, want, rtol=1e-6, atol=1e-12)
    for r in language_id.identify(docs, names, p).collect():
        words = language_id.words_of(rows[r["doc_id"]][0])
        logs = np.array([sum(math.log(max(brute_forward(w, p[:, [k]], voc), 1e-300)) for w in words) for k in range(len(names))])
        assert r["lang_pred"] == names[int(logs.argmax())]
        assert r["score"] == pytest.approx(1 / np.exp((logs - logs.max()) / max(1.0, len(words) / 20)).sum(), rel=1e-6)


def test_op10(spark, texts):
    f = token_counts.encoder_length()
    lengths = [f(t) if t else 0 for _, t in texts]
    rows = result(spark, 10).collect()
    assert {r["n_tokens"]: (r["docs"], r["docs_ge"], r["docs_le"], r["docs_truncated"], r["truncated_total"]) for r in rows} == {
        n: (lengths.count(n), sum(x >= n for x in lengths), sum(x <= n for x in lengths), sum(x > n for x in lengths), sum(min(x, n) for x in lengths)) for n in set(lengths)
    }
    assert {(r["all_docs"], r["all_tokens"]) for r in rows} == {(len(lengths), sum(lengths))}


def test_clashing_names_in_op9_and_op10(clashing):
    rows = [("the of and", "en"), ("der die und", "de")]
    docs = clashing.sparkSession.createDataFrame(rows, "text string, lang string")
    names, p = language_id.fit(docs)
    more = clashing.withColumns({c: F.lit(1) for c in ("k", "t", "lang_pred")})
    assert language_id.identify(more, names, p).columns == ["doc_id", "lang_pred", "score"]
    more = clashing.withColumns({c: F.lit(1) for c in ("n_tokens", "docs", "tokens")})
    assert token_counts.length_histogram(more).columns == ["n_tokens", "docs"]

import collections
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import components, decontaminate, language_id, license_scan, nearest, ngram_join, repeats, sentencepiece_ffbs, sharding, token_counts, toxicity

from .conftest import HARD, SCHEMA

WORDS = [a + b for a in "ba be bi bo bu da de di do du".split() for b in "ka ke ki ko ku la le li lo lu".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, shared passages, and texts of their own."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(5, 200)) for _ in range(60)]
    passage = prose(rng, 80)
    for i in range(12):
        texts.append(prose(rng, 30 + i) + " " + passage + " " + prose(rng, 20))
    for i in range(0, 20, 2):
        w = texts[i].split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
        texts.append(texts[i])
    return [(i, t) for i, t in enumerate(texts)] + [(900, ""), (901, None), (902, "ka"), (903, "ka"), (904, "x" * 300)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)


# 10

def brute_counts(lengths):
    return {n: (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths)) for n in set(lengths)}


def test_token_counts(spark, docs, corpus):
    f = token_counts.encoder_length()
    lengths = [f(t) if t else 0 for _, t in corpus]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs))
    got = {r["n_tokens"]: (r["docs"], r["docs_ge"], r["tokens_ge"], r["truncated_total"]) for r in sums.collect()}
    assert got == brute_counts(lengths)
    cut = {r["context_limit"]: (r["docs_truncated"], r["truncated_total"]) for r in token_counts.truncated_totals(sums, [1, 50, 10**6]).collect()}
    assert cut == {n: (sum(x > n for x in lengths), sum(min(x, n) for x in lengths)) for n in (1, 50, 10**6)}
    q = {r["fraction"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()}
    assert q == {0.5: sorted(lengths)[math.ceil(len(lengths) * 0.5) - 1], 1.0: max(lengths)}


def test_token_counts_many_buckets(spark):
    lengths = [random.Random(1).randrange(0, 9000) for _ in range(400)]
    h = spark.createDataFrame(list(collections.Counter(lengths).items()), "n_tokens long, docs long")
    assert {r["n_tokens"]: (r["docs"], r["docs_ge"], r["tokens_ge"], r["truncated_total"]) for r in token_counts.suffix_sums(h).collect()} == brute_counts(lengths)


def test_token_counts_hard(hard, empty):
    assert sum(r["docs"] for r in token_counts.suffix_sums(token_counts.length_histogram(hard)).collect()) == len(HARD)
    assert token_counts.suffix_sums(token_counts.length_histogram(empty)).count() == 0
    f = token_counts.encoder_length()
    assert f("x" + " " * 3001 + "y z") == len(token_counts._encoding(token_counts.VOCABULARY).encode_ordinary("x" + " " * 3001 + "y z"))


# 5

def check_shards(rows, n_rows, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == n_rows
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding(spark, docs, corpus):
    one = sharding.external_shuffle(docs, 16, bucket_bytes=2000)
    rows = one.collect()
    check_shards(rows, len(corpus), 16)
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _ in corpus)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.external_shuffle(docs.repartition(3), 16, bucket_bytes=2000).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    other = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.external_shuffle(docs, 16, bucket_bytes=2000, seed=1).collect()}
    assert other != again


def test_sharding_hot_key(spark):
    rows = [(1, "same")] * 700 + [(None, "n")] * 300 + [(1, f"t{i}") for i in range(200)] + [(i, "u") for i in range(2, 800)]
    out = sharding.external_shuffle(spark.createDataFrame(rows, "doc_id long, text string"), 7, bucket_bytes=500)
    got = out.collect()
    check_shards(got, len(rows), 7)
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)


def test_sharding_hard(clashing, empty, tmp_path):
    out = sharding.external_shuffle(clashing, 3)
    assert out.columns == [*clashing.columns, "_size", "_shard", "_slot"] and out.count() == len(HARD)
    assert sharding.external_shuffle(empty, 3).count() == 0
    sharding.write_shards(out, str(tmp_path / "s"), "_shard", "_slot")
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["_shard=0", "_shard=1", "_shard=2"]


# 6

def brute_segments(v):
    """Maximal-scoring segments by repeated search for the best one."""
    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            s = 0
            for j in range(i, hi):
                s += v[j]
                if s > 1e-12 and (top is None or s > top[0] + 1e-9):
                    top = (s, i, j + 1)
        return [] if top is None else [*best(lo, top[1]), top, *best(top[2], hi)]

    return best(0, len(v))


def test_segments():
    rng = random.Random(2)
    for _ in range(200):
        v = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 100 for _ in range(rng.randrange(0, 25))]
        got = [(i, j) for _, i, j in toxicity.segments(np.array(v))]
        assert got == [(i, j) for _, i, j in brute_segments(v)]


def toxic_corpus():
    rng, rows, labels = random.Random(4), [], []
    for i in range(600):
        w = prose(rng, rng.randrange(20, 120)).split()
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = rng.choices(["vile", "scorn", "filth", "mud"], k=6)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab, lambda i: ~toxicity.held_out(i))
    out = toxicity.score_documents(docs, model).collect()
    rest = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = sum((r["score"] >= toxicity.CUT) == (r["doc_id"] % 5 == 0) for r in rest)
    assert right / len(rest) > 0.97 and all(0 <= r["score"] <= 1 for r in out)
    text = dict(rows)
    found = [text[r["doc_id"]][p["start"] : p["end"]] for r in rest for p in r["passages"] if r["doc_id"] % 5 == 0]
    assert found and sum(any(x in f for x in ("vile", "scorn", "filth", "mud")) for f in found) / len(found) > 0.9
    only = toxicity.fit(docs, lab.where("toxic = 0"), lambda i: ~toxicity.held_out(i))
    assert {r["score"] for r in toxicity.score_documents(docs, only).collect()} == {0.0}


def test_toxicity_hard(spark, clashing, empty):
    lab = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (6, None, None), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(clashing, lab, lambda i: F.lit(True))
    out = toxicity.score_documents(clashing, model)
    assert out.count() == len(HARD) and out.columns[-3:] == ["_score", "_evidence", "_passages"]
    assert toxicity.score_documents(empty, model).count() == 0
    assert not toxicity.fit(empty, lab, lambda i: F.lit(True)).fitted


# 9

def brute_forward(word, p, voc):
    s = language_id.MARK + word
    alpha = [1.0] + [0.0] * len(s)
    for e in range(1, len(s) + 1):
        for k in range(1, min(e, max(map(len, voc))) + 1):
            n = voc.get(s[e - k : e], len(voc) if k == 1 else None)
            if n is not None:
                alpha[e] += alpha[e - k] * p[n, 0]
    return alpha[-1]


def test_forward_sums_all_segmentations():
    voc = language_id.pieces()
    p = np.random.default_rng(1).random((len(voc) + 2, 1)) / 100
    p[-1] = 0
    words = ["the", "language", "été", "漢a", "zzzzqqqq", "a"]
    ids, n = language_id.lattice(words, voc)
    got = language_id.forward(ids, p)[np.arange(len(words)), n, 0]
    assert got == pytest.approx([brute_forward(w, p, voc) for w in words])
    into = np.zeros(p.shape)
    language_id.expected(ids, n, p, np.zeros(len(words), int), np.ones(len(words)), into)
    assert sum(into[v, 0] * len(x) for x, v in voc.items()) + into[len(voc), 0] == pytest.approx(sum(len(w) + 1 for w in words))


def test_long_words_sum_all_segmentations():
    """Beyond SHORT letters, too: the rolling sums are those of the whole lattice, with pieces of every length."""
    voc = language_id.pieces()
    rng = random.Random(5)
    p = np.random.default_rng(2).random((len(voc) + 2, 2)) / 10
    p[-1] = 0
    longest = max(voc, key=len)
    words = [longest.removeprefix("▁") * 8, "".join(rng.choices("abcdeé漢", k=120)), "international" * 5]
    assert len(longest) == language_id.piece_table().longest > 12 and all(len(w) > language_id.SHORT for w in words)
    for w in words:
        ids, n = language_id.lattice([w], voc)
        want = language_id.forward(ids, p)[0, n[0]]
        assert language_id.forward_long(w, p) == pytest.approx(np.log(want))
        assert want[0] == pytest.approx(brute_forward(w, p, voc))
        one, two = np.zeros(p.shape), np.zeros(p.shape)
        language_id.expected(ids, n, p, np.array([1]), np.array([3.0]), one)
        language_id.expected_long(w, p, 1, 3.0, two)
        assert two == pytest.approx(one, abs=1e-9)
    assert np.isfinite(language_id.forward_long("x" * 70_000, p)).all()


def test_only_letters_are_words():
    assert language_id.words_of("½ ² Ⅷ 12_3") == [] and language_id.words_of("İa b2c") != []
    assert language_id.words_of("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and language_id.words_of("Don't été") == ["don", "t", "été"]


def test_language_id(spark, hard, empty):
    rng = random.Random(8)
    a, b = "the of and to in that is was".split(), "der die und das ist nicht ein zu".split()
    rows = [(i, " ".join(rng.choices(a if i % 2 else b, k=12)), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, p = language_id.fit(docs.where("doc_id < 100"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, names, p).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    out = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in language_id.identify(hard, names, p).collect()}
    assert {(3, True, True), (4, True, True), (5, True, True)} <= out and (7, False, False) in out
    none, q = language_id.fit(empty)
    assert none == [] and {r["lang_pred"] for r in language_id.identify(hard, none, q).collect()} == {"und"}
    assert language_id.identify(empty, names, p).count() == 0


# 8

def test_nearest_against_brute(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:120] = x[7]
    x[200] = 2 * x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1050, [None] + [1.0] * 15), (1100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = collections.defaultdict(list)
    for r in nearest.search(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(float)
    hit = 0
    for q in range(0, 400, 50):
        c = (y @ y[q]) / np.linalg.norm(y, axis=1) / np.linalg.norm(y[q])
        want = [i for i in np.lexsort((np.arange(400), -np.round(c, 10))) if i != q][:5]
        hit += len({int(i) for i in want} & {i for i, _ in got[q]})
        assert all(s == pytest.approx(c[i]) for i, s in got[q]) and len(got[q]) == 5
    assert [i for i, _ in got[50]] == [7, 51, 52, 53, 54]
    assert sorted(got) == list(range(0, 400, 50)) and hit >= 36


def test_nearest_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in nearest.search(df, lambda i: i == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest.search(df.where("false"), lambda i: i == 0).count() == 0


# 4

def edits(window, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(window):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute(spark, empty, hard):
    rng = random.Random(6)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(6, None), (7, "short"), (8, "")]
    rows = []
    for i in range(40):
        t = prose(rng, 40)
        if i % 4 == 0:
            w = list(items[i % 6][1])
            for _ in range(rng.randrange(0, 16)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            t = t[:100] + " " + "".join(w).upper() + "\n\t " + t[100:]
        rows.append((i, t))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    want = set()
    for d, t in rows:
        for i, b in items:
            for _, w in decontaminate.windows_of(decontaminate.normalise(b)):
                if edits(w.decode(), decontaminate.normalise(t).decode()) <= decontaminate.budget(len(w)):
                    want.add((d, i))
    assert got == want and len(want) >= 8
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.clean(hard, bench).count() == len(HARD)
    clash = docs.withColumns({c: F.lit(1) for c in ("hit_key", "k", "t", "item_id", "n_windows")})
    assert {r["doc_id"] for r in decontaminate.clean(clash, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    twice = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs.union(docs), bench).collect()}
    assert twice == got
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(docs, bench.where("false")).count() == 0


def test_short_items_are_found_whole_words(spark):
    items = [(1, "What is 17 times 23? 391"), (2, "yes"), (3, "What is the capital of France?"), (4, "YES "), (5, "été"), (6, "  ")]
    rows = [(1, "a b. what is  17\ntimes 23? 391, said he"), (2, "Yesterday eyes yes2"), (3, "oh yes!"), (4, "so what is the capital of france?"), (5, "l'été"), (6, "étés"), (7, None), (8, "what is 17 times 23? 3910")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (3, 2), (3, 4), (4, 3), (5, 5)}


def test_long_texts_and_common_grams(monkeypatch):
    """Texts in parts and postings in portions give what one buffer gives."""
    rng = random.Random(8)
    items = [(i, prose(rng, 40).encode()) for i in range(4)] + [(9, (b"ab" * 60))]
    text = prose(rng, 900) + items[0][1].decode() + " " + prose(rng, 300) + " " + items[2][1].decode() + " ab" * 5 + "ab" * 400
    index = decontaminate.Index(items)

    def found():
        out = set()
        for buffer, places in decontaminate.parts_of(pa.array([text, None, "x", text])):
            for w, end, e in index.search(buffer):
                begin, stop, row, at, _ = [x for x in places if x[0] < end][-1]
                if end <= stop:
                    out.add((row, w, at + end - begin, e))
        return out

    whole = found()
    assert {w for _, w, _, _ in whole} >= {i for i, (item, _, _) in enumerate(index.windows) if item in (0, 2, 9)}
    monkeypatch.setattr(decontaminate, "BUFFER", 1000)
    monkeypatch.setattr(decontaminate, "POSTINGS", 50)
    assert {(r, w) for r, w, _, _ in found()} == {(r, w) for r, w, _, _ in whole}


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(300):
        w = bytes(rng.choices(b"abc", k=rng.randrange(9, 30)))
        v = bytearray(w)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(v))
            v[at : at + rng.randrange(2)] = bytes(rng.choices(b"abcd", k=rng.randrange(2)))
        region = bytes(rng.choices(b"abc", k=rng.randrange(6))) + bytes(v) + bytes(rng.choices(b"abc", k=rng.randrange(6)))
        e = edits(w.decode(), region.decode())
        got = decontaminate.align(w, region, 8)
        assert (got is None and e > 8) or got[0] == e


# 3

def test_sentencepiece_lossless_and_keyed(spark, clashing, empty):
    out = sentencepiece_ffbs.decode(sentencepiece_ffbs.encode(clashing), "_ids")
    got = out.select("doc_id", "text", "_ids", "_decoded").collect()
    assert len(got) == len(HARD) and all(r["text"] == r["_decoded"] and (r["text"] is None) == (r["_ids"] is None) for r in got)
    a = {r["doc_id"]: r["ids"] for r in sentencepiece_ffbs.encode(clashing.select("doc_id", "text").where("doc_id > 1").repartition(5)).collect()}
    assert all(a[r["doc_id"]] == r["_ids"] for r in got if (r["doc_id"] or 0) > 1)
    assert len({tuple(r["_ids"]) for r in got if r["doc_id"] in (1, 2)}) == 2
    assert sentencepiece_ffbs.encode(empty).count() == 0


def test_sampling_follows_path_weights():
    voc = sentencepiece_ffbs.vocabulary()
    s = sentencepiece_ffbs.Sampler(voc)
    s.learn({"then"})
    paths = {}

    def walk(at, ids, w):
        if at == 4:
            paths[tuple(ids)] = w
        for k in range(1, 5 - at):
            p = voc.ids.get("then"[at : at + k])
            if p is not None:
                walk(at + k, [*ids, p], w * voc.weight[p])

    walk(0, [], 1.0)
    n = 200_000
    ids, count = s.sample(np.full(n, s.known["then"]), sentencepiece_ffbs._mix(np.arange(n, dtype=np.uint64)))
    at, seen = np.concatenate(([0], np.cumsum(count))), collections.Counter()
    for i in range(n):
        seen[tuple(ids[at[i] : at[i + 1]].tolist())] += 1
    total = sum(paths.values())
    assert set(seen) <= set(paths)
    for path, w in paths.items():
        assert seen[path] / n == pytest.approx(w / total, abs=0.005)


def test_long_units_follow_path_weights():
    """A run beyond SHORT characters is one lattice: the paths of its first characters have the chances of the whole."""
    voc = sentencepiece_ffbs.vocabulary()
    s = sentencepiece_ffbs.Sampler(voc)
    unit = "then" * 14  # 56 characters, and every path over it counts
    assert len(unit) > sentencepiece_ffbs.SHORT and sentencepiece_ffbs.UNIT.findall("a " + unit + " b") == ["a", " " + unit, " b"]
    alpha = [1.0]
    for e in range(1, len(unit) + 1):
        alpha.append(sum(alpha[e - k] * voc.weight[voc.ids[unit[e - k : e]]] for k in range(1, min(e, voc.longest) + 1) if unit[e - k : e] in voc.ids))
    beta = [0.0] * len(unit) + [1.0]
    for a in reversed(range(len(unit))):
        beta[a] = sum(beta[a + k] * voc.weight[voc.ids[unit[a : a + k]]] for k in range(1, voc.longest + 1) if a + k <= len(unit) and unit[a : a + k] in voc.ids)
    assert alpha[-1] == pytest.approx(beta[0])
    n, seen = 3000, collections.Counter()
    for i in range(n):
        ids = s.sample_long(unit, int(sentencepiece_ffbs._mix(np.array([i], np.uint64))[0]))
        assert b"".join(voc.text[x] for x in ids).decode() == unit
        seen[ids[0]] += 1
    for k in range(1, voc.longest + 1):
        x = voc.ids.get(unit[:k])
        if x is not None:
            assert seen[x] / n == pytest.approx(voc.weight[x] * beta[k] / beta[0], abs=0.04)


def test_blank_runs_and_scripts_without_blanks_are_whole_units():
    voc = sentencepiece_ffbs.vocabulary()
    s = sentencepiece_ffbs.Sampler(voc)
    texts = [" " * 16 + "x", "漢字" * 300, "a" + " " * 70, "▁ ▁▁a"]
    assert [len(sentencepiece_ffbs.UNIT.findall(t)) for t in texts] == [1, 1, 2, 5]
    ids, count = sentencepiece_ffbs.segment(texts, [1, 2, 3, 4], s)
    at = np.concatenate(([0], np.cumsum(count)))
    assert [sentencepiece_ffbs.decode_ids(ids[at[i] : at[i + 1]].tolist(), voc) for i in range(4)] == texts
    used = {len(voc.text[x]) for seed in range(60) for x in sentencepiece_ffbs.segment(texts[:1], [seed], s)[0].tolist()}
    assert max(used) == 16  # the longest piece of the vocabulary is reached


# 1

def brute_groups(rows, n, t):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) * t.denominator >= t.numerator * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n,t", [(4, Fraction(85, 100)), (5, Fraction(8, 10))])
def test_ngram_join_against_brute(docs, corpus, n, t):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(docs, n=n, t=t).collect()}
    assert got == brute_groups(corpus, n, t)
    assert len({c for _, c in got.values()}) < len(corpus) - 10


def test_ngram_join_chain_of_near_copies(spark):
    """Neighbours link, ends do not: one group by reachability."""
    rng = random.Random(9)
    w, rows = prose(rng, 120).split(), []
    for i in range(25):
        rows.append((i, " ".join(w)))
        w[rng.randrange(len(w))] = f"new{i}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows, 4, Fraction(85, 100))


def test_ngram_join_hard(clashing, empty):
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_groups(clashing).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 4), (None, None)} <= got
    assert ngram_join.near_groups(empty).count() == 0
    kept = sorted((r["doc_id"] or 0) for r in ngram_join.keep_one(clashing).collect())
    assert kept == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9]


def test_ngram_join_null_and_repeated_ids(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(None, a), (None, a), (None, None), (1, a), (1, a + " ka"), (1, b), (2, a), (2, c), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.near_groups(docs).collect()]
    assert got.count((None, None)) == 3 and len(got) == 6
    kept = Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect())
    assert kept == Counter([(None, a), (None, a), (None, None), (1, a + " ka"), (1, b), (2, c), (3, "")])


def test_components_path(spark):
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


# 2

def brute_repeats(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        spans = repeats.merge([(k, k + length) for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1])
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + b[at:s], e
        kept += b[at:]
        out.append((i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeated(df):
    out = repeats.dedup(df.select("doc_id", "text"))
    return sorted([(r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out.collect()], key=repr)


def test_repeats_against_brute(spark, docs, corpus):
    got = repeated(docs)
    assert got == brute_repeats(corpus) and sum(x[2] for x in got) > 1000


def test_repeats_edges(spark):
    """Repeats just at and around the length, periodic text, and cuts inside characters."""
    rng = random.Random(7)
    rows, at = [], 0
    for length in (198, 199, 200, 201, 215, 260, 400, 700):
        s = "".join(rng.choice("abcdé") for _ in range(length))
        for _ in range(2):
            rows.append((at, "".join(rng.choice("vwxyz") for _ in range(rng.randrange(0, 150))) + s + "".join(rng.choice("vwxyz") for _ in range(rng.randrange(0, 150)))))
            at += 1
    rows += [(at, "ab" * 300), (at + 1, "é" * 150), (at + 2, "q" * 199), (at + 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert repeated(df) == brute_repeats(rows)
    text = {r["doc_id"]: r["text"] for r in repeats.kept_text(df).collect()}
    assert text[at] == "" and text[at + 2] == "q" * 199


def test_repeats_hard(hard, clashing, empty):
    assert repeated(hard) == brute_repeats([(r[0], r[1]) for r in HARD])
    assert repeats.dedup(clashing).columns[-3:] == ["_n_bytes", "_spans", "_kept"] and repeats.dedup(empty).count() == 0


# 7

def test_license_scan(spark, clashing, empty):
    rows = [(1, "x\nThis work is licensed under the GNU General Public License, version 3.\ny"), (2, "MIT license mit LICENSE"), (3, "Licensed under CC BY-NC 4.0."), (4, "the apache\nlicense"), (5, None), (6, "permission is hereby granted free of charge to any person obtaining a copy of this software and documentation files"), (7, "a license to kill")]
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (14, 1, 7, 7, "gpl", "gpl,gpl-3.0")
    assert got[2] == (4, 2, 0, 2, "mit", "mit")
    assert got[3] == (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc-4.0,cc-by-sa-4.0")  # five of six words of the other template
    assert got[4] == (3, 1, 1, 1, "apache", "apache") and got[5] == (0, 0, None, None, "", "")
    assert got[6][4:] == ("", "mit-text") and got[7][4:] == ("", "")
    assert license_scan.scan(clashing).count() == len(HARD) and license_scan.scan(empty).count() == 0


WRAPPED = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal""",
    "bsd-3-clause": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:""",
    "mpl-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
}


def test_license_scan_wrapped_notices(spark):
    rows = [(i, f"some words before\n{v}\nand after") for i, v in enumerate(WRAPPED.values())]
    rows += [(10 + i, re.sub(r"\s+", "\n", v)) for i, v in enumerate(WRAPPED.values())]  # a word a line
    rows += [(20 + i, v.replace("\n", "\n" + "other words in between " * 20 + "\n")) for i, v in enumerate(WRAPPED.values())]
    rows += [(30, "the quick fox\n" * 3000 + WRAPPED["bsd-3-clause"] + "\nthe lazy dog" * 3000)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    labels = list(WRAPPED)
    assert [got[i] for i in range(3)] == labels and [got[10 + i] for i in range(3)] == labels
    assert [got[20 + i] for i in range(3)] == ["", "", ""]  # words apart are no notice
    assert got[30] == "bsd-3-clause"


NOTICES = {
    "mit-permission,mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache,apache-2.0,apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl,gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice",
}


def test_license_scan_full_notices_in_any_wrap(spark):
    """Comment marks and widths of lines don't matter; words scattered over a long line are no notice."""
    import textwrap

    rows, want = [], {}
    for label, notice in NOTICES.items():
        for width, mark in ((40, ""), (60, "# "), (72, " * "), (10**6, "")):
            i = len(rows)
            rows.append((i, "import os\n\n" + "\n".join(mark + x for x in textwrap.wrap(notice, width)) + "\n\ndef main(): pass"))
            want[i] = label
    rng = random.Random(3)
    for label, notice in NOTICES.items():
        i = len(rows)
        rows.append((i, " ".join(prose(rng, 12) + " " + w for w in notice.split())))
        want[i] = ""
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_license_scan_unlike_rows_of_an_id(spark):
    rows = [(1, "Released under the MIT License"), (1, "nothing"), (None, "licensed under cc by nc 4.0"), (None, "nothing")]
    got = sorted((repr(r["doc_id"]), r["labels"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", ""), ("1", "mit,mit-release"), ("None", ""), ("None", "cc-by,cc-by-nc-4.0,cc-by-sa-4.0")]


def brute_windows(text, templates, threshold):
    """Labels held by a run of as many words as the template has, over the threshold."""
    split = lambda x: [w for w in re.split(license_scan.GAP, x.lower()) if w]
    a, out = split(text), set()
    for label, v in templates.items():
        t, span = set(split(v)), -(-len(split(v)) * 100 // threshold)
        blocks = [a[i : i + span] for i in range(len(a))]
        if any(100 * len(t & set(b)) >= threshold * len(t) for b in blocks):
            out.add(label)
    return out


def test_license_scan_windows_against_brute(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        w = " ".join(rng.choice(list(license_scan.TEMPLATES.values())) for _ in range(2)).split()
        for _ in range(rng.randrange(9)):
            w.insert(rng.randrange(len(w)), rng.choice(["the", "ka", "of", "la"])) if rng.random() < 0.6 else w.pop(rng.randrange(len(w)))
        rows.append((i, "".join(x + rng.choice("   \n") for x in w)))
    got = {(r["doc_id"], r["label"]) for r in license_scan.template_matches(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.TEMPLATES).collect()}
    assert got == {(i, x) for i, text in rows for x in brute_windows(text, license_scan.TEMPLATES, license_scan.THRESHOLD)}


def test_native_plans_have_no_python(spark, hard):
    for df in (license_scan.scan(hard), sharding.external_shuffle(hard)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_schema_of_fixture():
    assert SCHEMA.startswith("doc_id")


# Very long texts, ties and repeats

def test_repeats_over_the_parts_of_long_texts(spark):
    """Texts longer than a part, with repeats across its border, in periods, and in single windows."""
    rng = random.Random(11)
    assert repeats.PART == 1 << 18
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    shared = noise(1500)
    one = noise(repeats.PART - 700) + shared + noise(2000) + "xy" * 300 + noise(500)
    two = noise(100) + shared[100:900] + noise(100) + one[5000:5200] + noise(50)
    rows = [(1, one), (2, two), (3, noise(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeated(df)
    assert got == brute_repeats(rows) and {x[0]: x[3] for x in got}[1] >= 3


def test_long_texts_of_pieces_and_languages(spark):
    text = "漢字仮名交じり文" * 6000 + " end"
    assert len(text) > sentencepiece_ffbs.PART
    df = spark.createDataFrame([(1, text), (2, "x" * 40_000)], "doc_id long, text string")
    got = sentencepiece_ffbs.decode(sentencepiece_ffbs.encode(df)).collect()
    assert all(r["decoded"] == r["text"] for r in got)
    names, p = language_id.fit(spark.createDataFrame([("the of and to", "en"), ("漢字 仮名", "ja")], "text string, lang string"))
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, names, p).collect()}[1] == "ja"


def test_short_items_where_parts_of_a_text_meet():
    """A word cut in two by parts is no item, and one that stands there is found once."""
    index = decontaminate.Index([(1, b"yes")])
    half = decontaminate.BUFFER
    for at in (half - 2, half - 1, half, half + 98, half + 100, half + 199):
        for word, want in ((" yes ", 1), ("eyes ", 0), (" yest", 0)):
            text = "-" * at + word + "-" * 3000
            places_of = []
            for buffer, places in decontaminate.parts_of(pa.array([text])):
                for item, start, end in index.search_short(buffer):
                    begin, stop, _, lo, final = [x for x in places if x[0] < end][-1]
                    if end <= stop and (not lo or start - begin >= 100) and (final or start - begin < half + 100):
                        places_of.append(lo + start - begin)
            assert places_of == [at + 1] * want


def test_nearest_repeated_ids_and_lengths(spark):
    """An id with several vectors counts with the best, is never its own neighbour, and other lengths take no part."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in nearest.search(df, lambda i: i == 0).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 4)]


def test_ties_of_templates(spark):
    """Templates that a block holds alike all count, and the score is that of the best."""
    rows = [(1, "licensed under cc by 4 0"), (2, "licensed under cc by nc 4 0")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("cc-by,cc-by-nc-4.0,cc-by-sa-4.0", 1.0), 2: ("cc-by,cc-by-nc-4.0,cc-by-sa-4.0", 1.0)}
    found = {(r["doc_id"], r["label"]): r["shared"] / r["size"] for r in license_scan.template_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, "cc-by-nc-4.0"): 6 / 7, (1, "cc-by-sa-4.0"): 6 / 7, (2, "cc-by-nc-4.0"): 1.0, (2, "cc-by-sa-4.0"): 6 / 7}


def test_large_group_around_the_threshold(spark):
    """Copies of one text with 0 to 12 changed words each: some link, some don't, and no link between unlike texts is lost."""
    rng = random.Random(21)
    base = prose(rng, 110).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4, 6, 12])):
            w[rng.randrange(len(w))] = f"own{rng.randrange(10**9)}"
        rows.append((1000 - i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_groups(rows, 4, Fraction(85, 100))
    assert got == want and 3 < len({c for _, c in want.values()}) < 150

import os
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import sealing, text as tx
from rangeloom.operators import bundle, campaign, events, folds, ranges, staircase
from rangeloom.plans import cost, gate
from rangeloom.sources import archive, sealed, tensorfile


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_touching(spark):
    df = spark.createDataFrame([(0, 5), (5, 8), (10, 12), (11, 20), (30, 30)], "start long, end long")
    assert rows(ranges.merge_ranges(df)) == [(0, 8), (10, 20), (30, 30)]
    assert rows(ranges.merge_ranges_by_tile(df, 7)) == [(0, 8), (10, 20), (30, 30)]


def test_overlap_matches_nested_loop(spark):
    rng = random.Random(1)
    units = [(i * 10, i * 16, 16) for i in range(50)]
    spans = [(a, a + rng.randrange(0, 60)) for a in (rng.randrange(0, 780) for _ in range(8))]
    got = rows(ranges.overlapping_units(spark.createDataFrame(units, "off long, dst long, rlen long"), spark.createDataFrame(spans, "start long, end long"), 16))
    assert got == sorted(u for u in units if any(lo < hi and u[1] < hi and u[1] + u[2] > lo for lo, hi in spans))


@pytest.mark.parametrize("total,target", [(100, 30), (10, 30), (2**20, 4096), (7, 1), (0, 5)])
def test_even_split(spark, total, target):
    got = spark.range(1).select(F.inline(ranges.even_split(F.lit(total).cast("long"), target))).collect()
    assert sum(r["len"] for r in got) == total
    at = 0
    for r in sorted(got, key=lambda r: r["off"]):
        assert r["off"] == at
        at += r["len"]


def test_complement_refuses_overlap(spark):
    good = spark.createDataFrame([("m", 2, 5), ("m", 5, 7)], "member string, start long, end long")
    assert rows(ranges.complement(good, 10, ["member"]).select("start", "end", "kind")) == [(0, 2, "clear"), (2, 5, "payload"), (5, 7, "payload"), (7, 10, "clear")]
    with pytest.raises(Exception, match="overlap"):
        ranges.complement(spark.createDataFrame([("m", 2, 5), ("m", 4, 7)], "member string, start long, end long"), 10, ["member"]).collect()


def model_runs(chunks, target):
    out, cur = [], None
    for off, clen in chunks:
        if cur is not None:
            gap, grown = off - (cur[0] + cur[1]), off + clen - cur[0]
            if gap >= 0 and grown <= 32 << 20 and grown <= max(target, (cur[1] + clen) * 5 // 4):
                cur[1], cur[2], cur[3] = grown, cur[2] + clen, cur[3] + 1
                cur = None if cur[1] >= target else cur
                continue
        cur = [off, clen, clen, 1]
        out.append(cur)
        cur = None if clen >= target else cur
    return [tuple(x) for x in out]


def test_runs_match_model(spark):
    rng, at, chunks = random.Random(3), 0, []
    for _ in range(60):
        at += rng.choice([0, 0, 5, 300])
        chunks.append((at, rng.randrange(1, 200)))
        at += chunks[-1][1]
    df = spark.createDataFrame([("a", *c) for c in chunks], "g string, off long, clen long")
    got = [tuple(r)[2:] for r in folds.coalesce_runs(df, ["g"], 500).orderBy("run").collect()]
    assert got == model_runs(chunks, 500)


def test_budget_windows_oversized(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 15), ("a", 15, 60), ("a", 60, 62)], "g string, start long, end long")
    assert rows(folds.budget_windows(df, ["g"], 20)) == [("a", 0, 0, 15, 2), ("a", 1, 15, 60, 1), ("a", 2, 60, 62, 1)]


N, C = 10**9, 670 * 10**6
CASES = [(1, 1e9, 10e9, C, None), (2, 1e6, 1e12, C, None), (3, 10e9, 1e9, N // 100, None), (4, 1e9, 1.02e9, C, None), (5, 1e9, None, C, None), (6, 1e9, 1e9, None, None), (7, 1e9, 2e9, C, 1e9)]


def test_read_plan_cases(spark):
    df = spark.createDataFrame([(i, N, s, d, c, w, None) for i, s, d, c, w in CASES], "case_id int, plain long, source double, decode double, coded long, expand_write double, decrypt double")
    r = cost.routes(cost.read_stages(df))
    got = {x["case_id"]: x for x in cost.decide(r).collect()}
    assert got[1]["chosen"] == "coded" and got[1]["confident"]
    assert got[2]["speedup"] == pytest.approx(N / C)
    assert got[3]["chosen"] == "plain" and got[3]["speedup"] < 1
    assert got[4]["chosen"] == "plain" and not got[4]["confident"]
    assert got[5]["speedup"] is None and not got[5]["confident"]
    assert got[6]["speedup"] is None
    slow = {(x["case_id"], x["route"]): x["seconds"] for x in r.collect()}
    assert slow[7, "expand"] == max(v for (c, _), v in slow.items() if c == 7)


def test_gate_golden(spark):
    p = {r["device"]: r for r in gate.predict(gate.devices(spark), gate.kernels(spark)).collect()}
    assert p["RTX 5080 (dGPU)"]["shmem"] == 31744 and p["RTX 5080 (dGPU)"]["blocks"] == 3
    assert p["RTX 5080 (dGPU)"]["lo"] == pytest.approx(420.421, abs=1e-3)
    assert (p["Apple M4 (unified)"]["lo"], p["Apple M4 (unified)"]["hi"]) == pytest.approx((25.804, 29.990), abs=1e-3)
    assert p["Strix Halo (unified)"]["hi"] == pytest.approx(112.112, abs=1e-3) and p["Strix Halo (unified)"]["lo"] == 0


def test_events_order(spark):
    e = spark.createDataFrame([(1, "b", 1, 0), (1, "a", 2, 1), (1, "b", 3, 2), (2, "a", 1, 3), (2, "b", 2, 4)], "run int, event string, at int, id int")
    f = events.first_events(e, "run", "event", "at", "id")
    assert rows(events.order_violations(f, "run", "event", "at", "id", ["a", "b"]).select("run", "event")) == [(1, "a")]
    assert rows(events.phases(f, "run", "event", "at", "id", ["a", "b"], ["b"])) == [(1, "a", None), (2, "b", "b")]


@pytest.mark.parametrize("cap,units,clean", [(6, 2, True), (8, 2, True), (40, 10, True), (30, 10, True), (20, 10, True), (201, 84, False)])
def test_staircase(spark, cap, units, clean):
    grid = [*range(1, 65), *range(66, 201, 2), *range(204, 700, 4)]
    pts = [("s", g, 10.0 * -(-g // cap) * (1 + 0.002 * min(g, cap)), units) for g in grid]
    got = staircase.analyze(spark.createDataFrame(pts, "shape string, g int, ms double, units int"), ["shape"], "g", "ms", "units").first()
    assert got["clean"] == clean


def test_archive_round_trip(spark, tmp_path):
    data = [("a", os.urandom(1000) + b"x" * 5000), ("b", b"hello " * 3000)]
    path = str(tmp_path / "x.rloom")
    index = archive.encode(data, path, chunk=1024)
    archive.register(spark)
    plain = b"".join(d for _, d in data)
    read = lambda **o: b"".join(r["content"] for r in sorted(spark.read.format("rangeloom_archive").options(**o).load(path).collect(), key=lambda r: r["start"]))
    assert read() == plain
    assert read(start=1500, end=9001, target=2048) == plain[1500:9001]
    with pytest.raises(ValueError, match="not declared"):
        archive.encode(data, str(tmp_path / "y"), speed=3)
    raw = bytearray((tmp_path / "x.rloom").read_bytes())
    raw[index["chunks"][2][0] + 12] ^= 1
    (tmp_path / "x.rloom").write_bytes(bytes(raw))
    with pytest.raises(Exception):  # noqa: B017
        read()


def test_tensor_header(spark):
    import json
    import struct

    head = json.dumps({"__metadata__": {}, "w": {"dtype": "BF16", "shape": [2, 3], "data_offsets": [0, 12]}, "b": {"dtype": "F32", "shape": [1], "data_offsets": [12, 16]}}).encode()
    df = spark.createDataFrame([("p", bytearray(struct.pack("<Q", len(head)) + head + bytes(16)))], "path string, content binary")
    base = 8 + len(head)
    assert rows(tensorfile.tensors(df).select("name", "start", "end")) == [("b", base + 12, base + 16), ("w", base, base + 12)]
    bad = spark.createDataFrame([("p", bytearray(struct.pack("<Q", 10**9) + b"{}"))], "path string, content binary")
    assert tensorfile.tensors(bad, tolerant=True).count() == 0
    with pytest.raises(Exception, match="bad header"):
        tensorfile.tensors(bad).collect()


def test_sealing(spark):
    keys = spark.createDataFrame([(bytearray(range(32)),)], "key binary")
    chunks = spark.createDataFrame([(0, bytearray(b"abc")), (1, bytearray(b""))], "ord long, content binary")
    sealed = sealing.seal(chunks, keys)
    assert [bytes(r["opened"]) for r in sealing.open_sealed(sealed, keys).orderBy("ord").collect()] == [b"abc", b""]
    changed = sealed.withColumn("sealed", F.concat(F.lit(b"\x01"), F.expr("substring(sealed, 2)")))
    assert sealing.open_sealed(changed, keys).where("ord = 0").first()["opened"] is None


def test_text_rules(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    assert val(tx.rate(F.lit("450MB/s"))) == 450e6 and val(tx.rate(F.lit("1.2g"))) == 1.2e9 and val(tx.rate(F.lit("125e6"))) == 125e6 and val(tx.rate(F.lit("fast"))) is None
    assert val(tx.redact(F.lit("https://h/p?a=1&X-Amz-Signature=abc&b=2"))) == "https://h/p?a=1&X-Amz-Signature=<redacted>&b=2"
    assert [val(tx.path_is_safe(F.lit(p))) for p in ("a/b", "", "/a", "a//b", "a/../b", "a/", "c:x", "a\\b", "..a/b.")] == [True, False, False, False, False, False, False, False, True]
    assert val(tx.version_allowed(F.lit("1.20.3"), F.lit(">=1.19, <2"))) and not val(tx.version_allowed(F.lit("1.18"), F.lit(">=1.19")))
    assert val(tx.scheme_kind(F.lit("abfss://c@a/x"))) == "azure" and val(tx.scheme_kind(F.lit("/x"))) == "file"


def test_units_of_match_one_array(spark):
    rng, at, rows_ = random.Random(4), 0, []
    for i in range(40):
        n = rng.choice([0, 1, 5, 63, 64, 65, 300])
        rows_.append((i, at, at + n))
        at += n
    got = rows(ranges.units_of(spark.createDataFrame(rows_, "i long, start long, end long"), 64, step=2))
    assert got == [(o, min(64, at - o)) for o in range(0, at, 64)]


def test_merge_by_tile_over_wide_borders(spark):
    rng = random.Random(6)
    spans = [(a, a + rng.randrange(0, 40)) for a in (rng.randrange(0, 4000) for _ in range(90))] + [(500, 1700)]
    df = spark.createDataFrame(spans, "start long, end long")
    assert rows(ranges.merge_ranges_by_tile(df, 16, widen=4)) == rows(ranges.merge_ranges(df))


def test_floor_lookup_over_rows_of_tiles(spark):
    rng = random.Random(7)
    starts = sorted(rng.sample(range(0, 3_000_000), 25))
    points = [(i, rng.randrange(0, 3_000_000)) for i in range(120)]
    got = rows(ranges.floor_lookup(spark.createDataFrame(points, "i long, x long"), spark.createDataFrame([(s,) for s in starts], "lo long"), "x", "lo", [], 64).select("i", "floor_lo"))
    assert got == [(i, max((s for s in starts if s <= x), default=None)) for i, x in points]


def test_cycles_of_any_length(spark):
    """A ring of 40, a ring behind it, a tail on both sides, a diamond without a cycle, and a loop."""
    edges = [(i, (i + 1) % 40) for i in range(40)] + [(5, 100), (100, 101), (101, 102), (102, 101)] + [(200, 0), (102, 300), (300, 301)]
    edges += [(400, 401), (400, 402), (401, 403), (402, 403), (500, 500), (None, 1), (1, None)]
    got = bundle.cycles(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r["node"] for r in got.collect()} == {*range(40), 101, 102, 500}
    assert bundle.cycles(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_paired_ratio_needs_both(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 5.0), (2, "b", 5.0), (3, "a", 2.0), (4, "a", 0.0), (4, "b", 1.0)], "p long, arm string, v double")
    assert {r["p"]: r["ratio"] for r in campaign.paired_ratio(df, ["p"], "arm", "v", "a", "b").collect()} == {1: 2.5, 2: None, 3: None, 4: 1e12}


def test_rank_of_ties_and_small_groups(spark):
    rng = random.Random(9)
    data = [("a", float(rng.randrange(20))) for _ in range(301)] + [("b", 1.0)] + [("c", float(rng.random())) for _ in range(200)] + [("d", None)]
    got = {r["g"]: (r["p95"], r["upper_median"]) for r in campaign.percentiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v").collect()}
    want = {}
    for g in "abc":
        v = sorted(x for k, x in data if k == g)
        want[g] = (v[max(1, int(len(v) * 0.95)) - 1] if len(v) >= 30 else None, v[len(v) // 2])
    assert got == want


def test_large_group_folds_as_a_stream(spark):
    n = 30000
    df = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"))
    got = rows(folds.budget_windows(df, ["g"], 100).select("win", "lo", "hi", "items"))
    assert got == [(i, i * 100, i * 100 + 100, 10) for i in range(n // 10)]
    assert rows(folds.plain_windows(spark.createDataFrame([("a", 25), ("b", 0)], "g string, t long"), ["g"], "t", 10)) == [("a", 0, 0, 10), ("a", 1, 10, 20), ("a", 2, 20, 25)]


def test_sealed_reads_refuse_changed_extents(spark):
    keys = spark.createDataFrame([(bytes(32),)], "key binary")
    e = spark.createDataFrame([("f", i, i * 10, 10, i % 2 == 0, bytes([i] * 10)) for i in range(6)], "file string, ord long, start long, len long, clear boolean, content binary")
    stored = sealed.seal_file(e, keys)
    asked = spark.createDataFrame([("f", 5, 25), ("f", 20, 30), ("f", 31, 59)], "file string, lo long, hi long")
    whole = b"".join(bytes([i] * 10) for i in range(6))
    assert {(r["lo"], bytes(r["content"])) for r in sealed.read(stored, keys, asked, 16).collect()} == {(lo, whole[lo:hi]) for _, lo, hi in [("f", 5, 25), ("f", 20, 30), ("f", 31, 59)]}
    bad = stored.withColumn("stored", F.when(F.col("ord") == 3, F.concat(F.lit(b"\x00"), F.expr("substring(stored, 2)"))).otherwise(F.col("stored")))
    assert {r["lo"]: r["content"] is None for r in sealed.read(bad, keys, asked, 16).collect()} == {5: False, 20: False, 31: True}


def test_chunks_by_either_coder(spark):
    import zlib

    import zstandard

    plain = b"some plain bytes" * 50
    both = [("a", 0, len(plain), zlib.crc32(plain), 0, zlib.compress(plain)), ("b", 0, len(plain), zlib.crc32(plain), 0, zstandard.ZstdCompressor().compress(plain))]
    shape = "k string, dst long, rlen long, crc long, clen long, coded binary"
    assert {bytes(r["content"]) for r in archive.decode_chunks(spark.createDataFrame(both, shape)).collect()} == {plain}
    with pytest.raises(Exception, match="checksum"):
        archive.decode_chunks(spark.createDataFrame([("a", 0, len(plain), 1, 0, zlib.compress(plain))], shape)).collect()

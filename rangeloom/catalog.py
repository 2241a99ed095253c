"""Queries over the engine's operators, with the SQL that DuckDB runs for the same rows.

Documents stand for tensors (name, member, type, bytes), events for timed log entries, embeddings for tensor values.
Each query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import bundle, campaign, events, folds, ranges, staircase, tensors
from .plans import cost, gate
from .registry import ORACLE_SQL, QUERIES, query
from .session import cut, table
from .sources import archive

CHUNK = 4096


def q(*names: str) -> str:
    """A list of SQL strings."""
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


# Ranges

IDX = """idx AS (SELECT doc_id AS name, source AS member, lang AS dtype, CAST(strlen(coalesce(text, '')) AS BIGINT) AS nbytes,
  CAST(sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id) AS BIGINT) AS hi, CAST(sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id) AS BIGINT) - CAST(strlen(coalesce(text, '')) AS BIGINT) AS lo FROM documents)"""
TOTAL = "tot AS (SELECT CAST(sum(nbytes) AS BIGINT) AS total FROM idx)"
UNITS = f"units AS (SELECT i * 3000 AS off, least({CHUNK}, total - i * {CHUNK}) * 67 // 100 AS clen, i * {CHUNK} AS dst, least({CHUNK}, total - i * {CHUNK}) AS rlen FROM (SELECT unnest(range(0, (total + {CHUNK} - 1) // {CHUNK})) AS i, total FROM tot))"
WANT = "want AS (SELECT idx.* FROM idx JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = idx.name)"
MERGED = """isl AS (SELECT lo, hi, sum(new) OVER (ORDER BY lo, hi) AS g FROM (SELECT lo, hi, CASE WHEN lo > coalesce(max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo - 1) THEN 1 ELSE 0 END AS new FROM want)),
merged AS (SELECT min(lo) AS lo, max(hi) AS hi FROM isl GROUP BY g)"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    return ranges.tensor_index(table(spark, d, "documents"))


def _total(index: DataFrame) -> DataFrame:
    return index.agg(F.coalesce(F.sum("nbytes"), F.lit(0)).cast("long").alias("total"))


def _units(index: DataFrame) -> DataFrame:
    i = F.expr(f"off div {CHUNK}")
    return ranges.units_of(index, CHUNK).select((i * 3000).alias("off"), F.expr("len * 67 div 100").alias("clen"), F.col("off").alias("dst"), F.col("len").alias("rlen"))


def _wanted(spark: SparkSession, d: str, index: DataFrame) -> DataFrame:
    return ranges.tensors_by_name(index, table(spark, d, "labels").where("toxic = 1"), "doc_id")


@query(f"WITH {IDX} SELECT name, member, dtype, nbytes, lo, hi FROM idx")
def tensor_index(spark, d):
    return _index(spark, d).select("name", "member", "dtype", "nbytes", F.col("start").alias("lo"), F.col("end").alias("hi"))


@query(f"WITH {IDX} SELECT name, nbytes FROM idx ORDER BY nbytes DESC, name LIMIT 20")
def tensor_topk(spark, d):
    return ranges.largest(_index(spark, d)).select("name", "nbytes")


@query(f"WITH {IDX}, {WANT} SELECT name, member, nbytes FROM want")
def partial_load(spark, d):
    return _wanted(spark, d, _index(spark, d)).select("name", "member", "nbytes")


@query("SELECT doc_id AS name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS nbytes FROM documents WHERE source = 'src3'")
def member_filter(spark, d):
    return _index(spark, d).where("member = 'src3'").select("name", "nbytes")


@query(f"WITH {IDX} SELECT min(lo) AS lo, max(hi) AS hi FROM idx WHERE member = 'src3'")
def member_range(spark, d):
    return ranges.member_range(_index(spark, d), "src3").select(F.col("start").alias("lo"), F.col("end").alias("hi"))


@query(f"WITH {IDX}, {WANT}, {MERGED} SELECT lo, hi FROM merged")
def span_merge(spark, d):
    spans = _wanted(spark, d, _index(spark, d)).select("start", "end")
    return ranges.merge_ranges_by_tile(spans, 1 << 20).select(F.col("start").alias("lo"), F.col("end").alias("hi"))


HITS = "hits AS (SELECT * FROM units u WHERE EXISTS (SELECT 1 FROM merged s WHERE u.dst < s.hi AND u.dst + u.rlen > s.lo AND s.lo < s.hi))"


def _hits(spark, d):
    index = cut(_index(spark, d), "index")  # numbers only; what follows reads it instead of the documents
    return ranges.overlapping_units(_units(index), ranges.merge_ranges_by_tile(_wanted(spark, d, index).select("start", "end"), 1 << 20), CHUNK)


@query(f"WITH {IDX}, {TOTAL}, {UNITS}, {WANT}, {MERGED}, {HITS} SELECT off, clen, dst, rlen FROM hits")
def chunk_overlap(spark, d):
    return _hits(spark, d).select("off", "clen", "dst", "rlen")


@query(f"WITH {IDX}, {TOTAL}, {UNITS}, {WANT}, {MERGED}, {HITS} SELECT CAST(coalesce(min(dst), 0) AS BIGINT) AS lo, CAST(coalesce(max(dst + rlen), 0) AS BIGINT) AS hi FROM hits")
def chunk_cover(spark, d):
    return ranges.cover(_hits(spark, d))


@query(
    f"""WITH {IDX}, {TOTAL}, {UNITS}, {WANT}, {MERGED}, {HITS}
SELECT (SELECT count(*) FROM want) AS spans, (SELECT count(*) FROM merged) AS merged, (SELECT CAST(coalesce(sum(hi - lo), 0) AS BIGINT) FROM merged) AS requested,
 count(*) AS chunks, CAST(coalesce(sum(rlen), 0) AS BIGINT) AS covered, CAST(coalesce(min(dst), 0) AS BIGINT) AS lo, CAST(coalesce(max(dst + rlen), 0) AS BIGINT) AS hi,
 round(sum(rlen) / nullif((SELECT sum(hi - lo) FROM merged), 0), 6) AS amplification FROM hits"""
)
def cover_amplification(spark, d):
    """What a partial load reads against what it asks for. One scan of the documents makes the index."""
    index = cut(_index(spark, d), "index")
    wanted = _wanted(spark, d, index).select("start", "end")
    merged = ranges.merge_ranges_by_tile(wanted, 1 << 20)
    hits = ranges.overlapping_units(_units(index), merged, CHUNK)
    a = wanted.agg(F.count(F.lit(1)).alias("spans"))
    b = merged.agg(F.count(F.lit(1)).alias("merged"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("requested"))
    c = hits.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("rlen"), F.lit(0)).alias("covered"), F.coalesce(F.min("dst"), F.lit(0)).cast("long").alias("lo"), F.coalesce(F.max(F.col("dst") + F.col("rlen")), F.lit(0)).cast("long").alias("hi"))
    one = a.join(F.broadcast(b)).join(F.broadcast(c))  # a row each
    return one.withColumn("amplification", F.round(F.col("covered") / F.nullif(F.col("requested"), F.lit(0)), 6))


@query(f"WITH {IDX} SELECT name, greatest(lo, 100000) AS lo, least(hi, 900000) AS hi FROM idx WHERE greatest(lo, 100000) < least(hi, 900000)")
def clip_ranges(spark, d):
    return ranges.clip(_index(spark, d), F.lit(100000).cast("long"), F.lit(900000).cast("long")).select("name", F.col("start").alias("lo"), F.col("end").alias("hi"))


@query(f"""WITH {IDX}, {TOTAL}, {UNITS} SELECT off, greatest(least(dst + rlen, 900001) - greatest(dst, 100001), 0) AS inside, rlen - greatest(least(dst + rlen, 900001) - greatest(dst, 100001), 0) AS scratch FROM units WHERE dst < 900001 AND dst + rlen > 100001""")
def placed_bytes(spark, d):
    return ranges.placed_bytes(_units(cut(_index(spark, d), "index")), 100001, 900001).select("off", F.col("inside").cast("long").alias("inside"), F.col("scratch").cast("long").alias("scratch"))


@query(f"""WITH s AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS t, greatest(1, CAST(strlen(coalesce(text, '')) AS BIGINT) // 1000) AS n FROM documents),
p AS (SELECT doc_id, t, n, t // n AS step, unnest(range(0, n)) AS i FROM s WHERE t > 0) SELECT doc_id, i * step AS off, CASE WHEN i = n - 1 THEN t - i * step ELSE step END AS len FROM p""")
def split_even(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("t"))
    return t.select("doc_id", F.inline(ranges.even_split(F.col("t"), 1000)))


@query("""WITH s AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(0, t, 1024)) AS off FROM s) SELECT doc_id, off, least(1024, t - off) AS len FROM p""")
def split_fixed(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("t"))
    return t.select("doc_id", F.inline(ranges.fixed_chunks(F.col("t"), 1024)))


@query("""WITH s AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(0, 4)) AS i FROM s) SELECT doc_id, i AS region, CASE WHEN t <= 512 THEN 0 ELSE least(i * greatest(1, (t - 512) // 3), t - 512) END AS off FROM p""")
def sample_regions(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("t"))
    return t.select("doc_id", F.posexplode(ranges.sample_regions(F.col("t"), 512, 4)).alias("region", "off")).withColumn("region", F.col("region").cast("long"))


@query(f"""WITH {IDX}, e AS (SELECT member, lo, hi FROM idx WHERE dtype <> 'en' AND lo < hi), {TOTAL},
n AS (SELECT member, lo, hi, coalesce(lag(hi) OVER (PARTITION BY member ORDER BY lo), 0) AS prev, lead(lo) OVER (PARTITION BY member ORDER BY lo) AS nxt FROM e)
SELECT * FROM (SELECT member, prev AS lo, lo AS hi, 'clear' AS kind FROM n UNION ALL SELECT member, lo, hi, 'payload' FROM n UNION ALL SELECT member, hi, total, 'clear' FROM n, tot WHERE nxt IS NULL) WHERE lo < hi""")
def complement_extents(spark, d):
    index = _index(spark, d)
    rows = index.where("dtype <> 'en' and start < end").join(F.broadcast(_total(index)))
    return ranges.complement(rows, F.col("total"), ["member"], "start", "end").select("member", F.col("start").alias("lo"), F.col("end").alias("hi"), "kind")


@query(f"WITH {IDX}, p AS (SELECT event_id, CAST(trunc(value * 4096) AS BIGINT) % 2000003 AS x FROM events WHERE value >= 0), s AS (SELECT * FROM idx WHERE nbytes > 0) SELECT event_id, x, s.lo AS floor_lo, s.name AS floor_name FROM p ASOF LEFT JOIN s ON p.x >= s.lo")
def asof_floor_lookup(spark, d):
    p = table(spark, d, "events").where("value >= 0").select("event_id", (F.col("value") * 4096).cast("long").alias("x")).withColumn("x", F.col("x") % 2000003)
    starts = _index(spark, d).where("nbytes > 0").withColumnRenamed("start", "lo")
    return ranges.floor_lookup(p, starts, "x", "lo", ["name"], 1 << 16)


# Folds

CH = """ch AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, doc_id * 3000 AS off, CAST(strlen(coalesce(text, '')) AS BIGINT) % 2500 + 1 AS clen FROM documents)"""


@query(f"""WITH RECURSIVE {CH}, f AS (
 SELECT source, rn, 0 AS run, off, clen AS span, clen AS payload, CAST(1 AS BIGINT) AS chunks FROM ch WHERE rn = 1
 UNION ALL SELECT c.source, c.rn, CASE WHEN j THEN run ELSE run + 1 END, CASE WHEN j THEN f.off ELSE c.off END, CASE WHEN j THEN c.off + c.clen - f.off ELSE c.clen END, CASE WHEN j THEN payload + c.clen ELSE c.clen END, CASE WHEN j THEN chunks + 1 ELSE 1 END
 FROM (SELECT f.*, c.rn AS crn, c.off - (f.off + f.span) >= 0 AND c.off + c.clen - f.off <= 33554432 AND c.off + c.clen - f.off <= greatest(20000, (f.span + c.clen) * 5 // 4) AND f.span < 20000 AS j FROM f JOIN ch c ON c.source = f.source AND c.rn = f.rn + 1) f JOIN ch c ON c.source = f.source AND c.rn = f.crn)
SELECT source, run, max_by(off, rn) AS off, max_by(span, rn) AS span, max_by(payload, rn) AS payload, max_by(chunks, rn) AS chunks FROM f GROUP BY source, run""")
def run_coalesce(spark, d):
    ch = table(spark, d, "documents").select("source", (F.col("doc_id") * 3000).alias("off"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") % 2500 + 1).alias("clen"))
    return folds.coalesce_runs(ch, ["source"], 20000)


ITEMS = "it AS (SELECT member, row_number() OVER (PARTITION BY member ORDER BY lo, hi) AS rn, lo, hi FROM idx)"


@query(f"""WITH RECURSIVE {IDX}, {ITEMS}, f AS (SELECT member, rn, 0 AS win, lo, hi, CAST(1 AS BIGINT) AS items FROM it WHERE rn = 1
 UNION ALL SELECT i.member, i.rn, CASE WHEN greatest(f.hi, i.hi) - f.lo > 500000 THEN win + 1 ELSE win END, CASE WHEN greatest(f.hi, i.hi) - f.lo > 500000 THEN i.lo ELSE f.lo END, CASE WHEN greatest(f.hi, i.hi) - f.lo > 500000 THEN i.hi ELSE greatest(f.hi, i.hi) END, CASE WHEN greatest(f.hi, i.hi) - f.lo > 500000 THEN 1 ELSE items + 1 END FROM f JOIN it i ON i.member = f.member AND i.rn = f.rn + 1)
SELECT member, win, max_by(lo, rn) AS lo, max_by(hi, rn) AS hi, max_by(items, rn) AS items FROM f GROUP BY member, win""")
def budget_windows(spark, d):
    return folds.budget_windows(_index(spark, d), ["member"], 500000)


@query(f"""WITH RECURSIVE {IDX}, {ITEMS}, f AS (SELECT member, rn, 0 AS win, lo, hi, hi - lo >= 300000 AS cut FROM it WHERE rn = 1
 UNION ALL SELECT i.member, i.rn, CASE WHEN cut THEN win + 1 ELSE win END, CASE WHEN cut THEN i.lo ELSE f.lo END, i.hi, i.hi - CASE WHEN cut THEN i.lo ELSE f.lo END >= 300000 FROM f JOIN it i ON i.member = f.member AND i.rn = f.rn + 1)
SELECT member, win, min(lo) AS lo, max_by(hi, rn) AS hi FROM f GROUP BY member, win""")
def device_windows(spark, d):
    return folds.device_windows(_index(spark, d), ["member"], 300000)


@query("""WITH e AS (SELECT user_id, event_id, epoch(ts) AS now, 0.5 + abs(value) / 100.0 AS d FROM events), s AS (SELECT *, sum(d) OVER w AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY now, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, round(c + max(now - (c - d)) OVER (PARTITION BY user_id ORDER BY now, event_id ROWS UNBOUNDED PRECEDING), 3) AS ready FROM s""")
def shared_limiter(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.abs("value").alias("v"))
    out = folds.shared_limiter(e.withColumn("now", F.col("us") / 1e6), ["user_id"], ["now", "event_id"], "now", "v", 100.0, 0.5)
    return out.select("user_id", "event_id", F.round("ready", 3).alias("ready"))


# Cost model: a case for each source, sizes from its documents, rates from a fixed table of links

RATES = [("usb", 0.373e9, 1.0e9, 2.0e9, 0.4e9, 1.5e9, None), ("nvme", 6.34e9, 2.0e9, 2.0e9, 1.2e9, 0.6e9, 18.9e9), ("slow", 1e6, 10e9, 1e12, None, 2e9, None), ("unknown", None, 2e9, None, 1e9, None, None), ("even", 1e9, 1.02e9, 1.5e9, 0.0, 1e9, 18e9)]
RATE_COLS = ("link", "source", "decode", "pcie", "sink", "encode", "decrypt")


def _null(x) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else (f"'{x}'" if isinstance(x, str) else repr(float(x)))


CASES = f"""rates({', '.join(RATE_COLS)}) AS (VALUES {', '.join('(' + ', '.join(_null(x) for x in r) + ')' for r in RATES)}),
cases AS (SELECT s.source || '/' || link AS case_id, n AS plain, CASE WHEN m % 5 = 0 THEN NULL ELSE CAST(trunc(n * 0.67) AS BIGINT) END AS coded, r.* RENAME (source AS src) FROM (SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n, CAST(substr(source, 4) AS BIGINT) AS m FROM documents GROUP BY source) s, rates r)"""


def _cases(spark, d):
    rates = spark.createDataFrame(RATES, "link string, source double, decode double, pcie double, sink double, encode double, decrypt double")
    sizes = table(spark, d, "documents").groupBy(F.col("source").alias("s")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("plain"))
    m = F.substring("s", 4, 10).cast("long")
    sizes = sizes.withColumn("coded", F.when(m % 5 != 0, (F.col("plain") * 0.67).cast("long")))
    return sizes.crossJoin(F.broadcast(rates)).withColumn("case_id", F.concat_ws("/", "s", "link")).withColumn("expand_write", F.col("sink"))


READ = "r AS (SELECT case_id, plain / nullif(src, 0) AS p, coded / nullif(src, 0) AS rd, coded / nullif(decrypt, 0) AS dc, decrypt, plain / nullif(decode, 0) AS de, coded FROM cases), t AS (SELECT case_id, p, greatest(CASE WHEN decrypt IS NULL THEN rd ELSE rd + dc END, CASE WHEN rd IS NULL OR (decrypt IS NOT NULL AND dc IS NULL) THEN NULL ELSE de END) AS c0, rd, de FROM r), u AS (SELECT case_id, p, CASE WHEN rd IS NULL OR de IS NULL THEN NULL ELSE c0 END AS c FROM t)"
DECIDE = "SELECT case_id, CASE WHEN p / c >= 1.15 THEN 'coded' ELSE 'plain' END AS chosen, round(p / c, 9) AS speedup, coalesce(p / c >= 1.15 OR p / c <= 1 / 1.15, FALSE) AS confident FROM u"


def _decided(rows):
    return rows.withColumn("speedup", F.round("speedup", 9))


@query(f"WITH {CASES}, {READ} {DECIDE}")
def read_plan(spark, d):
    return _decided(cost.decide(cost.routes(cost.read_stages(_cases(spark, d)))))


@query(f"""WITH {CASES}, {READ}, x AS (SELECT case_id, plain, coded, src, decode, sink, decrypt FROM cases)
SELECT case_id, 'plain' AS route, round(p, 7) AS seconds, plain AS device_bytes FROM u JOIN x USING (case_id)
UNION ALL SELECT case_id, 'coded', round(c, 7), coded FROM u JOIN x USING (case_id) WHERE coded IS NOT NULL
UNION ALL SELECT case_id, 'expand', round(coded / nullif(src, 0) + plain / nullif(decode, 0) + plain / nullif(sink, 0) + plain / nullif(src, 0), 7), coded + plain FROM x WHERE coded IS NOT NULL AND sink <> 0""")
def route_costs(spark, d):
    return cost.routes(cost.read_stages(_cases(spark, d))).select("case_id", "route", F.round("seconds", 7).alias("seconds"), "device_bytes")


@query(f"""WITH {CASES}, {READ}, s AS (SELECT case_id, 'plain' AS route, CASE WHEN src IS NULL OR src = 0 THEN 'unknown' ELSE 'read' END AS limited_by FROM cases
UNION ALL SELECT case_id, 'coded', CASE WHEN u.c IS NULL THEN 'unknown' WHEN de > rd + coalesce(dc, 0) THEN 'decode' WHEN coalesce(dc, 0) > rd THEN 'decrypt' ELSE 'read' END FROM r JOIN u USING (case_id) WHERE coded IS NOT NULL
UNION ALL SELECT case_id, 'expand', CASE WHEN a IS NULL OR b IS NULL OR w IS NULL OR z IS NULL THEN 'unknown' WHEN a >= b AND a >= w AND a >= z THEN 'read' WHEN b >= w AND b >= z THEN 'decode' WHEN w >= z THEN 'write' ELSE 'reread' END
 FROM (SELECT case_id, coded / nullif(src, 0) AS a, plain / nullif(decode, 0) AS b, plain / nullif(sink, 0) AS w, plain / nullif(src, 0) AS z FROM cases WHERE coded IS NOT NULL AND sink <> 0)) SELECT * FROM s""")
def route_limits(spark, d):
    return cost.routes(cost.read_stages(_cases(spark, d))).select("case_id", "route", "limited_by")


SEALED = "w AS (SELECT case_id, plain, CAST(trunc(plain * 0.67) AS BIGINT) AS cd, sink, encode, 1 / (1 / nullif(src, 0) + 1 / nullif(sink, 0) + 1 / nullif(decrypt, 0)) AS seal FROM cases)"


def _writes(spark, d):
    c = _cases(spark, d)
    return c.withColumn("ratio", F.lit(0.67)).withColumn("seal", cost.seal_rate(F.col("source"), F.col("sink"), F.col("decrypt")))


@query(f"WITH {CASES}, {SEALED}, u AS (SELECT case_id, plain / nullif(sink, 0) AS p, CASE WHEN nullif(sink, 0) IS NULL OR nullif(encode, 0) IS NULL THEN NULL ELSE greatest(plain / nullif(encode, 0), cd / nullif(sink, 0)) END AS c FROM w) {DECIDE}")
def write_plan(spark, d):
    return _decided(cost.decide(cost.routes(cost.write_stages(_writes(spark, d)))))


@query(f"""WITH {CASES}, {SEALED} SELECT case_id, 'plain' AS route, plain AS peak_bytes FROM w UNION ALL SELECT case_id, 'coded', cd FROM w UNION ALL SELECT case_id, 'sealed', cd * 2 FROM w WHERE seal <> 0""")
def write_peaks(spark, d):
    w = _writes(spark, d)
    return cost.peak_bytes(cost.routes(cost.write_stages(w)), w).select("case_id", "route", "peak_bytes")


@query(f"""WITH {CASES}, v AS (SELECT case_id, greatest(plain / src, plain / pcie) AS a, src, pcie, coded, plain, decode, encode FROM cases),
k AS (SELECT case_id, 1 AS p, 'plain' AS route, plain / src AS x, plain / pcie AS y, 0.0 AS z, 2 * plain AS b FROM v UNION ALL SELECT case_id, 2, 'host-decode', coded / src, plain / pcie, plain / decode, coded + plain FROM v WHERE coded IS NOT NULL UNION ALL SELECT case_id, 3, 'device-decode', coded / src, coded / pcie, plain / (encode * 20), 2 * coded FROM v WHERE coded IS NOT NULL),
s AS (SELECT *, CASE WHEN x IS NULL OR y IS NULL OR z IS NULL THEN NULL ELSE greatest(x, y, z) END AS t FROM k),
m AS (SELECT case_id, max(CASE WHEN p = 1 THEN t END) AS pt, count(t) AS n, arg_min(route, (t, b, p)) FILTER (t IS NOT NULL) AS br, min(t) AS bt FROM s GROUP BY case_id)
SELECT case_id, CASE WHEN n >= 2 AND br <> 'plain' AND pt / bt >= 1.15 THEN br ELSE 'plain' END AS chosen, CASE WHEN n >= 2 THEN round(pt / bt, 9) END AS speedup, coalesce(n >= 2 AND br <> 'plain' AND pt / bt >= 1.15, FALSE) OR coalesce(n >= 2 AND pt / bt <= 1 / 1.15, FALSE) AS confident FROM m""")
def vram_plan(spark, d):
    c = _cases(spark, d).withColumn("host_decode", F.col("decode")).withColumn("device_decode", F.col("encode") * 20)
    return _decided(cost.vram_decide(cost.routes(cost.vram_stages(c))))


@query(f"WITH {CASES}, {READ}, x AS (SELECT case_id, CASE WHEN p / c >= 1.15 THEN TRUE ELSE FALSE END AS y FROM u) SELECT x.case_id, coalesce(y AND src <> 0, FALSE) AS worth FROM x JOIN cases USING (case_id)")
def cache_verdict(spark, d):
    c = _cases(spark, d)
    return cost.worth_caching(cost.decide(cost.routes(cost.read_stages(c))), c).select("case_id", "worth")


@query(f"WITH {CASES} SELECT case_id, round(nullif(decode, 0) / nullif(src, 0), 9) AS gate FROM cases")
def gate_ratios(spark, d):
    return _cases(spark, d).select("case_id", F.round(cost.gate_ratio(F.col("decode"), F.col("source")), 9).alias("gate"))


@query("SELECT event_type, CAST(count_if(abs(value - 50) / 50 < 0.25) AS BIGINT) AS right_, count(*) AS n FROM events GROUP BY event_type")
def bench_check(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(cost.prediction_right(F.lit(50.0), F.col("value"))).alias("right_"), F.count(F.lit(1)).alias("n"))


def _values(rows) -> str:
    lit = lambda x: "NULL" if x is None else ("TRUE" if x is True else "FALSE" if x is False else f"'{x}'" if isinstance(x, str) else repr(x))
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


GATE = f"""k(kb, k_low, k_high, expansion, fraction, lanes, lut, grp, thr, blo) AS (VALUES {_values(gate.KERNELS)}), dv(device, gb_s, units, pool, cap, mx, ghz, verified, backend) AS (VALUES {_values(gate.DEVICES)}), ln(link, link_gb_s) AS (VALUES {_values(gate.LINKS)}),
a AS (SELECT dv.*, k.*, lut + (thr // lanes) * grp AS shm FROM dv JOIN k ON kb = CASE WHEN backend IN ('cuda', 'metal') THEN backend ELSE 'cuda' END),
b AS (SELECT *, CASE WHEN pool IS NULL OR cap IS NULL OR mx IS NULL THEN NULL WHEN shm > cap THEN 0 ELSE least(pool // shm, mx // thr) END AS blocks, CAST(gb_s AS DOUBLE) * CAST(fraction AS DOUBLE) / (1 + 1 / CAST(expansion AS DOUBLE)) AS bw FROM a),
c AS (SELECT *, nullif(units * blocks * thr, 0) * CAST(ghz AS DOUBLE) / CAST(k_high AS DOUBLE) AS clo, nullif(units * blocks * thr, 0) * CAST(ghz AS DOUBLE) / CAST(k_low AS DOUBLE) AS chi FROM b),
e AS (SELECT *, least(coalesce(chi, bw), bw) AS hi, CASE WHEN verified AND blocks >= blo AND chi IS NOT NULL THEN least(clo, bw) ELSE 0.0 END AS lo FROM c)"""


def _gate(spark):
    return gate.predict(gate.devices(spark), gate.kernels(spark))


@query(f"WITH {GATE} SELECT device, CAST(shm AS BIGINT) AS shmem, CAST(blocks AS BIGINT) AS blocks, round(lo, 6) AS lo, round(hi, 6) AS hi, round(bw / chi, 6) AS margin FROM e")
def gate_predict(spark, d):
    return _gate(spark).select("device", "shmem", "blocks", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("margin", 6).alias("margin"))


@query(f"WITH {GATE} SELECT device, link, CASE WHEN lo > link_gb_s THEN 'pays' WHEN hi <= link_gb_s THEN 'tax' ELSE 'measure' END AS verdict, round(least(1 / 0.653, hi / CAST(link_gb_s AS DOUBLE)), 6) AS speedup FROM e, ln")
def gate_verdict(spark, d):
    return gate.verdicts(_gate(spark), gate.links(spark)).select("device", "link", "verdict", F.round("speedup", 6).alias("speedup"))


# Events: a user is a run, the event type is the event

ORDER = ("view", "click", "signup", "purchase", "error")
FIRST = "f AS (SELECT user_id, event_type, arg_min(ts, (ts, event_id)) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS seen FROM events GROUP BY user_id, event_type)"
LIFE = f"l AS (SELECT *, list_position({q(*ORDER)}, event_type) AS place FROM f WHERE event_type IN ({', '.join(repr(x) for x in ORDER)}))"


def _first(spark, d):
    return events.first_events(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query(f"WITH {FIRST} SELECT user_id, event_type, event_id, seen FROM f")
def first_event(spark, d):
    return _first(spark, d).select("user_id", "event_type", "event_id", "seen")


@query(f"WITH {FIRST}, {LIFE}, m AS (SELECT *, max(place) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM l) SELECT user_id, event_type, event_id, CAST(place AS BIGINT) AS place, CAST(reached AS BIGINT) AS reached FROM m WHERE reached > place")
def order_violation(spark, d):
    out = events.order_violations(_first(spark, d), "user_id", "event_type", "ts", "event_id", list(ORDER))
    return out.select("user_id", "event_type", "event_id", F.col("place").cast("long").alias("place"), F.col("reached").cast("long").alias("reached"))


@query(f"WITH {FIRST}, {LIFE}, p AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS phase FROM l GROUP BY user_id) SELECT user_id, phase, CASE WHEN phase IN ('purchase', 'error') THEN phase END AS terminal_state FROM p")
def run_phase(spark, d):
    return events.phases(_first(spark, d), "user_id", "event_type", "ts", "event_id", list(ORDER), ["purchase", "error"])


@query(f"WITH {FIRST} SELECT user_id, " + ", ".join(f"min(CASE WHEN event_type = '{x}' THEN event_id END) AS {x}" for x in ORDER) + " FROM f GROUP BY user_id")
def event_pivot(spark, d):
    return events.event_pivot(_first(spark, d), "user_id", "event_type", "event_id", list(ORDER))


@query("SELECT user_id, CAST(coalesce(sum(CASE WHEN event_type = 'view' AND v >= 0 THEN v END), 0) AS BIGINT) AS view, CAST(max(CASE WHEN event_type = 'click' AND v >= 0 THEN v END) AS BIGINT) AS click FROM (SELECT user_id, event_type, floor(value) AS v FROM events) GROUP BY user_id")
def run_counters(spark, d):
    e = table(spark, d, "events").withColumn("v", F.floor("value").cast("double"))
    return events.counters(e, "user_id", "event_type", "v", ["view"], ["click"])


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, arg_min(value, n) AS baseline, max(value) AS peak, arg_max(value, n) AS last, count(*) AS samples FROM s WHERE n <= 512 GROUP BY user_id")
def run_sampler(spark, d):
    return events.sampler(table(spark, d, "events"), "user_id", "ts", "event_id", "value")


@query("WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*) AS turns, CAST(count_if(role = before) AS BIGINT) AS repeats, arg_max(role, turn) AS last_role FROM m GROUP BY conv_id")
def lifecycle_turns(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == F.col("before")).alias("repeats"), F.max_by("role", "turn").alias("last_role"))


# Campaign summaries: the event type is the arm, the value the duration

STATUS = "CASE event_id % 7 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'SKIP' ELSE 'PASS' END"


def _runs(spark, d):
    return table(spark, d, "events").withColumn("status", F.expr(STATUS)).withColumn("required", F.expr("event_id % 3 = 0"))


@query(f"SELECT event_type, count(*) FILTER ({STATUS} = 'PASS') AS n, median(value) FILTER ({STATUS} = 'PASS') AS median, min(value) FILTER ({STATUS} = 'PASS') AS least, max(value) FILTER ({STATUS} = 'PASS') AS most FROM events GROUP BY event_type")
def arm_summary(spark, d):
    return campaign.arm_summary(_runs(spark, d), "event_type", "value", "status")


@query("SELECT event_type, CASE WHEN count(value) >= 30 THEN list_sort(list(value))[greatest(1, least(count(*), CAST(floor(count(*) * 0.95) AS BIGINT)))] END AS p95, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY event_type")
def percentiles(spark, d):
    return campaign.percentiles(table(spark, d, "events"), ["event_type"], "value")


@query("WITH b AS (SELECT user_id, max(value) FILTER (event_type = 'view') AS base, max(value) FILTER (event_type = 'click') AS other FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id) SELECT user_id, base, other, CASE WHEN base IS NOT NULL AND other IS NOT NULL THEN round(other / greatest(base, 1e-12), 9) END AS ratio FROM b")
def paired_ratio(spark, d):
    out = campaign.paired_ratio(table(spark, d, "events"), ["user_id"], "event_type", "value", "view", "click")
    return out.select("user_id", "base", "other", F.round("ratio", 9).alias("ratio"))


@query("WITH b AS (SELECT user_id, max(value) FILTER (event_type = 'view') AS base, max(value) FILTER (event_type = 'click') AS other FROM events GROUP BY user_id) SELECT CAST(count_if(other / base < 1) AS BIGINT) AS wins, count(other / base) AS pairs FROM b")
def win_counts(spark, d):
    r = campaign.paired_ratio(table(spark, d, "events"), ["user_id"], "event_type", "value", "view", "click")
    return r.agg(F.count_if(F.col("ratio") < 1).alias("wins"), F.count("ratio").alias("pairs"))


@query(f"WITH s AS (SELECT event_type, {STATUS} AS st, event_id % 3 = 0 AS req FROM events) SELECT event_type, CAST(count_if(st = 'PASS') AS BIGINT) AS pass, CAST(count_if(st = 'FAIL') AS BIGINT) AS fail, CAST(count_if(st = 'SKIP') AS BIGINT) AS skip, CAST(count_if(st = 'NOT_RUN') AS BIGINT) AS not_run, CAST(count_if(st = 'INCONCLUSIVE') AS BIGINT) AS inconclusive, CAST(count_if(req AND st NOT IN ('PASS', 'SKIP')) AS BIGINT) AS required_failures, CASE WHEN count_if(req AND st NOT IN ('PASS', 'SKIP')) = 0 THEN 'PASS' ELSE 'FAIL' END AS engineering FROM s GROUP BY event_type")
def status_counts(spark, d):
    return campaign.status_counts(_runs(spark, d), ["event_type"], "status", "required").select(*[F.col(c).cast("long") if c not in ("event_type", "engineering") else F.col(c) for c in ("event_type", "pass", "fail", "skip", "not_run", "inconclusive", "required_failures", "engineering")])


@query("SELECT user_id, sum(value) AS value, bool_or(event_id % 7 = 0) AS failed, arg_max(event_type, CASE WHEN event_id % 7 = 0 THEN event_id END) AS last_error FROM (SELECT user_id, floor(value) AS value, event_id, event_type FROM events) GROUP BY user_id")
def report_merge(spark, d):
    e = table(spark, d, "events").withColumn("value", F.floor("value").cast("double")).withColumn("failed", F.expr("event_id % 7 = 0")).withColumn("error", F.when(F.col("failed"), F.col("event_type")))
    return campaign.merge_reports(e, ["user_id"], ["value"], "failed", "error", "event_id")


@query("SELECT event_id, CASE WHEN value > 2 * user_id THEN 'place' WHEN user_id > 2 * value THEN 'fetch' ELSE 'balanced' END AS limited_by FROM events")
def bottleneck(spark, d):
    return table(spark, d, "events").select("event_id", campaign.bottleneck(F.col("value"), F.col("user_id")).alias("limited_by"))


@query("WITH m AS (SELECT event_type, event_id % 5 AS threads, median(value) AS m FROM events GROUP BY ALL) SELECT event_type, arg_max(threads, (m, -threads)) AS threads, max(m) AS value FROM m GROUP BY event_type")
def best_threads(spark, d):
    e = table(spark, d, "events").withColumn("threads", F.col("event_id") % 5)
    return campaign.best_threads(e, ["event_type"], "threads", "value")


@query("SELECT event_type, min(user_id / greatest(value, 1e-9)) AS slowest, max(user_id / greatest(value, 1e-9)) AS fastest, max(user_id / greatest(value, 1e-9)) <= 1.35 * 100 AND max(user_id / greatest(value, 1e-9)) / min(user_id / greatest(value, 1e-9)) < 1.75 AS ok FROM events WHERE user_id > 0 GROUP BY event_type")
def bandwidth_check(spark, d):
    return campaign.bandwidth_check(table(spark, d, "events").where("user_id > 0"), ["event_type"], "user_id", "value", 100.0)


@query("WITH m AS (SELECT user_id, event_type, median(value) FILTER (event_id % 2 = 0) AS c, median(value) FILTER (event_id % 2 <> 0) AS e FROM events GROUP BY ALL), p AS (SELECT user_id, arg_min({'r': event_type, 'e': e}, (c, event_type)) FILTER (c IS NOT NULL) AS p, arg_min({'r': event_type, 'e': e}, (e, event_type)) FILTER (e IS NOT NULL) AS b FROM m GROUP BY user_id) SELECT user_id, p.r AS predicted, b.r AS best, round(p.e - b.e, 9) AS cost FROM p")
def route_holdout(spark, d):
    e = table(spark, d, "events").withColumn("cal", F.expr("event_id % 2 = 0"))
    return campaign.route_holdout(e, ["user_id"], "event_type", "value", "cal").select("user_id", "predicted", "best", F.round("cost", 9).alias("cost"))


@query("SELECT lang, CAST(sum(greatest(n_chars - 1, 0)) AS BIGINT) AS tokens, round(sum(toxic * greatest(n_chars - 1, 0)) / sum(greatest(n_chars - 1, 0)), 9) AS loss, round(exp(sum(toxic * greatest(n_chars - 1, 0)) / sum(greatest(n_chars - 1, 0))), 9) AS perplexity FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def ppl(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    out = campaign.perplexity(rows, ["lang"], "toxic", "n_chars")
    return out.select("lang", "tokens", F.round("loss", 9).alias("loss"), F.round("perplexity", 9).alias("perplexity"))


# Staircases: groups are days, the time of a group is what a region's orders cost by then

SWEEP = "sweep AS (SELECT o_orderpriority AS shape, 1 + (o_orderkey % 40) AS g, sum(floor(o_totalprice)) AS s FROM orders GROUP BY ALL), pt AS (SELECT shape, g, ceil(g / 7.0) * 100 + s % 7 AS ms FROM sweep)"


def _sweep(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("shape"), (1 + F.col("o_orderkey") % 40).alias("g")).agg(F.sum(F.floor("o_totalprice").cast("double")).alias("s"))
    return s.select("shape", "g", (F.ceil(F.col("g") / 7.0) * 100 + F.col("s") % 7).alias("ms"))


@query(f"""WITH {SWEEP}, i AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY g) - 1 AS i FROM pt), v AS (SELECT *, quantile_cont(ms, 0.5) OVER (PARTITION BY shape ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lv FROM i),
a AS (SELECT shape, min(i) FILTER (i >= 3 AND ms >= 1.35 * lv) AS f FROM v GROUP BY shape), w AS (SELECT i.*, f, quantile_cont(ms, 0.5) OVER (PARTITION BY i.shape ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lv FROM i JOIN a ON a.shape = i.shape WHERE i >= f),
b AS (SELECT shape, min(i) FILTER (i >= f + 4 AND ms >= 1.2 * lv) AS s FROM w GROUP BY shape)
SELECT i.shape, max(g) FILTER (i = f - 1) AS cap_lo, max(g) FILTER (i = f) AS cap_hi, max(g) FILTER (i = s) AS second_g, coalesce(count(*) >= 8 AND max(g) FILTER (i = s) BETWEEN 2 * max(g) FILTER (i = f - 1) - 1 AND 2 * max(g) FILTER (i = f) + 4, FALSE) AS clean FROM i JOIN a ON a.shape = i.shape LEFT JOIN b ON b.shape = i.shape GROUP BY i.shape""")
def staircase_shape(spark, d):
    return staircase.analyze(_sweep(spark, d), ["shape"], "g", "ms").select("shape", "cap_lo", "cap_hi", "second_g", "clean")


@query(f"WITH {SWEEP}, i AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY g) - 1 AS i FROM pt), b AS (SELECT shape, median(ms) FILTER (i < 3) AS base, count(*) AS n FROM i GROUP BY shape) SELECT i.shape, min(g) AS first_above FROM i JOIN b ON b.shape = i.shape WHERE n >= 6 AND i >= 3 AND ms >= 1.35 * base GROUP BY i.shape")
def staircase_first_wave(spark, d):
    return staircase.first_wave(_sweep(spark, d), ["shape"], "g", "ms")


# Tensors: a vector and the next one are the base and the tuned tensor

DELTA = "dl AS (SELECT a.vec_id, a.label, a.vec_id % 8 AS layer, list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(b.embedding[i] AS DOUBLE) - CAST(a.embedding[i] AS DOUBLE)) AS d, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), st AS (SELECT label, layer, CAST(len(d) AS BIGINT) AS n, CAST(len(list_filter(d, lambda x: x = 0)) AS BIGINT) AS eq, list_sum(list_transform(d, lambda x: abs(x))) AS l1, list_sum(list_transform(d, lambda x: x * x)) AS l2, list_sum(list_transform(b, lambda x: x * x)) AS b2, list_max(list_transform(d, lambda x: abs(x))) AS mx FROM dl)"


def _pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return e, e.select((F.col("vec_id") - 1).alias("vec_id"), "embedding")


@query(f"WITH {DELTA} SELECT label, layer, CAST(grouping(label, layer) AS BIGINT) AS level, CAST(sum(n) AS BIGINT) AS n, CAST(sum(eq) AS BIGINT) AS equal, round(sum(l1) / sum(n), 7) AS mean_l1, round(sqrt(sum(l2)) / sqrt(sum(b2)), 7) AS relative_l2, round(max(mx), 7) AS max_abs FROM st GROUP BY GROUPING SETS ((label), (layer), ())")
def delta_stats(spark, d):
    base, other = _pairs(spark, d)
    rows = tensors.delta_rows(base.withColumn("layer", F.col("vec_id") % 8), other, ["vec_id"], "embedding")
    out = tensors.delta_report(rows, "label", "layer")
    return out.withColumns({c: F.round(c, 7) for c in ("mean_l1", "relative_l2", "max_abs")})


@query("SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(b.embedding[i] AS DOUBLE) - a.embedding[i]) * (CAST(b.embedding[i] AS DOUBLE) - a.embedding[i])))), 6) AS drift, round(0.5 * (CAST(a.embedding[1] AS DOUBLE) + b.embedding[1]), 6) AS first_merged FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def task_vectors(spark, d):
    base, other = _pairs(spark, d)
    out = tensors.task_vectors(base, other, ["vec_id"], "embedding")
    return out.select("vec_id", F.round("drift", 6).alias("drift"), F.round(F.col("merged")[0], 6).alias("first_merged"))


@query("SELECT CAST(count_if(h) AS BIGINT) AS n_hit, CAST(coalesce(sum(p_size) FILTER (h), 0) AS BIGINT) AS bytes_hit, count(*) AS n_all, CAST(sum(p_size) AS BIGINT) AS bytes_all, round(sum(p_size) FILTER (h) / sum(p_size), 9) AS share FROM (SELECT p_size, lower(p_type) LIKE '%promo%' OR lower(p_type) LIKE '%medium%' AS h FROM part)")
def taxonomy(spark, d):
    return tensors.taxonomy(table(spark, d, "part"), "p_type", "p_size", ("promo", "medium")).withColumn("share", F.round("share", 9))


@query("SELECT p_brand, CASE WHEN contains(p_type, 'PROMO') THEN 'promo' WHEN contains(p_type, 'ECONOMY') THEN 'economy' WHEN contains(p_type, 'STANDARD') THEN 'standard' END AS component, count(*) AS n FROM part GROUP BY ALL")
def component_counts(spark, d):
    rules = (("PROMO", "promo"), ("ECONOMY", "economy"), ("STANDARD", "standard"))
    return table(spark, d, "part").groupBy("p_brand", tensors.component(F.col("p_type"), rules).alias("component")).agg(F.count(F.lit(1)).alias("n"))


# Digests, names and paths

@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicates_by_digest(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT source, sha256(unhex(string_agg(hex(encode('doc/' || doc_id)) || '00' || lpad(hex(strlen(text)), 16, '0') || sha256(text), '' ORDER BY 'doc/' || doc_id))) AS digest FROM documents WHERE text IS NOT NULL GROUP BY source")
def bundle_digest(spark, d):
    e = table(spark, d, "documents").where("text is not null").select("source", F.concat(F.lit("doc/"), "doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return bundle.bundle_digest(e, ["source"], "path", "size", "sha")


@query("SELECT page_id, 'entry-' || substr(sha256(url), 1, 32) AS entry, substr(sha256(url || '|' || strlen(html) || '|' || page_id), 1, 16) AS cache_key FROM pages")
def entry_ids(spark, d):
    return table(spark, d, "pages").select("page_id", bundle.entry_id(F.col("url")).alias("entry"), tx.cache_key(F.col("url"), F.octet_length("html"), F.col("page_id")).alias("cache_key"))


URL = "url || CASE WHEN page_id % 3 = 0 THEN '?sig=abc&x=1' WHEN page_id % 3 = 1 THEN '?a=1&Access_Token=zz&b=2#frag' ELSE '' END"


@query(f"SELECT page_id, regexp_replace({URL}, '([?&](?:[A-Za-z0-9_.-]*(?:sig|token|credential|signature|key|secret)[A-Za-z0-9_.-]*)=)[^&\\s]+', '\\1<redacted>', 'gi') AS redacted FROM pages")
def redact_urls(spark, d):
    return table(spark, d, "pages").select("page_id", tx.redact(F.expr(URL)).alias("redacted"))


@query(f"SELECT page_id, substr(split_part(split_part({URL}, '#', 1), '?', 1), 1, 240) AS identity FROM pages")
def safe_identity(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_identity(F.expr(URL)).alias("identity"))


PATHS = "CASE page_id % 6 WHEN 0 THEN 'a/b' || page_id WHEN 1 THEN '/abs' WHEN 2 THEN 'a/../b' WHEN 3 THEN 'c:/x' WHEN 4 THEN 'a//b' ELSE 'ok.bin' END"


@query(f"SELECT page_id, p <> '' AND NOT contains(p, '\\') AND NOT starts_with(p, '/') AND NOT regexp_matches(p, '^[A-Za-z]:') AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe FROM (SELECT page_id, {PATHS} AS p FROM pages)")
def path_safety(spark, d):
    return table(spark, d, "pages").select("page_id", tx.path_is_safe(F.expr(PATHS)).alias("safe"))


@query("SELECT page_id, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'http' ELSE 'file' END AS kind FROM pages")
def scheme_dispatch(spark, d):
    return table(spark, d, "pages").select("page_id", tx.scheme_kind(F.col("url")).alias("kind"))


@query("SELECT doc_id, CASE WHEN strlen(text) < 8 THEN 'plain' ELSE 'plain' END AS kind, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE text IS NOT NULL")
def file_digest(spark, d):
    c = F.col("text").cast("binary")
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.container_kind(c).alias("kind"), F.sha2(c, 256).alias("digest"), F.octet_length(c).cast("long").alias("length"))


@query("SELECT event_id, event_id * 1e6 AS rate, lpad(hex(event_id), 24, '0') AS nonce FROM events")
def rate_and_nonce(spark, d):
    return table(spark, d, "events").select("event_id", tx.rate(F.concat(F.col("event_id").cast("string"), F.lit("MB/s"))).alias("rate"), F.hex(tx.nonce(F.col("event_id"))).alias("nonce"))


@query("SELECT p_partkey, (p_size, p_partkey % 10, 0) >= (10, 0, 0) AND (p_size, p_partkey % 10, 0) < (40, 5, 0) AS allowed FROM part")
def version_check(spark, d):
    v = F.concat_ws(".", F.col("p_size"), F.col("p_partkey") % 10)
    return table(spark, d, "part").select("p_partkey", tx.version_allowed(v, F.lit(">=10, <40.5")).alias("allowed"))


@query("SELECT doc_id, off, least(1000, t - off) AS len, sha256(unhex(substr(hex(encode(text)), 2 * off + 1, 2 * least(1000, t - off)))) AS digest FROM (SELECT doc_id, text, t, unnest(range(0, t, 1000)) AS off FROM (SELECT doc_id, text, CAST(strlen(text) AS BIGINT) AS t FROM documents WHERE text IS NOT NULL))")
def range_reads(spark, d):
    """Bytes of ranges, wherever they cut characters."""
    rows = archive.plain_chunks(table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id", "content", 1000)
    return rows.select("doc_id", F.col("dst").alias("off"), F.col("rlen").alias("len"), F.sha2("content", 256).alias("digest"))


COMPONENT_OF = "CASE " + " ".join(f"WHEN contains(n, '{a}') THEN '{b}'" for a, b in tensors.COMPONENTS) + " END"
NAMES = "'model.layers.' || p_partkey || '.' || CASE p_size % 12 " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(tensors.COMPONENTS)) + " WHEN 10 THEN 'q_norm.v_proj' ELSE 'bias' END"


@query(f"WITH x AS (SELECT {NAMES} AS n, CAST(p_size AS BIGINT) AS b FROM part) SELECT {COMPONENT_OF} AS component, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM x GROUP BY 1")
def component_names(spark, d):
    """Tensors by component; the first rule that a name matches counts, and what matches none stays."""
    x = table(spark, d, "part").select(F.expr(NAMES).alias("n"), F.col("p_size").cast("long").alias("b"))
    return x.groupBy(tensors.component(F.col("n")).alias("component")).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("bytes"))


# Constraints: customers depend on nations, nations on regions

@query("SELECT 'duplicate_path' AS code, s AS path, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT url AS s FROM pages) GROUP BY s HAVING count(*) > 1")
def duplicate_paths(spark, d):
    return bundle.duplicates(table(spark, d, "pages").select(F.col("url").alias("path")), "path", "duplicate_path")


@query("SELECT 'missing_dependency' AS code, s_name AS path, CAST(k AS VARCHAR) AS detail FROM (SELECT s_name, s_nationkey + 5 AS k FROM supplier) WHERE k NOT IN (SELECT n_nationkey FROM nation)")
def fk_missing(spark, d):
    deps = table(spark, d, "supplier").withColumn("k", F.col("s_nationkey") + 5)
    return bundle.missing_dependencies(deps, table(spark, d, "nation"), "k", "n_nationkey", "s_name")


@query("SELECT 'invalid_range' AS code, c_name AS path, o || '+' || l AS detail FROM (SELECT c_name, c_custkey % 40 - 1 AS o, c_custkey % 17 AS l, c_nationkey FROM customer) JOIN nation ON n_nationkey = c_nationkey WHERE o < 0 OR l < 0 OR o + l > n_nationkey + 10")
def range_violations(spark, d):
    deps = table(spark, d, "customer").select("c_name", (F.col("c_custkey") % 40 - 1).alias("o"), (F.col("c_custkey") % 17).alias("l"), "c_nationkey")
    e = table(spark, d, "nation").withColumn("size", F.col("n_nationkey") + 10)
    return bundle.invalid_ranges(deps, e, "c_nationkey", "n_nationkey", "size", "o", "l", "c_name")


EDGES = "SELECT n_nationkey AS a, CASE WHEN n_nationkey < 15 THEN (n_nationkey * 3 + 1) % 15 ELSE n_nationkey + 1 END AS b FROM nation"


@query(f"WITH RECURSIVE ed AS ({EDGES}), w(s, n) AS (SELECT a, b FROM ed UNION SELECT s, b FROM w JOIN ed ON n = a) SELECT DISTINCT s AS node FROM w WHERE s = n")
def cycle_check(spark, d):
    n = F.col("n_nationkey")
    e = table(spark, d, "nation").select(n.alias("a"), F.when(n < 15, (n * 3 + 1) % 15).otherwise(n + 1).alias("b"))
    return bundle.cycles(e, "a", "b")


FILES = "SELECT DISTINCT 'd' || p_size || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '/f' || p_partkey % 50 || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/x' END END AS path FROM part"


@query(f"WITH f AS ({FILES}) SELECT 'path_conflict' AS code, a.path, b.path AS detail FROM f a JOIN f b ON starts_with(b.path, a.path || '/')")
def path_conflict(spark, d):
    p = table(spark, d, "part")
    tail = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("/f"), F.col("p_partkey") % 50, F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.lit("/x"))))
    return bundle.path_conflicts(p.select(F.concat(F.lit("d"), F.col("p_size"), tail).alias("path")).distinct(), "path")


@query("SELECT 'resource_limit' AS code, CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) AS VARCHAR) AS detail FROM documents WHERE strlen(text) > 20000 UNION ALL SELECT 'resource_limit', '*bytes', CAST(s AS VARCHAR) FROM (SELECT sum(strlen(text)) AS s FROM documents) WHERE s > 1000 UNION ALL SELECT 'resource_limit', '*entries', CAST(n AS VARCHAR) FROM (SELECT count(*) AS n FROM documents) WHERE n > 10")
def ceilings(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"))
    return bundle.over_ceiling(e, "path", "size", 20000, 1000, 10)


@query("WITH l AS (SELECT s_suppkey AS k, s_nationkey AS x, floor(s_acctbal) AS y FROM supplier), r AS (SELECT c_custkey AS k, c_nationkey AS x, floor(c_acctbal) AS y FROM customer) SELECT coalesce(l.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'left' WHEN l.k IS NULL THEN 'right' ELSE concat_ws(',', CASE WHEN l.x IS DISTINCT FROM r.x THEN 'x' END, CASE WHEN l.y IS DISTINCT FROM r.y THEN 'y' END) END AS difference FROM l FULL JOIN r ON l.k = r.k WHERE r.k IS NULL OR l.k IS NULL OR l.x IS DISTINCT FROM r.x OR l.y IS DISTINCT FROM r.y")
def inventory_difference(spark, d):
    left = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("x"), F.floor("s_acctbal").alias("y"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("x"), F.floor("c_acctbal").alias("y"))
    return bundle.inventory_difference(left, right, "k", ["x", "y"])


@query("SELECT source, count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def role_histogram(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("bytes"))


@query("SELECT 'unsupported_role' AS code, CAST(doc_id AS VARCHAR) AS path, lang AS detail FROM documents WHERE lang NOT IN ('en', 'de') OR lang IS NULL")
def unsupported_roles(spark, d):
    return bundle.unsupported_roles(table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string")), "lang", "path", ("en", "de"))


from . import catalog_integrity, catalog_runs  # noqa: E402, F401  they add their queries

"""Queries over measured profiles, devices, campaigns and event logs beyond those of the catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import CASES, GATE, IDX, MERGED, RATES, WANT, _cases, _gate, _index, _wanted
from .operators import campaign, events, folds, profile, ranges, staircase, tensors
from .plans import cost, gate
from .registry import query
from .session import cut, table

# Devices


@query(f"WITH {GATE} SELECT device, CASE WHEN pool // shm <= mx // thr THEN 'shared memory' WHEN pool // shm IS NOT NULL AND mx // thr IS NOT NULL THEN 'threads per unit' END AS binds, CAST(units * blocks * thr AS BIGINT) AS resident FROM e")
def gate_residency(spark, d):
    return _gate(spark).select("device", "binds", F.col("resident").cast("long").alias("resident"))


@query(f"WITH {GATE}, v AS (SELECT device, link, CASE WHEN lo > link_gb_s THEN 'pays' WHEN hi <= link_gb_s THEN 'tax' ELSE 'measure' END AS verdict FROM e, ln) SELECT device, " + ", ".join(f"max(CASE WHEN link = '{x}' THEN verdict END) AS \"{x.replace('.', '_')}\"" for x, _ in gate.LINKS) + " FROM v GROUP BY device")
def gate_report(spark, d):
    out = gate.table(gate.verdicts(_gate(spark), gate.links(spark)))
    return out.toDF(*[c.replace(".", "_") for c in out.columns])


#: Published costs: one in the right unit, one in another, one without k.
COSTS = [("cuda", 200.0, 230.0, gate.K_UNIT, 3.0, None), ("metal", 9.0, 10.0, "cycles", None, 0.5)]


@query(f"SELECT backend, CASE backend WHEN 'cuda' THEN 200e0 ELSE k_low END AS k_low, CASE backend WHEN 'cuda' THEN 230e0 ELSE k_high END AS k_high, CASE backend WHEN 'cuda' THEN 3e0 ELSE expansion END AS expansion, CASE backend WHEN 'metal' THEN 5e-1 ELSE fraction END AS fraction, backend = 'metal' AS refused FROM (VALUES {', '.join(f'({x[0]!r}, {x[1]:e}, {x[2]:e}, {x[3]:e}, {x[4]:e})' for x in gate.KERNELS)}) k(backend, k_low, k_high, expansion, fraction)")
def gate_published(spark, d):
    costs = spark.createDataFrame(COSTS, "backend string, k_low double, k_high double, unit string, expansion double, fraction double")
    return gate.published(gate.kernels(spark), costs).select("backend", "k_low", "k_high", "expansion", "fraction", "refused")


# Profiles and plans


@query("""SELECT coalesce(s_suppkey, c_custkey) AS k, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END, c_acctbal) AS decode, coalesce(nullif(s_nationkey, 0), c_nationkey) AS threads, coalesce(nullif(CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END, ''), c_name) AS archive
FROM supplier FULL JOIN customer ON s_suppkey = c_custkey""")
def profile_upsert(spark, d):
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("decode"), F.col("s_nationkey").alias("threads"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name")).alias("archive"))
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("decode"), F.col("c_nationkey").alias("threads"), F.col("c_name").alias("archive"))
    return profile.upsert(old, new, "k", ["decode"], ["threads", "archive"])


MODELS = f"m AS (SELECT c_custkey AS case_id, CAST(floor(c_acctbal) AS BIGINT) + 100000 AS plain, c_custkey % 2 = 0 AS is_coded, CASE WHEN c_custkey % 2 = 0 THEN 50000 END AS cb, c_custkey % 4 = 0 AS enc, CASE c_custkey % 7 {' '.join(f'WHEN {i} THEN {r[0]!r}' for i, r in enumerate(RATES))} ELSE 'none' END AS link, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS codec FROM customer)"
PRICES = f"st(link, src, wr, dr) AS (VALUES {', '.join('(' + ', '.join('CAST(NULL AS DOUBLE)' if x is None else (repr(x) if isinstance(x, str) else repr(float(x))) for x in (r[0], r[1], r[4], r[6])) + ')' for r in RATES)}), co(codec, decode, ratio) AS (VALUES ('a', 2e9, 0.6), ('b', 3e8, 0.0))"


@query(f"""WITH {MODELS}, {PRICES}, p AS (SELECT m.*, src, wr, dr, decode, CASE WHEN is_coded THEN cb ELSE CAST(trunc(plain * nullif(ratio, 0)) AS BIGINT) END AS coded FROM m LEFT JOIN st USING (link) LEFT JOIN co USING (codec)),
r AS (SELECT *, plain / nullif(src, 0) AS pt, coded / nullif(src, 0) AS rd, CASE WHEN enc AND dr IS NOT NULL THEN coded / nullif(dr, 0) END AS dc, plain / nullif(decode, 0) AS de FROM p),
u AS (SELECT case_id, is_coded, coded, pt AS p, CASE WHEN rd IS NULL OR de IS NULL THEN NULL ELSE greatest(rd + coalesce(dc, 0), de) END AS c FROM r)
SELECT case_id, NOT is_coded AND coded IS NOT NULL AS hypothetical, CASE WHEN p / c >= 1.15 THEN 'coded' ELSE 'plain' END AS chosen, round(p / c, 9) AS speedup, coalesce(p / c >= 1.15 OR p / c <= 1 / 1.15, FALSE) AS confident FROM u""")
def profile_plans(spark, d):
    """The read plan of each model at the rates that its link and its codec were measured at."""
    i = F.col("c_custkey")
    link = F.lit("none")
    for n, r in enumerate(RATES):
        link = F.when(i % 7 == n, r[0]).otherwise(link)
    m = table(spark, d, "customer").select(
        i.alias("case_id"), (F.floor("c_acctbal") + 100000).alias("plain"), (i % 2 == 0).alias("is_coded"), F.when(i % 2 == 0, F.lit(50000).cast("long")).alias("coded_bytes"), (i % 4 == 0).alias("encrypted"),
        link.alias("link"), F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").otherwise("c").alias("codec"),
    )
    st = spark.createDataFrame([(r[0], r[1], r[4], r[6]) for r in RATES], "link string, source double, write double, decrypt_rate double")
    co = spark.createDataFrame([("a", 2e9, 0.6), ("b", 3e8, 0.0)], "codec string, decode double, ratio double")
    rows = profile.priced(m, st, co, "link", "codec")
    out = cost.decide(cost.routes(cost.read_stages(rows)))
    return out.join(rows.select("case_id", "hypothetical"), "case_id").select("case_id", "hypothetical", "chosen", F.round("speedup", 9).alias("speedup"), "confident")


@query("SELECT event_id, 'Linux|x86|' || user_id || '|8' AS fingerprint, CASE WHEN value > 0 THEN CAST(value AS DOUBLE) ELSE 0.0 END AS age FROM events")
def profile_ages(spark, d):
    return table(spark, d, "events").select("event_id", profile.fingerprint(F.lit("Linux"), F.lit("x86"), F.col("user_id"), F.lit(8)).alias("fingerprint"), profile.age(F.col("value"), F.lit(0.0)).alias("age"))


POINTS = "sweep AS (SELECT o_orderpriority AS shape, o_orderkey % 5 AS g, CAST(max(floor(o_totalprice)) AS DOUBLE) AS ms FROM orders GROUP BY ALL)"


@query(f"WITH {POINTS} SELECT shape, CAST(256 AS BIGINT) AS threads, CAST(1024 AS BIGINT) AS shared, g, ms FROM sweep")
def probe_points(spark, d):
    """Points of sweeps from probes' JSON texts, written in two layouts."""
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("shape"), (F.col("o_orderkey") % 5).alias("g")).agg(F.max(F.floor("o_totalprice").cast("double")).alias("ms"))
    per = s.groupBy("shape").agg(F.sort_array(F.collect_list(F.struct("g", "ms"))).alias("p"))
    odd = F.substring("shape", 1, 1).cast("int") % 2 == 1
    flat = F.struct(F.array(F.struct(F.col("shape").alias("name"), F.lit(256).alias("T"), F.lit(1024).alias("S"), F.transform("p", lambda x: x["g"]).alias("G"), F.transform("p", lambda x: x["ms"]).alias("median_ms")), F.struct(F.lit("broken").alias("name"), F.lit(1).alias("T"), F.lit(1).alias("S"), F.array(F.lit(1).cast("long")).alias("G"), F.array(F.lit(1.0)).alias("median_ms"))).alias("shapes"))
    points = F.transform("p", lambda x: F.struct(x["g"].alias("G"), x["ms"].alias("timeMs")))
    own = F.array(F.struct(F.col("shape").alias("name"), F.lit(256).alias("T"), F.lit(1024).alias("S"), points.alias("points")))
    nested = F.struct(F.struct(F.array().cast(f"array<struct<name:string>>").alias("shapes"), own.alias("sSweep")).alias("staircase"))
    text = F.when(odd, F.regexp_replace(F.to_json(flat), '"name":"broken"', '"error":"lost","name":"broken"')).otherwise(F.to_json(nested))
    return profile.probe_points(per.select(text.alias("doc")), "doc")


@query("SELECT event_type AS arm, event_id % 2 AS mode, count(*) AS n, median(value) AS median, min(value) AS least, max(value) AS most, CASE WHEN median(value) > 0 THEN 8e9 / median(value) / 1e9 ELSE 0.0 END AS gb_s FROM events WHERE event_id % 10 <> 3 GROUP BY ALL")
def arm_modes(spark, d):
    """A run log in JSON lines, valid unless it says otherwise, summed up by arm and mode."""
    i = F.col("event_id")
    lines = table(spark, d, "events").select(F.to_json(F.struct(F.col("event_type").alias("arm"), (i % 2).alias("mode"), F.col("value").alias("secs"), F.when(i % 10 == 3, F.lit(False)).when(i % 10 == 4, F.lit(True)).alias("valid"))).alias("line"))
    runs = lines.select(F.from_json("line", "struct<arm:string,mode:bigint,secs:double,valid:boolean>").alias("r")).select("r.*")
    return campaign.arm_modes(runs, "arm", "mode", "secs", "valid", 8_000_000_000)


SAMPLES = "s AS (SELECT event_id, user_id, event_id % 4 AS rep, event_type AS arm, value, CASE event_id % 7 WHEN 0 THEN 'FAIL' ELSE 'PASS' END AS status, event_id % 9 = 0 AS warm FROM events), l AS (SELECT * FROM s WHERE NOT warm), bs AS (SELECT user_id, rep, min(value) AS baseline FROM l WHERE arm = 'view' AND status = 'PASS' GROUP BY ALL), pr AS (SELECT l.*, baseline, CASE WHEN status = 'PASS' AND baseline IS NOT NULL THEN value / greatest(baseline, 1e-12) END AS ratio FROM l LEFT JOIN bs USING (user_id, rep))"


def _samples(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", "user_id", (i % 4).alias("rep"), F.col("event_type").alias("arm"), "value", F.when(i % 7 == 0, "FAIL").otherwise("PASS").alias("status"), (i % 9 == 0).alias("warm"))


@query(f"WITH {SAMPLES} SELECT event_id, baseline, round(ratio, 9) AS ratio FROM pr")
def paired_normal(spark, d):
    out = campaign.paired_normal(_samples(spark, d), ["user_id", "rep"], "arm", "value", "status", "warm", "view")
    return out.select("event_id", "baseline", F.round("ratio", 9).alias("ratio"))


@query(f"WITH {SAMPLES}, v AS (SELECT *, CASE WHEN status = 'PASS' THEN value END AS x FROM pr) SELECT arm, count(x) AS n, median(x) AS median, min(x) AS least, max(x) AS most, count(ratio) AS ratio_n, round(median(ratio), 9) AS ratio_median, round(min(ratio), 9) AS ratio_least, round(max(ratio), 9) AS ratio_most, CAST(count_if(ratio < 1) AS BIGINT) AS wins FROM v GROUP BY arm")
def duration_summary(spark, d):
    rows = campaign.paired_normal(_samples(spark, d), ["user_id", "rep"], "arm", "value", "status", "warm", "view")
    out = campaign.duration_summary(rows, ["arm"], "value", "status", "ratio")
    return out.withColumns({c: F.round(c, 9) for c in ("ratio_median", "ratio_least", "ratio_most")})


@query("SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS plain_mid, list_sort(list(value + user_id))[count(*) // 2 + 1] AS coded_mid, min(value) AS plain_least, max(value) AS plain_most, round(list_sort(list(value + user_id))[count(*) // 2 + 1] / list_sort(list(value))[count(*) // 2 + 1], 9) AS ratio, list_sort(list(value + user_id))[count(*) // 2 + 1] / list_sort(list(value))[count(*) // 2 + 1] <= 1 / 0.653 + 1e-9 AS allowed FROM events GROUP BY event_type")
def spread_ceiling(spark, d):
    e = table(spark, d, "events").withColumn("coded", F.col("value") + F.col("user_id"))
    return campaign.spread_ceiling(e, ["event_type"], "value", "coded", 0.653).withColumn("ratio", F.round("ratio", 9))


@query("""WITH b AS (SELECT p_partkey AS k, sha256(p_name || p_partkey) AS dg, CAST(p_size AS BIGINT) AS n FROM part), r AS (SELECT k, CASE WHEN k % 6 = 0 THEN 'x' || dg ELSE dg END AS dg, n FROM b),
s AS (SELECT count(*) AS chunks, CAST(count_if(k % 6 = 0) AS BIGINT) AS new_chunks, CAST(sum(n) AS BIGINT) AS bytes, CAST(coalesce(sum(n) FILTER (k % 6 = 0), 0) AS BIGINT) AS new_bytes FROM r)
SELECT *, round(1 + (1 - 0.453) / (0.003 * (0.453 * 10.8 - 1)), 6) AS up_to FROM s""")
def chunk_share(spark, d):
    """What a revision adds to the chunks of its base, and up to how many revisions coding wins at measured figures."""
    p = table(spark, d, "part").select("p_partkey", F.sha2(F.concat("p_name", "p_partkey"), 256).alias("dg"), F.col("p_size").cast("long").alias("n"))
    revised = p.withColumn("dg", F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("x"), "dg")).otherwise(F.col("dg")))
    return campaign.chunk_share(p, revised, "dg", "n").withColumn("up_to", F.round(campaign.crossover(F.lit(0.453), F.lit(0.003), F.lit(10.8)), 6))


WANTED = ("view", "click", "purchase")


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS x FROM events GROUP BY ALL), p AS (SELECT user_id, [""" + ", ".join(f"min(x) FILTER (event_type = '{x}')" for x in WANTED) + """] AS t FROM f GROUP BY user_id),
ok AS (SELECT user_id, t FROM p WHERE user_id % 3 <> 0 AND len(list_filter(t, lambda y: y IS NULL)) = 0), b AS (SELECT arg_min(user_id, (user_id % 5 <> 1, user_id)) AS user_id, arg_min(t, (user_id % 5 <> 1, user_id)) AS t FROM ok) SELECT user_id, coalesce(t = list_sort(t), FALSE) AS ordered FROM b""")
def ordered_run(spark, d):
    e = events.first_events(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")
    e = e.withColumn("failed", F.col("user_id") % 3 == 0).withColumn("liked", F.col("user_id") % 5 == 1)
    return campaign.ordered_run(e, "user_id", "event_type", "ts", "failed", "liked", list(WANTED))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') OR event_type IS NULL")
def unknown_events(spark, d):
    return events.unknown_events(table(spark, d, "events"), "event_type", list(WANTED)).select("event_id", "event_type")


@query("SELECT event_id, CASE WHEN user_id > 1.5 * value THEN TRUE END AS layered FROM events")
def read_layers(spark, d):
    return table(spark, d, "events").select("event_id", campaign.layered(F.col("value"), F.col("user_id")).alias("layered"))


@query("WITH b AS (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 3) AS v FROM embeddings), j AS (SELECT a.v, b.v AS w, a.label AS l, b.label AS m FROM b a JOIN b ON b.vec_id = a.vec_id + 1) SELECT bool_and(v = w) AS equal, max(abs(v - w)) AS max_abs, bool_and(l IS NOT DISTINCT FROM m) AS text_match FROM j")
def numerical_check(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 3).alias("v"), F.col("label").cast("string").alias("l"))
    return tensors.numerical_check(e, e.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"], "v", "l")


# Ranges and windows


@query(f"WITH {IDX}, {WANT}, {MERGED} SELECT 'whole' AS load, min(lo) AS lo, max(hi) AS hi FROM idx UNION ALL SELECT 'names', lo, hi FROM merged")
def device_spans(spark, d):
    """What a device load must cover: all of a member, or the merged ranges of the names asked for."""
    index = cut(_index(spark, d), "index")
    names = ranges.device_spans(index, _wanted(spark, d, index), 1 << 20).select(F.lit("names").alias("load"), F.col("start").alias("lo"), F.col("end").alias("hi"))
    return ranges.device_spans(index, None, 1 << 20).select(F.lit("whole").alias("load"), F.col("start").alias("lo"), F.col("end").alias("hi")).unionByName(names)


@query("WITH s AS (SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS t FROM documents GROUP BY source), w AS (SELECT source, t, unnest(range(0, t, 70000)) AS lo FROM s WHERE t > 0) SELECT source, CAST(lo // 70000 AS INTEGER) AS win, lo, least(lo + 70000, t) AS hi FROM w")
def plain_windows(spark, d):
    total = table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("t"))
    return folds.plain_windows(total, ["source"], "t", 70000)


@query(f"WITH {IDX}, w AS (SELECT *, CASE dtype WHEN 'en' THEN 4 WHEN 'de' THEN 2 ELSE 1 END AS width FROM idx) SELECT CAST(count_if(width > 1 AND lo % width <> 0) AS BIGINT) AS copied, CAST(coalesce(sum(nbytes) FILTER (width > 1 AND lo % width <> 0), 0) AS BIGINT) AS copied_bytes, count(*) AS tensors, CAST(sum(nbytes) AS BIGINT) AS bytes FROM w")
def copied_bytes(spark, d):
    width = F.when(F.col("dtype") == "en", 4).when(F.col("dtype") == "de", 2).otherwise(1)
    return campaign.copied_bytes(_index(spark, d).withColumn("width", width), "start", "nbytes", "width")


# Staircases over several runs

SHAPES = """i AS (SELECT *, row_number() OVER (PARTITION BY shape, run ORDER BY g) - 1 AS i FROM pt), v AS (SELECT *, quantile_cont(ms, 0.5) OVER (PARTITION BY shape, run ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lv FROM i),
a AS (SELECT shape, run, min(i) FILTER (i >= 3 AND ms >= 1.35 * lv) AS f FROM v GROUP BY ALL), w AS (SELECT i.*, f, quantile_cont(ms, 0.5) OVER (PARTITION BY i.shape, i.run ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS lv FROM i JOIN a ON a.shape = i.shape AND a.run = i.run WHERE i >= f),
b AS (SELECT shape, run, min(i) FILTER (i >= f + 4 AND ms >= 1.2 * lv) AS s FROM w GROUP BY ALL),
c AS (SELECT i.shape, i.run, count(*) AS n, max(g) FILTER (i = f - 1) AS lo, max(g) FILTER (i = f) AS hi, max(g) FILTER (i = s) AS g2 FROM i JOIN a ON a.shape = i.shape AND a.run = i.run LEFT JOIN b ON b.shape = i.shape AND b.run = i.run GROUP BY ALL),
k AS (SELECT *, coalesce(n >= 8 AND g2 BETWEEN 2 * lo - 1 AND 2 * hi + 4, FALSE) AND ceil(lo / 7) = ceil(hi / 7) - 1 AS clean, CASE WHEN coalesce(n >= 8 AND g2 BETWEEN 2 * lo - 1 AND 2 * hi + 4, FALSE) AND ceil(lo / 7) = ceil(hi / 7) - 1 THEN CAST(ceil(lo / 7) AS BIGINT) END AS per_unit FROM c)"""
RUNS = "sweep AS (SELECT o_orderpriority AS shape, o_custkey % 2 AS run, 1 + o_orderkey % 40 AS g, sum(floor(o_totalprice)) AS s FROM orders GROUP BY ALL), pt AS (SELECT shape, run, g, ceil(g / 7.0) * 100 + s % 7 AS ms FROM sweep)"


def _shapes(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("shape"), (F.col("o_custkey") % 2).alias("run"), (1 + F.col("o_orderkey") % 40).alias("g")).agg(F.sum(F.floor("o_totalprice").cast("double")).alias("s"))
    points = s.select("shape", "run", "g", (F.ceil(F.col("g") / 7.0) * 100 + F.col("s") % 7).alias("ms"), F.lit(7).alias("units"))
    return staircase.analyze(points, ["shape", "run"], "g", "ms", "units")


@query(f"WITH {RUNS}, {SHAPES} SELECT shape, run, lo AS cap_lo, hi AS cap_hi, per_unit, coalesce(clean, FALSE) AS clean FROM k")
def staircase_units(spark, d):
    return _shapes(spark, d).select("shape", "run", "cap_lo", "cap_hi", "per_unit", "clean")


@query(f"WITH {RUNS}, {SHAPES} SELECT shape, CAST(count_if(clean) AS BIGINT) AS clean_in, count(DISTINCT per_unit) AS counts, max(lo) AS lo, min(hi) AS hi, (SELECT count(DISTINCT run) FROM k) AS runs, count_if(clean) = (SELECT count(DISTINCT run) FROM k) AND count(DISTINCT per_unit) = 1 AS reproducible, max(lo) < min(hi) AS consistent FROM k GROUP BY shape")
def staircase_runs(spark, d):
    return staircase.merge_runs(_shapes(spark, d), "shape", "run")


@query(f"WITH {RUNS}, {SHAPES}, x(shape, expected) AS (VALUES ('1-URGENT', 7), ('2-HIGH', 9), ('no such', 7)) SELECT x.shape, expected, coalesce(count(lo) = (SELECT count(DISTINCT run) FROM k) AND bool_and(lo <= expected AND expected < hi), FALSE) AS ok FROM x LEFT JOIN k ON k.shape = x.shape GROUP BY x.shape, expected")
def staircase_calibration(spark, d):
    """Capacities that are known against the intervals of every run; a shape without one is not right."""
    want = spark.createDataFrame([("1-URGENT", 7), ("2-HIGH", 9), ("no such", 7)], "shape string, expected int")
    return staircase.calibrate(_shapes(spark, d), want, "shape", "run", "expected")


@query(f"WITH {CASES} SELECT case_id, round(nullif(encode, 0) / nullif(src, 0), 9) AS gate, CASE WHEN src > 0 AND plain / src > 0 THEN 'priced' ELSE 'unmeasured' END AS state FROM cases")
def measured_cases(spark, d):
    """Which cases have a rate to be priced at; 0 and NULL are unmeasured."""
    c = _cases(spark, d)
    return c.select("case_id", F.round(cost.gate_ratio(F.col("encode"), F.col("source")), 9).alias("gate"), F.when((F.col("source") > 0) & (F.col("plain") > 0), "priced").otherwise("unmeasured").alias("state"))

import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from rangeloom import __main__ as cli
from rangeloom.codecs import CODECS, codec
from rangeloom.functions import keys
from rangeloom.operators import campaign, manifest, profile
from rangeloom.session import cancellable
from rangeloom.sources import archive, evidence, httprange, sealed
from rangeloom.streaming import progress

BODY = bytes(i * 7 % 251 for i in range(10_000))


class Server(http.server.BaseHTTPRequestHandler):
    ranges, failures = True, 0

    def do_GET(self):
        asked = self.headers.get("Range")
        if type(self).failures:
            type(self).failures -= 1
            self.send_error(503)
        elif self.path.startswith("/missing"):
            self.send_error(404)
        elif asked and type(self).ranges:
            lo, hi = (int(x) for x in asked.removeprefix("bytes=").split("-"))
            part = BODY[lo : hi + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {lo}-{lo + len(part) - 1}/{len(BODY)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)
        else:
            self.send_response(200)
            self.send_header("Content-Length", str(len(BODY)))
            self.end_headers()
            self.wfile.write(BODY)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def fetched(df):
    return b"".join(bytes(r["content"]) for r in df.orderBy("start").collect())


@pytest.mark.parametrize("ranges", [True, False])
def test_http_ranges(spark, url, ranges):
    httprange.register(spark)
    Server.ranges = ranges
    read = spark.read.format("rangeloom_http").option("part", 3000)
    df = read.load(f"{url}/x")
    assert fetched(df) == BODY and df.count() == 4 and df.rdd.getNumPartitions() == (4 if ranges else 1)
    assert fetched(read.option("start", 100).option("end", 5200).load(f"{url}/x")) == BODY[100:5200]
    Server.ranges = True


def test_http_tries_again_and_keeps_addresses_to_itself(url):
    Server.failures = 1
    assert httprange.fetch(f"{url}/x", {}, 5, 10)[1] == BODY[5:10]
    with pytest.raises(OSError, match="404") as e:
        httprange.fetch(f"{url}/missing?sig=secret", {})
    assert "secret" not in str(e.value)


def test_container_sink(spark, tmp_path):
    archive.register(spark)
    folder = str(tmp_path / "out")
    rows = [(f"m{i}", bytes([i]) * (1000 + i)) for i in range(9)]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    df.write.format("rangeloom_archive").option("chunk", 256).mode("append").save(folder)
    got = {}
    for f in sorted(os.listdir(folder)):
        assert f.endswith(".rloom")
        index = archive.read_index(f"{folder}/{f}")
        plain = b"".join(bytes(r["content"]) for r in spark.read.format("rangeloom_archive").load(f"{folder}/{f}").orderBy("start").collect())
        got |= {m["path"]: plain[m["dst"] : m["dst"] + m["size"]] for m in index["members"]}
    assert got == dict(rows)
    with pytest.raises(Exception, match="already"):
        df.write.format("rangeloom_archive").mode("append").save(folder)
    df.limit(1).write.format("rangeloom_archive").mode("overwrite").save(folder)
    assert len(os.listdir(folder)) == 1
    with pytest.raises(ValueError, match="repeat"):
        archive.encode([("a", b"x"), ("a", b"y")], str(tmp_path / "twice"))
    assert not os.path.exists(tmp_path / "twice")


def test_container_by_address(spark, tmp_path):
    path = str(tmp_path / "a.rloom")
    archive.encode([("a", BODY), ("b", b"tail")], path, chunk=1000)
    assert archive.is_archive(f"file://{path}") and archive.read_index(f"file://{path}")["plain"] == len(BODY) + 4
    assert archive.expand(path, "a", str(tmp_path / "a")) == len(BODY) and (tmp_path / "a").read_bytes() == BODY
    with pytest.raises(FileExistsError):
        archive.expand(path, None, str(tmp_path / "a"))
    with pytest.raises(KeyError):
        archive.expand(path, "none", str(tmp_path / "n"))


def test_keys():
    # Test case 1 of RFC 5869.
    got = keys.hkdf(b"\x0b" * 22, bytes(range(13)), bytes(range(0xF0, 0xFA)), 42)
    assert got.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    assert len(keys.key_name(bytes(32))) == 16 and keys.key_name(bytes(32)) != keys.key_name(b"\1" * 32)


def test_key_columns(spark):
    import hmac

    df = spark.createDataFrame([(bytes(32), b"salt"), (b"\1" * 32, None)], "key binary, salt binary")
    rows = df.select(keys.subkeys("key", "salt").alias("k"), keys.key_names("key").alias("n"), keys.signing_key(F.col("key"), [F.lit("20240101"), F.lit("region")]).alias("s")).collect()
    assert bytes(rows[0]["k"]) == keys.hkdf(bytes(32), b"salt", keys.FOR_CHUNKS) and rows[1]["k"] is None
    assert bytes(rows[0]["s"]) == hmac.digest(hmac.digest(bytes(32), b"20240101", "sha256"), b"region", "sha256")


def test_structure_mac_by_hand(spark):
    import hmac

    e = [("f", 0, 0, 3, True, b"abc"), ("f", 1, 3, 2, False, b"de"), ("f", 2, 5, 1, True, b"g")]
    df = spark.createDataFrame(e, "file string, ord long, start long, len long, clear boolean, stored binary").repartition(3)
    own = hmac.new(keys.hkdf(b"k" * 32, b"", keys.FOR_STRUCTURE), b"abcg", "sha256")
    for _, _, start, n, clear, stored in e:
        own.update(start.to_bytes(8, "big") + n.to_bytes(8, "big") + len(stored).to_bytes(8, "big") + (b"\0" if clear else b"\1"))
    assert [r["mac"] for r in sealed.structure_mac(df, b"k" * 32).collect()] == [own.hexdigest()]


@pytest.mark.parametrize("name", sorted(CODECS))
@pytest.mark.parametrize("plain", [b"", b"a", BODY, b"ab" * 1001])
def test_codecs(name, plain):
    assert codec(name).decode(codec(name).encode(plain)) == plain
    with pytest.raises(ValueError, match="no options"):
        codec(name, speed=9)


def test_profile_of_another_machine(spark, tmp_path):
    path = str(tmp_path / "profile")
    for n in (1, 2):
        profile.save(spark.createDataFrame([("a", "here", 1.0 * n), ("b", "there", 2.0)], "codec string, fingerprint string, rate double"), path)
    assert [tuple(r) for r in profile.load(spark, path, "codec string, fingerprint string, rate double", "here").collect()] == [("a", "here", 2.0)]


def test_measured_rates(spark):
    rows = campaign.best_threads(profile.measure(spark, "deflate", 20_000, 2), ["codec", "what"], "threads", "rate").collect()
    assert {r["what"] for r in rows} == {"encode", "decode"} and all(r["rate"] > 0 for r in rows)


def bundle_of(spark, deps):
    files = [("b", "x", b"one"), ("b", "y", b"two")]
    contents = spark.createDataFrame(files, "key string, path string, content binary")
    import hashlib

    entries = [{"path": p, "role": "weights", "length": len(c), "sha256": hashlib.sha256(c).hexdigest(), "dependencies": deps.get(p, [])} for _, p, c in files]
    return contents, spark.createDataFrame([("b", json.dumps({"schema": "1.0", "entries": entries}))], "key string, text string")


def test_provider(spark, tmp_path):
    contents, texts = bundle_of(spark, {"x": [{"path": "y"}]})
    good = manifest.TableProvider(texts, contents)
    assert good.validate().count() == 0 and {r["valid"] for r in good.inventory().collect()} == {True}
    assert {r["valid"] for r in good.inventory(strict=False).collect()} == {None}
    place = str(tmp_path / "bundle")
    good.materialize(place)
    assert {(r["path"], bytes(r["content"])) for r in spark.read.parquet(place).collect()} == {("x", b"one"), ("y", b"two")}
    with pytest.raises(FileExistsError):
        good.materialize(place)
    assert os.listdir(tmp_path) == ["bundle"]


def test_provider_names_what_is_wrong(spark, tmp_path):
    contents, texts = bundle_of(spark, {"x": [{"path": "y"}, {"path": "z"}], "y": [{"path": "x"}, {"path": "x", "id": "other"}]})
    bad = manifest.TableProvider(texts, contents.withColumn("content", F.when(F.col("path") == "y", F.lit(b"2wo")).otherwise(F.col("content"))))
    got = {(r["code"], r["path"]) for r in bad.validate().collect()}
    assert got == {("missing_dependency", "x"), ("ambiguous_dependency", "y"), ("dependency_cycle", "x"), ("dependency_cycle", "y"), ("content", "y")}
    with pytest.raises(ValueError, match="not valid"):
        bad.materialize(str(tmp_path / "no"))
    assert not os.listdir(tmp_path)


def test_evidence_is_the_same_again(tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "b.json").write_text("{}")
    (tmp_path / "run" / "a.txt").write_text("a" * 1000)
    one = evidence.pack(str(tmp_path / "run"), str(tmp_path / "one.zip"))
    os.utime(tmp_path / "run" / "a.txt", (1, 1))
    two = evidence.pack(str(tmp_path / "run"), str(tmp_path / "two.zip"))
    assert one["sha256"] == two["sha256"] and one["members"] == ["a.txt", "b.json"] and one["readable"]
    assert not evidence.inspect(str(tmp_path / "one.zip"), ["c"])["readable"]


def test_progress_swallows_errors():
    seen = []

    def told(event, facts):
        seen.append(event)
        raise RuntimeError

    p = progress.Progress(told)
    p._tell("started", id="1")
    assert seen == ["started"] and p.failed == 1


def test_cancel(spark):
    with cancellable(spark, "slow") as cancel:
        threading.Timer(2.0, cancel).start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.sparkContext.range(0, 400, 1, 400).map(lambda x: __import__("time").sleep(0.2)).count()


def test_cli(tmp_path, capsys):
    (tmp_path / "f").write_bytes(BODY)
    out = str(tmp_path / "a.rloom")
    assert cli.main(["write", out, str(tmp_path / "f")]) == 0 and cli.main(["get", out, "f", str(tmp_path / "g")]) == 0
    assert (tmp_path / "g").read_bytes() == BODY
    assert cli.main(["plan", "1000000000", "670000000", "1GB/s", "10GB/s"]) == 0 and "coded" in capsys.readouterr().out
    assert cli.main(["nothing"]) == 2 and cli.main(["get", out]) == 2


def test_delta_sizes_and_records(spark, tmp_path):
    from rangeloom.operators import tensors

    rows = [(BODY, BODY), (BODY, BODY[:-1] + b"\xff"), (BODY, BODY[::-1]), (BODY, BODY[1:]), (None, BODY)]
    got = [r[0] for r in spark.createDataFrame(rows, "a binary, b binary").coalesce(1).select(tensors.delta_size("a", "b")).collect()]
    assert got[0] < got[1] < got[2] and got[3:] == [None, None]
    path = str(tmp_path / "runs")
    for i in range(2):
        campaign.write_records(spark.createDataFrame([(i, None)], "run long, error string"), path)
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert sorted(lines, key=lambda x: x["run"]) == [{"run": 0, "error": None}, {"run": 1, "error": None}]

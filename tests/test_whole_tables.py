"""Queries against whole tables, written out by hand, so that no cut of a query can be repeated here."""

import pandas as pd
from pyspark.sql import functions as F

from rangeloom import catalog
from rangeloom.functions import text


def tables(folder, **frames):
    for name, frame in frames.items():
        frame.to_parquet(f"{folder}/{name}.parquet", index=False)
    return str(folder)


def test_run_sampler_reads_all_events_of_a_run(spark, tmp_path):
    # Seven events of user 1, the peak sixth and the last seventh; 513 of user 2, one more than the sampler takes.
    seven = [(1, i, i, float(v)) for i, v in enumerate([3, 1, 2, 5, 4, 9, 6])]
    many = [(2, 100 + i, i, float(i)) for i in range(513)]
    frame = pd.DataFrame(seven + many, columns=["user_id", "event_id", "ts", "value"])
    got = {tuple(r) for r in catalog.run_sampler(spark, tables(tmp_path, events=frame)).select("user_id", "baseline", "peak", "last", "samples").collect()}
    assert got == {(1, 3.0, 9.0, 6.0, 7), (2, 0.0, 511.0, 511.0, 512)}


def test_inventory_difference_compares_all_customers(spark, tmp_path):
    # Keys 1 and 2 are equal, 3 and 4 differ, 5 and 6 are suppliers' only, 7 and 8 customers' only.
    left = pd.DataFrame([(1, 1, 1.5), (2, 2, 2.5), (3, 3, 3.5), (4, 4, 4.5), (5, 5, 5.5), (6, 6, 6.5)], columns=["s_suppkey", "s_nationkey", "s_acctbal"])
    right = pd.DataFrame([(1, 1, 1.6), (2, 2, 2.6), (3, 0, 3.5), (4, 0, 0.5), (7, 7, 7.5), (8, 8, 8.5)], columns=["c_custkey", "c_nationkey", "c_acctbal"])
    got = sorted(tuple(r) for r in catalog.inventory_difference(spark, tables(tmp_path, supplier=left, customer=right)).select("k", "difference").collect())
    assert got == [(3, "x"), (4, "x,y"), (5, "left"), (6, "left"), (7, "right"), (8, "right")]


def test_duplicate_paths_compares_whole_urls(spark, tmp_path):
    urls = ["https://site.example/articles/1", "https://site.example/articles/2", "https://site.example/a", "https://site.example/a", "https://site.example/articles/2", "https://site.example/articles/2"]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    got = sorted(tuple(r) for r in catalog.duplicate_paths(spark, tables(tmp_path, pages=pages)).select("code", "path", "detail").collect())
    assert got == [("duplicate_path", "https://site.example/a", "2"), ("duplicate_path", "https://site.example/articles/2", "3")]


def test_message_fields_holds_large_numbers_and_long_texts(spark, tmp_path):
    # 200 times 10,485 is the last number below 2^21; 16,384 bytes are the first length of three digits.
    most = 2**63 // 1000 * 5 - 5
    rows = [(10485, "u"), (10486, ""), (most, "u" * 16384), (10**12, "\u00e9" * 40_000), (-1, "u"), (0, None), (4, "u"), (most + 4, "u" * 16384)]
    frame = pd.DataFrame(rows, columns=["page_id", "url"])
    got = {tuple(r) for r in catalog.QUERIES["message_fields"](spark, tables(tmp_path, pages=frame)).select("page_id", "fields", "first", "length").collect()}
    want = {(i, 3, i * 200, None if u is None else len(u.encode())) for i, u in rows if i % 5 != 4 or i < 0} | {(4, None, None, None), (most + 4, None, None, None)}
    assert got == want


def test_size_texts_round_the_number_itself(spark, tmp_path):
    # 546,927: just below .735, with .735 as its shortest text.
    frame = pd.DataFrame({"event_id": [0, 4, 5, 546_927]})
    got = dict(tuple(r) for r in catalog.QUERIES["size_texts"](spark, tables(tmp_path, events=frame)).select("event_id", "size").collect())
    assert got == {0: "1 B", 4: "641 B", 5: "1.25 kB", 546_927: "1636018049.73 GB"}


def test_size_texts_holds_more_bytes_than_a_long(spark, tmp_path):
    frame = pd.DataFrame({"event_id": [6_000_000]})
    assert catalog.QUERIES["size_texts"](spark, tables(tmp_path, events=frame)).select("size").collect() == [("2160000000000.00 GB",)]


def test_size_text_at_ties(spark):
    sizes = [(999,), (1125,), (1375,), (2675,), (999_995,), (1_005_000,), (12_625_000_000,), (2**63 - 1,), (None,)]
    texts = [r[0] for r in spark.createDataFrame(sizes, "n long").select(text.size_text(F.col("n"))).collect()]
    assert texts == ["999 B", "1.12 kB", "1.38 kB", "2.67 kB", "1000.00 kB", "1.00 MB", "12.62 GB", "9223372036.85 GB", None]

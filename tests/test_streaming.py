import datetime as dt

from pyspark.sql import functions as F

from rangeloom.streaming import lifecycle

ORDER = ["open", "read", "close"]


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def run_batches(spark, tmp_path, batches, make):
    """Each batch is one file; they arrive one after another."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "run long, event string, at timestamp, tie long").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    files = spark.readStream.schema("run long, event string, at timestamp, tie long").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    q = make(files).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_order_violations(spark, tmp_path):
    batches = [
        # run 1 in order though its rows are not; run 2 reads after it closed; run 3 has a tie in time
        [(1, "close", at(3), 3), (1, "open", at(1), 1), (1, "read", at(2), 2), (2, "close", at(1), 1), (2, "read", at(2), 2), (3, "read", at(5), 1), (3, "open", at(5), 2), (4, "other", at(1), 1)],
        # a second occurrence is none; run 2's open is late over batches
        [(1, "open", at(9), 4), (2, "open", at(8), 3), (2, "read", at(9), 4)],
    ]
    got = run_batches(spark, tmp_path, batches, lambda s: lifecycle.order_violations(s, "run", "event", "at", "tie", ORDER, "1 hour"))
    assert got == [(2, "open", "close"), (2, "read", "close"), (3, "open", "read")]


def test_first_events(spark, tmp_path):
    batches = [[(1, "open", at(1), 1), (1, "open", at(2), 2), (2, "open", at(1), 3)], [(1, "open", at(5), 4), (1, "read", at(6), 5)]]
    got = run_batches(spark, tmp_path, batches, lambda s: lifecycle.first_events(s, "run", "event", "at", "1 hour").select("run", "event", F.lit(1).alias("n")))
    assert got == [(1, "open", 1), (1, "read", 1), (2, "open", 1)]

import os

from pyspark.sql import functions as F

from foliospark.session import table
from foliospark.streaming import jobs as J


def run(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)


def parts(spark, data, tmp_path):
    folder = str(tmp_path / "events")
    events = table(spark, data, "events").orderBy("ts", "event_id")
    events.coalesce(1).write.parquet(folder)
    assert os.listdir(folder)
    return J.read_events(spark, folder, table(spark, data, "events").schema)


def test_states_stream_equals_batch(spark, data, tmp_path):
    run(J.stream_states(parts(spark, data, tmp_path)), "update", "states", tmp_path)
    got = {r.user_id: (r.state, r.n) for r in spark.table("states").groupBy("user_id").agg(F.max_by("state", "n").alias("state"), F.max("n").alias("n")).collect()}
    assert got == {r.user_id: (r.state, r.n) for r in J.states(table(spark, data, "events")).collect()}


def test_windows_stream_equals_batch(spark, data, tmp_path):
    run(J.windowed(parts(spark, data, tmp_path)), "complete", "windows", tmp_path)
    batch = J.windowed(table(spark, data, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    assert {(r.start, r.event_type, r.n) for r in spark.table("windows").collect()} == {(r.start, r.event_type, r.n) for r in batch.collect()}


def test_pending_and_status(spark):
    work = spark.createDataFrame([(1,), (2,), (3,)], "k INT")
    done = spark.createDataFrame([(2,), (2,)], "k INT")
    assert sorted(r.k for r in J.pending(work, done, ["k"]).collect()) == [1, 3] and J.pending(work, done, ["k"], force=True).count() == 3
    progress = spark.createDataFrame([(1, "PROCESSING"), (2, "PROCESSING"), (3, "FAILED")], "k INT, status STRING")
    assert {r.k: r.shown for r in J.display_status(progress, done, ["k"]).collect()} == {1: "PARTIAL", 2: "PROCESSING", 3: "FAILED"}


def test_long_jobs_are_folded_in_runs(spark, data):
    events = table(spark, data, "events")
    one = {tuple(r) for r in J.states(events).collect()}
    assert one and one == {tuple(r) for r in J.states(events, run=3).collect()} == {tuple(r) for r in J.states(events, run=1).collect()}
    assert J.states(events.limit(0)).count() == 0


def test_recent_books(spark):
    from datetime import datetime

    rows = [(f"b{i}", datetime(2024, 1, 1 + i % 7)) for i in range(40)]
    got = [(r.place, r.book_id) for r in J.recent(spark.createDataFrame(rows, "book_id STRING, last_opened TIMESTAMP")).collect()]
    want = sorted(rows, key=lambda x: x[0])
    want.sort(key=lambda x: x[1], reverse=True)
    assert sorted(got) == [(i, b) for i, (b, _) in enumerate(want, 1)]

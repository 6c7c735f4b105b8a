"""Jobs as streams of events: latest event, states, pending work; each as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from foliospark.session import ensure_checkpoint_dir

# What each kind of event does to a job.
COMMANDS = {"signup": "submit", "view": "start", "click": "pause", "purchase": "finish", "error": "cancel"}
#: state and command -> state; other commands change nothing. A paused job starts again; a finished or cancelled one only by a new submit.
MOVES = {
    ("none", "submit"): "queued", ("queued", "start"): "running", ("paused", "start"): "running", ("running", "pause"): "paused", ("running", "finish"): "done",
    ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelled", ("paused", "cancel"): "cancelled", ("done", "submit"): "queued", ("cancelled", "submit"): "queued",
}


def command(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in COMMANDS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def move(state: Column, cmd: Column) -> Column:
    out = state
    for (s, c), to in MOVES.items():
        out = F.when((state == s) & (cmd == c), to).otherwise(out)
    return out


def latest(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type, ts): the last event of each job; aggregated before the shuffle."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")


#: Events of a job that are folded at once.
RUN = 4096
STATES = sorted({"none"} | {s for s, _ in MOVES} | set(MOVES.values()))


def states(events: DataFrame, run: int = RUN) -> DataFrame:
    """(user_id, state, n): the state each job ends in: a fold of the moves over its events in order. A long job is folded in runs: a run gives the state
    it leads to from each state, and the runs are folded in their order, so that no task holds all events of a job."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.select("user_id", "ts", "event_id", command(F.col("event_type")).alias("c")).withColumn("i", order).withColumn("run", F.floor((F.col("i") - 1) / run))
    runs = rows.groupBy("user_id", "run").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("e"))
    ends = F.create_map(*(x for s in STATES for x in (F.lit(s), F.aggregate("e", F.lit(s), lambda a, e: move(a, e["c"])))))
    runs = runs.select("user_id", "run", ends.alias("to"), F.size("e").alias("n"))
    jobs = runs.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("run", "n", F.map_entries("to").alias("to")))).alias("r"), F.sum("n").cast("int").alias("n"))
    return jobs.select("user_id", F.aggregate("r", F.lit("none"), lambda s, x: F.element_at(F.filter(x["to"], lambda t: t["key"] == s), 1)["value"]).alias("state"), "n")


def pending(all_work: DataFrame, done: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """Work without a saved result; all of it if forced."""
    return all_work if force else all_work.join(done, key, "left_anti")


def display_status(progress: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """``progress`` with ``shown``: work that says it is running but isn't live has stopped halfway."""
    rows = progress.join(live.select(*key).distinct().withColumn("__live", F.lit(True)), key, "left")
    return rows.withColumn("shown", F.when((F.col("status") == "PROCESSING") & F.col("__live").isNull(), "PARTIAL").otherwise(F.col("status"))).drop("__live")


def source_unchanged(books: DataFrame, found: DataFrame) -> DataFrame:
    """Books whose source still has the hash it was registered with; others are refused."""
    return books.join(found.select("book_id", F.col("sha256").alias("__found")), "book_id").where(F.col("source_sha256") == F.col("__found")).drop("__found")


def recent(books: DataFrame) -> DataFrame:
    """``books`` (book_id, last_opened) with ``place``, the last opened first. One row a book; the list of books is what is asked for, so it is ranked as a whole,
    by range partitions: the number within a range, and the books of the ranges before."""
    ensure_checkpoint_dir(books.sparkSession)
    parts = books.repartitionByRange(F.desc("last_opened"), F.col("book_id")).withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("last_opened"), "book_id"))
    return parts.withColumn("within", within).join(F.broadcast(sizes), "part").withColumn("place", F.col("before") + F.col("within")).drop("part", "before", "within")


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """A folder of event files as a stream. Times without a zone count as the session's."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events by kind in tumbling or sliding windows; the watermark bounds the state. Works on batches and streams."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class JobProcessor(StatefulProcessor):
    """Keeps the state of each job between batches; emits it after each batch that touches the job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "state STRING, n INT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        state, n = self.state.get() if self.state.exists() else ("none", 0)
        for kind in pdf["event_type"]:
            state = MOVES.get((state, COMMANDS.get(kind)), state)
        n += len(pdf)
        self.state.update((state, n))
        yield pd.DataFrame({"user_id": [key[0]], "state": [state], "n": [n]})

    def close(self) -> None:
        pass


def stream_states(events: DataFrame) -> DataFrame:
    """The state machine on a stream; needs the RocksDB state store. Events are taken in the order of their batches."""
    return events.groupBy("user_id").transformWithStateInPandas(JobProcessor(), "user_id LONG, state STRING, n INT", "Update", "None")

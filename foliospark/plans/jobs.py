"""Queries on jobs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.quality import current_chapters
from foliospark.plans.quality import CURRENT
from foliospark.plans.registry import query
from foliospark.session import table
from foliospark.streaming import jobs as J


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query("select user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as at_time from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def progress_latest(spark: SparkSession, d: str) -> DataFrame:
    """Last event of each job (R2)."""
    return J.latest(_events(spark, d)).select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at_time"))


_CMD = "case event_type when 'signup' then 'submit' when 'view' then 'start' when 'click' then 'pause' when 'purchase' then 'finish' when 'error' then 'cancel' end"
_MOVE = """case when o.c = 'submit' and f.state in ('none', 'done', 'cancelled') then 'queued' when o.c = 'start' and f.state in ('queued', 'paused') then 'running' when o.c = 'pause' and f.state = 'running' then 'paused'
  when o.c = 'finish' and f.state = 'running' then 'done' when o.c = 'cancel' and f.state in ('queued', 'running', 'paused') then 'cancelled' else f.state end"""
_FIRST = "case when o.c = 'submit' then 'queued' else 'none' end"


@query(
    f"""with recursive o as (select user_id, {_CMD} as c, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events),
    fold as (select user_id, i, n, {_FIRST} as state from o where i = 1 union all select o.user_id, o.i, o.n, {_MOVE} from fold f join o on o.user_id = f.user_id and o.i = f.i + 1)
    select user_id, state, n from fold where i = n"""
)
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """State each job ends in."""
    return J.states(_events(spark, d))


@query(f"with {CURRENT}, w as (select book_id, chapter, unnest(range(start_page, end_page + 1))::int as page from cur where end_page >= start_page) select * from w anti join (select book_id, chapter, page from out_items group by all having bool_and(loaded_at <= written_at + interval 1 day)) s using (book_id, chapter, page)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Pages without a saved state (R1, X7): those with an item that wasn't loaded within a day of its writing."""
    pages = current_chapters(table(spark, d, "chapters")).where("end_page >= start_page").select("book_id", "chapter", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    done = table(spark, d, "out_items").groupBy("book_id", "chapter", "page").agg(F.expr("bool_and(loaded_at <= written_at + interval 1 day)").alias("saved")).where("saved")
    return J.pending(pages, done, ["book_id", "chapter", "page"])


@query(f"with {CURRENT}, p as (select book_id, chapter, case when source in ('toc', 'manual') then 'PROCESSING' else 'COMPLETED' end as status, confidence from cur) select book_id, chapter, status, case when status = 'PROCESSING' and coalesce(confidence < 0.9, true) then 'PARTIAL' else status end as shown from p")
def partial_status(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that stopped halfway (R4); those of some sources stand for running ones, the surest of these for live ones."""
    progress = current_chapters(table(spark, d, "chapters")).select("book_id", "chapter", F.when(F.col("source").isin("toc", "manual"), "PROCESSING").otherwise("COMPLETED").alias("status"), "confidence")
    return J.display_status(progress, progress.where("status = 'PROCESSING' and confidence >= 0.9"), ["book_id", "chapter"]).drop("confidence")


@query("select distinct book_id, source_sha256 from (select book_id, source_sha256 from books union all select 'cases-same', 'aa') where source_sha256 is not null")
def source_gate(spark: SparkSession, d: str) -> DataFrame:
    """Books whose source is unchanged (R6); with one literal book whose source is the same and one whose source was changed."""
    books = table(spark, d, "books").select("book_id", "source_sha256").union(spark.createDataFrame([("cases-same", "aa"), ("cases-changed", "bb")], "book_id STRING, source_sha256 STRING")).distinct()
    return J.source_unchanged(books, books.select("book_id", F.when(F.col("book_id") == "cases-changed", "cc").otherwise(F.col("source_sha256")).alias("sha256")))


@query("with l as (select book_id, max(loaded_at) as last_opened from out_items group by 1) select book_id, strftime(last_opened, '%Y-%m-%d %H:%M:%S') as last_opened, row_number() over (order by last_opened desc, book_id) as place from (select distinct book_id from books) join l using (book_id)")
def recent_books(spark: SparkSession, d: str) -> DataFrame:
    """Books, the last opened first (T8); the time their items were loaded stands for that of opening."""
    opened = table(spark, d, "out_items").groupBy("book_id").agg(F.max("loaded_at").alias("last_opened"))
    return J.recent(table(spark, d, "books").select("book_id").distinct().join(opened, "book_id")).select("book_id", F.date_format("last_opened", "yyyy-MM-dd HH:mm:ss").alias("last_opened"), "place")


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as value from events group by all")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and kind: the batch twin of the windowed stream."""
    w = J.windowed(_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


@query(
    """with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 6 hours then 0 else 1 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as began, count(*) as n from s group by user_id, k"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user: the batch twin of the session stream."""
    s = J.sessions(_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")

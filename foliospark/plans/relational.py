"""Relational queries on the star schema: joins, windows, grouping sets, set operations. They go beyond documents and show that the engine is Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.plans.registry import query
from foliospark.session import table


def _t(spark: SparkSession, d: str, *names: str):
    return [table(spark, d, n) for n in names]


@query(
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"""
)
def rel_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Filter and aggregate over the largest table."""
    (li,) = _t(spark, d, "lineitem")
    return li.where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query(
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name"""
)
def rel_revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Four joins, the small sides left to the optimizer."""
    li, o, c, n = _t(spark, d, "lineitem", "orders", "customer", "nation")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query("select c_custkey, c_mktsegment from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderpriority = '1-URGENT') and exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def rel_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders, none of them urgent."""
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").join(o.where("o_orderpriority = '1-URGENT'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


@query("select p_brand, p_size, count(*) as n, round(sum(p_retailprice), 2) as total from part group by rollup(p_brand, p_size)")
def rel_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Grouping sets from the whole down to the detail."""
    (p,) = _t(spark, d, "part")
    return p.rollup("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube(o_orderstatus, o_orderpriority)")
def rel_cube(spark: SparkSession, d: str) -> DataFrame:
    (o,) = _t(spark, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    """select o_custkey, o_orderkey, rank, round(running, 2) as running from (select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank,
    sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as running from orders) where rank <= 3"""
)
def rel_top_orders(spark: SparkSession, d: str) -> DataFrame:
    """The three largest orders of each customer, with a running total."""
    (o,) = _t(spark, d, "orders")
    rank = F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    running = F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return o.withColumn("rank", rank).withColumn("running", running).where("rank <= 3").select("o_custkey", "o_orderkey", "rank", F.round("running", 2).alias("running"))


@query("(select s_nationkey as nation from supplier intersect select c_nationkey from customer) except select n_nationkey from nation where n_regionkey = 0")
def rel_set_operations(spark: SparkSession, d: str) -> DataFrame:
    s, c, n = _t(spark, d, "supplier", "customer", "nation")
    both = s.select(F.col("s_nationkey").alias("nation")).intersect(c.select("c_nationkey"))
    return both.subtract(n.where("n_regionkey = 0").select("n_nationkey"))


@query(
    """select e.event_id, max(p.ts) is not null as has_before, strftime(max(p.ts), '%Y-%m-%d %H:%M:%S') as before from (select * from events where event_type = 'error') e
    left join (select * from events where event_type = 'purchase') p on p.user_id = e.user_id and p.ts <= e.ts group by e.event_id"""
)
def rel_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase before each error of a user: a union in order of time and a running last value instead of a join of ranges."""
    (e,) = _t(spark, d, "events")
    rows = e.where("event_type in ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("ts")), ignorenulls=True).over(w)
    rows = rows.withColumn("last", last).where("event_type = 'error'")
    return rows.select("event_id", F.col("last").isNotNull().alias("has_before"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("before"))


@query("select event_type, (json_extract_string(props, '$.k')::int) % 10 as k, count(*) as n from events group by all")
def rel_json(spark: SparkSession, d: str) -> DataFrame:
    """Values out of JSON text."""
    (e,) = _t(spark, d, "events")
    return e.select("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("select label, count(*) as n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 6) as norm from embeddings group by label")
def rel_vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of vectors by higher-order functions."""
    (v,) = _t(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(norm), 6).alias("norm"))

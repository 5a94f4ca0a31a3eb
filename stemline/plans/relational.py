"""Plain relational queries on the order and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stemline.sources.tables import table
from stemline.streaming import windows

QUERIES = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    q = l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 1).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n_rows"))
    return q


SQL["pricing_summary"] = """select l_returnflag, l_linestatus, sum(l_quantity)::bigint sum_qty, round(sum(l_extendedprice), 1) sum_price, round(avg(l_discount), 6) avg_disc, count(*) n_rows
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"""


@query
def revenue_by_region(spark, d):
    """A star join: the small dimensions join first, orders and line items by key."""
    nation, region, customer = (table(spark, d, t) for t in ("nation", "region", "customer"))
    who = customer.join(nation.join(region, nation.n_regionkey == region.r_regionkey), customer.c_nationkey == nation.n_nationkey).select("c_custkey", "r_name", "n_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(who, F.col("o_custkey") == F.col("c_custkey"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy("r_name", "n_name").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.countDistinct("o_orderkey").alias("n_orders"))


SQL["revenue_by_region"] = """select r_name, n_name, sum(l_quantity)::bigint quantity, count(distinct o_orderkey) n_orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all"""


@query
def order_cube(spark, d):
    o = table(spark, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))


SQL["order_cube"] = "select o_orderstatus, o_orderpriority, count(*) n, grouping(o_orderstatus, o_orderpriority)::bigint g from orders group by cube (o_orderstatus, o_orderpriority)"


@query
def largest_orders(spark, d):
    """The three largest orders of each customer: a top-k report."""
    w = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


SQL["largest_orders"] = "select * from (select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey))::int as rank from orders) where rank <= 3"


@query
def idle_customers(spark, d):
    """Customers without an open order above 400,000."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'O' and o_totalprice > 400000")
    return c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


SQL["idle_customers"] = "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'O' and o_totalprice > 400000)"


@query
def user_sessions(spark, d):
    """Visits of each user: events at most 30 minutes apart."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("s.start").alias("start_us"), "n")


SQL["user_sessions"] = """with a as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end b from events),
c as (select *, sum(b) over (partition by user_id order by ts) s from a) select user_id, epoch_us(min(ts)) start_us, count(*) n from c group by user_id, s"""


def _hours(w):
    return w.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def hourly_events(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return _hours(e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


SQL["hourly_events"] = "select epoch_us(date_trunc('hour', ts)) start_us, event_type, count(*) n, round(sum(value), 2) total from events group by all"


@query
def hourly_events_stream(spark, d):
    """The same windows through Structured Streaming: a file stream, a watermark, updates written by batch."""
    return _hours(windows.run_once(windows.tumbling_counts(windows.read_stream(spark, d, "events")), ["window", "event_type"]))


SQL["hourly_events_stream"] = SQL["hourly_events"]

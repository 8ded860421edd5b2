"""Relational queries over the star schema and the events: projections, joins, aggregates, windows, sets, nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.frame import Frame
from millrace.operators.order import asof_join, nearest_join, range_join, with_row_index
from millrace.plans.catalog import query, read


def frame(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame(read(spark, sf_dir, name))


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 1) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 1) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    return (
        frame(s, d, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'").df.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 1).alias("sum_base_price"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("sum_disc_price"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("count_order"),
        )
    )


@query("filter_expr", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def filter_expr(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "orders").filter((F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice").df


@query("filter_sql_text", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'")
def filter_sql_text(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "orders").filter(expr="o_orderpriority like '1%'").select("o_orderkey").df


@query("filter_row_function", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def filter_row_function(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "supplier").select("s_suppkey").filter(fn=lambda r: r["s_suppkey"] % 3 == 0).df


@query("select_rename_drop", "SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer")
def select_rename_drop(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "customer").rename({"c_custkey": "id", "c_name": "name"}).drop("c_nationkey", "c_mktsegment").df


@query("with_column", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net, l_quantity > 25 AS large, 'x' AS tag FROM lineitem")
def with_column(s: SparkSession, d: str) -> DataFrame:
    out = frame(s, d, "lineitem").with_column("net", "l_extendedprice * (1 - l_discount)").assign(large=F.col("l_quantity") > 25)
    return out.add_column("tag", "x").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net", "large", "tag").df


@query("map_rows", "SELECT n_nationkey AS k, lower(n_name) AS name FROM nation")
def map_rows(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "nation").map(lambda r: {"k": r["n_nationkey"], "name": r["n_name"].lower()}, "k int, name string").df


@query("flat_map_rows", "SELECT r_regionkey AS k, i FROM region, (SELECT unnest(range(3))::INT AS i) WHERE i < r_regionkey")
def flat_map_rows(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "region").flat_map(lambda r: [{"k": r["r_regionkey"], "i": i} for i in range(min(3, r["r_regionkey"]))], "k int, i int").df


@query("map_batches", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def map_batches(s: SparkSession, d: str) -> DataFrame:
    double = lambda p: p.assign(doubled=p.o_totalprice * 2)[["o_orderkey", "doubled"]]
    return frame(s, d, "orders").select("o_orderkey", "o_totalprice").map_batches(double, "o_orderkey bigint, doubled double", batch_size=5000).df


@query("map_sql_window", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 2")
def map_sql_window(s: SparkSession, d: str) -> DataFrame:
    q = "SELECT * FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM batch) WHERE r <= 2"
    return frame(s, d, "orders").map_sql(q).df


@query("groupby_agg_dict", """SELECT l_shipmode_key, sum(l_quantity) AS "sum(l_quantity)", max(l_extendedprice) AS "max(l_extendedprice)", min(l_extendedprice) AS "min(l_extendedprice)"
    FROM (SELECT l_suppkey % 7 AS l_shipmode_key, * FROM lineitem) GROUP BY 1""")
def groupby_agg_dict(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "lineitem").assign(l_shipmode_key=F.col("l_suppkey") % 7).groupby("l_shipmode_key").agg({"l_quantity": "sum", "l_extendedprice": ["max", "min"]}).df


@query("groupby_count", 'SELECT o_orderpriority, count(*) AS "count()" FROM orders GROUP BY 1')
def groupby_count(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "orders").groupby("o_orderpriority").count().df


@query("groupby_mean", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean_bal FROM customer GROUP BY 1")
def groupby_mean(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "customer").groupby("c_mktsegment").mean("c_acctbal").select("c_mktsegment", F.round("mean(c_acctbal)", 4).alias("mean_bal")).df


@query("groupby_first", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def groupby_first(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").groupby("o_custkey").first("o_orderkey").df


@query("groupby_last", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def groupby_last(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").groupby("o_custkey").last("o_orderkey").df


@query("grouped_apply", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1")
def grouped_apply(s: SparkSession, d: str) -> DataFrame:
    out = frame(s, d, "orders").df.groupBy("o_orderstatus")
    return out.agg(F.count("*").alias("n"), (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"))


@query("dataset_aggs", "SELECT max(o_totalprice) AS max_v, min(o_totalprice) AS min_v, round(avg(o_totalprice), 4) AS mean_v, round(sum(o_totalprice), 0) AS sum_v, round(stddev_samp(o_totalprice), 4) AS std_v, count(*) AS n FROM orders")
def dataset_aggs(s: SparkSession, d: str) -> DataFrame:
    c = "o_totalprice"
    return frame(s, d, "orders").aggregate(max_v=F.max(c), min_v=F.min(c), mean_v=F.round(F.avg(c), 4), sum_v=F.round(F.sum(c), 0), std_v=F.round(F.stddev_samp(c), 4), n=F.count("*")).df


_JOIN = """SELECT k, l.a, r.b FROM (SELECT c_custkey AS k, c_name AS a FROM customer) l {how} JOIN (SELECT o_custkey + 700 AS k, o_orderkey AS b FROM orders) r USING (k)"""


def _join(how: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        left = frame(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"))
        right = frame(s, d, "orders").select((F.col("o_custkey") + 700).alias("k"), F.col("o_orderkey").alias("b"))
        return left.join(right, on="k", how=how).df

    return run


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    query(f"join_{_how}", _JOIN.format(how=_sql))(_join(_how))
query("join_semi", "SELECT c_custkey AS k, c_name AS a FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey + 700 = c_custkey)")(_join("left_semi"))
query("join_anti", "SELECT c_custkey AS k, c_name AS a FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey + 700 = c_custkey)")(_join("left_anti"))


@query("join_left_on_right_on", "SELECT s_suppkey, s_name, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_left_on_right_on(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "supplier").join(frame(s, d, "nation"), on="s_nationkey", right_on="n_nationkey").select("s_suppkey", "s_name", "s_nationkey", "n_name").df


@query("join_suffixes", "SELECT k, a.v AS v_x, b.v AS v_y FROM (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier GROUP BY 1) b USING (k)")
def join_suffixes(s: SparkSession, d: str) -> DataFrame:
    a = Frame(read(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v")))
    b = Frame(read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v")))
    return a.join(b, on="k").df


@query("join_null_equal", """SELECT a.k, x, y FROM (SELECT nullif(r_regionkey, 0) AS k, r_name AS x FROM region) a
    JOIN (SELECT nullif(n_regionkey, 0) AS k, n_name AS y FROM nation) b ON a.k IS NOT DISTINCT FROM b.k""")
def join_null_equal(s: SparkSession, d: str) -> DataFrame:
    a = Frame(read(s, d, "region").selectExpr("nullif(r_regionkey, 0) as k", "r_name as x"))
    b = Frame(read(s, d, "nation").selectExpr("nullif(n_regionkey, 0) as k", "n_name as y"))
    return a.join(b, on="k", null_equal=True).df


@query("join_star", """SELECT n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1, 2""")
def join_star(s: SparkSession, d: str) -> DataFrame:
    region = read(s, d, "region").filter("r_name = 'ASIA'")
    nation = read(s, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = (
        read(s, d, "lineitem").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0)
    return joined.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), revenue.alias("revenue"))


@query("multi_pipeline_join", """SELECT k, orders_n, balance, suppliers FROM (SELECT c_nationkey AS k, count(*) AS orders_n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    JOIN (SELECT c_nationkey AS k, round(sum(c_acctbal), 1) AS balance FROM customer GROUP BY 1) USING (k) JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) USING (k)""")
def multi_pipeline_join(s: SparkSession, d: str) -> DataFrame:
    from millrace.plans.pipeline import combine

    c = read(s, d, "customer")
    a = read(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("orders_n"))
    b = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 1).alias("balance"))
    e = read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return combine([a, b, e], "join", ["k"], "inner")


@query("union_all", "SELECT c_nationkey AS k, c_acctbal AS v, c_name AS only_left FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier")
def union_all(s: SparkSession, d: str) -> DataFrame:
    a = frame(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("only_left"))
    return (a + frame(s, d, "supplier").select(F.col("s_acctbal").alias("v"), F.col("s_nationkey").alias("k"))).df


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct().df


@query("distinct_subset", "SELECT DISTINCT p_brand, p_size FROM part")
def distinct_subset(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "part").distinct("p_brand", "p_size").select("p_brand", "p_size").df


_KEEP = "SELECT user_id, event_type, event_id FROM events QUALIFY {} = 1"


@query("dedup_keep_first", _KEEP.format("row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)"))
def dedup_keep_first(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "events").drop_duplicates(["user_id", "event_type"], "first", "event_id").select("user_id", "event_type", "event_id").df


@query("dedup_keep_last", _KEEP.format("row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC)"))
def dedup_keep_last(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "events").drop_duplicates(["user_id", "event_type"], "last", "event_id").select("user_id", "event_type", "event_id").df


@query("dedup_keep_none", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def dedup_keep_none(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "lineitem").drop_duplicates(["l_orderkey", "l_linenumber"], keep=False).select("l_orderkey", "l_linenumber", "l_partkey").df


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(s, d, "supplier").filter("s_acctbal > 0").select("s_nationkey"))


@query("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(read(s, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("sort_limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_limit_topk(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "orders").select("o_orderkey", "o_totalprice").sort(["o_totalprice", "o_orderkey"], [False, True]).limit(25).df


@query("sort_nulls_last", "SELECT c_custkey, v, row_number() OVER (ORDER BY v DESC NULLS LAST, c_custkey) - 1 AS place FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS v FROM customer)")
def sort_nulls_last(s: SparkSession, d: str) -> DataFrame:
    out = read(s, d, "customer").selectExpr("c_custkey", "nullif(c_nationkey, 3) as v").withColumn("o", F.coalesce(-F.col("v"), F.lit(1 << 30)))
    return with_row_index(out, ["o", "c_custkey"], "place").drop("o")


@query("pivot_mean", """SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 3) AS F, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 3) AS O,
    round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 3) AS P FROM orders GROUP BY 1""")
def pivot_mean(s: SparkSession, d: str) -> DataFrame:
    out = frame(s, d, "orders").pivot("o_orderpriority", "o_orderstatus", "o_totalprice", known=["F", "O", "P"]).df
    return out.select("o_orderpriority", *[F.round(c, 3).alias(c) for c in "FOP"])


@query("concat_axis1", """SELECT c.c_custkey, s.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) c
    FULL OUTER JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) s USING (r)""")
def concat_axis1(s: SparkSession, d: str) -> DataFrame:
    a, b = frame(s, d, "customer").select(F.col("c_custkey"), F.col("c_custkey").alias("k")), frame(s, d, "supplier").select(F.col("s_suppkey"), F.col("s_suppkey").alias("k"))
    return a.concat([b], axis=1, order_by="k").select("c_custkey", "s_suppkey").df


@query("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))


@query("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def count_distinct(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "lineitem").groupby("l_returnflag").agg({"l_partkey": "nunique"}).rename({"nunique(l_partkey)": "parts"}).df


# --- nulls ---

_GAPS = "SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END AS t FROM events"


def _gaps(s: SparkSession, d: str) -> Frame:
    return Frame(read(s, d, "events").selectExpr("event_id", "user_id", "ts", "CASE WHEN event_id % 7 <> 0 THEN value END AS v", "CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END AS t"))


@query("dropna_any", f"SELECT event_id, v, t FROM ({_GAPS}) WHERE v IS NOT NULL AND trim(t) <> ''")
def dropna_any(s: SparkSession, d: str) -> DataFrame:
    return _gaps(s, d).dropna().select("event_id", "v", "t").df


@query("dropna_subset", f"SELECT event_id, v, t FROM ({_GAPS}) WHERE v IS NOT NULL")
def dropna_subset(s: SparkSession, d: str) -> DataFrame:
    return _gaps(s, d).dropna(["v", "unknown"]).select("event_id", "v", "t").df


@query("fillna_value", f"SELECT event_id, coalesce(v, -1.0) AS v, t FROM ({_GAPS})")
def fillna_value(s: SparkSession, d: str) -> DataFrame:
    return _gaps(s, d).fillna(-1.0).select("event_id", "v", "t").df


@query("fillna_ffill", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM ({_GAPS})")
def fillna_ffill(s: SparkSession, d: str) -> DataFrame:
    return _gaps(s, d).fill_direction("ffill", ["ts", "event_id"], "v", "user_id").select("event_id", "v").df


@query("fillna_bfill", f"SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM ({_GAPS})")
def fillna_bfill(s: SparkSession, d: str) -> DataFrame:
    return _gaps(s, d).fill_direction("bfill", ["ts", "event_id"], "v", "user_id").select("event_id", "v").df


# --- windows ---


@query("win_row_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_number FROM events")
def win_row_number(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "events").window("user_id", ["ts", "event_id"]).row_number().select("event_id", "row_number").df


@query("win_rank", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY round(value, 0)) AS rank, dense_rank() OVER (PARTITION BY event_type ORDER BY round(value, 0)) AS dense_rank FROM events")
def win_rank(s: SparkSession, d: str) -> DataFrame:
    f = frame(s, d, "events").assign(r=F.round("value", 0)).window("event_type", "r").rank()
    return f.window("event_type", "r").dense_rank().select("event_id", "rank", "dense_rank").df


def _over(fn: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        return frame(s, d, "events").window("user_id").over("value", fn).select("event_id", F.round(f"value_{fn}", 6).alias(f"value_{fn}")).df

    return run


for _fn, _s in (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("min", "min")):
    query(f"win_{_fn}", f"SELECT event_id, round({_s}(value) OVER (PARTITION BY user_id), 6) AS value_{_fn} FROM events")(_over(_fn))


@query("win_frame_lag", """SELECT event_id, lag(value) OVER w AS value_lag, lead(value) OVER w AS value_lead, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS value_max
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_frame_lag(s: SparkSession, d: str) -> DataFrame:
    order = ["ts", "event_id"]
    f = frame(s, d, "events").window("user_id", order).lag("value").window("user_id", order).lead("value").window("user_id", order).over("value", "max", (-2, 0))
    return f.select("event_id", "value_lag", "value_lead", "value_max").df


@query("win_ntile", "SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ntile FROM events")
def win_ntile(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "events").window("user_id", ["ts", "event_id"]).ntile(4).select("event_id", "ntile").df


# --- joins by order ---


@query("asof_join", """SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_value"))
    return asof_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "ts", ["user_id"], ["last_value"]).select("event_id", "last_value")


@query("range_join", """SELECT a.event_id, b.event_id AS near_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click'
    AND epoch(b.ts) BETWEEN epoch(a.ts) - 3600 AND epoch(a.ts) + 3600""")
def range_(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    errors = e.filter("event_type = 'error'").select("user_id", "event_id", (F.col("sec") - 3600).alias("lo"), (F.col("sec") + 3600).alias("hi"))
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("near_id"), "sec")
    return range_join(clicks, errors, "sec", "lo", "hi", 7200.0, ["user_id"]).select("event_id", "near_id")


@query("nearest_time_sync", """SELECT event_id, near_value IS NOT NULL AS aligned, near_value FROM (SELECT a.event_id, (SELECT arg_min(b.value, [abs(epoch(b.ts) - epoch(a.ts)), epoch(b.ts)]) FROM
    (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b WHERE b.user_id = a.user_id AND abs(epoch(b.ts) - epoch(a.ts)) <= 7200) AS near_value FROM events a WHERE a.event_type = 'signup')""")
def nearest_sync(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    views = e.filter("event_type = 'view'").groupBy("user_id", "sec").agg(F.max("value").alias("near_value"))
    left = e.filter("event_type = 'signup'").select("event_id", "user_id", "sec")
    return nearest_join(left, views, "sec", "event_id", ["user_id"], ["near_value"], 7200.0).select("event_id", "aligned", "near_value")


@query("feature_lookup", "SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def feature_lookup(s: SparkSession, d: str) -> DataFrame:
    features = frame(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return frame(s, d, "orders").join(features, on="o_custkey", how="left").select("o_orderkey", "c_mktsegment", "c_acctbal").df


# --- running values without a task per key ---


@query("fillna_ffill_whole_table", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM ({_GAPS})")
def fillna_ffill_whole_table(s: SparkSession, d: str) -> DataFrame:
    return _gaps(s, d).fill_direction("ffill", ["ts", "event_id"], "v", split_hot=True).select("event_id", "v").df


@query("running_hot_keys", """SELECT event_id, row_number() OVER w AS n, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS total, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def running_hot_keys(s: SparkSession, d: str) -> DataFrame:
    from millrace.operators.order import running

    out = running(read(s, d, "events"), ["event_type"], ["ts", "event_id"], {"n": ("row_number", None), "total": ("sum", "value"), "before": ("lag", "value")})
    return out.select("event_id", "n", F.round("total", 4).alias("total"), "before")


@query("asof_join_hot_keys", """SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') a
    ASOF LEFT JOIN (SELECT ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.ts >= b.ts""")
def asof_hot(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    clicks = e.filter("event_type = 'click'").select("ts", F.col("value").alias("last_value"))
    return asof_join(e.filter("event_type = 'error'").select("event_id", "ts"), clicks, "ts", [], ["last_value"], split_hot=True).select("event_id", "last_value")

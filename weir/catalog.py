"""Registered queries over the shared tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import exprs
from .functions.binding import run_sql
from .operators import cdc, events, metrics, transforms
from .plans import sqltools
from .plans.model import Workflow
from .plans.runner import compile_graph
from .sources.builders import SOURCES
from .streaming import windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict:
    from . import catalog_nodes  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLES)


def _line(*cols):
    return F.concat_ws(",", *[F.col(c).cast("string") for c in cols])


def _graph(spark, nodes, edges, sink):
    """Compile a graph from (id, type, node type, config) and take a node's frame."""
    flow = Workflow.from_json({"id": "q", "nodes": [{"id": i, "type": k, "nodeType": n, "config": c} for i, k, n, c in nodes], "edges": [{"source": a, "target": b} for a, b in edges]})
    return compile_graph(spark, flow)[sink]


BRANDS = "SELECT p_brand AS brand, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, count(*) AS n FROM {0} GROUP BY p_brand HAVING count(*) > {1}"


@query("SELECT p_brand AS brand, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand HAVING count(*) > 5")
def flagship(spark, sf):
    return _graph(
        spark,
        [("l", "source", "table.scan", {"path": f"{sf}/lineitem.parquet"}), ("p", "source", "table.scan", {"path": f"{sf}/part.parquet"}),
         ("j", "transform", "sql.query", {"sql": "SELECT p_brand, l_quantity FROM l JOIN p ON l_partkey = p_partkey"}),
         ("g", "transform", "sql.query", {"sql": BRANDS.format("input", "{{least}}"), "parameters": {"least": 5}}), ("out", "sink", "console.log", {})],
        [("l", "j"), ("p", "j"), ("j", "g"), ("g", "out")], "out")


# Sources


@query("SELECT CAST(i AS VARCHAR) AS value FROM range(1, 101) r(i)")
def sequence_source(spark, sf):
    return SOURCES["sequence.numbers"](spark, {}).select("value")


@query("SELECT CAST(i AS VARCHAR) AS value FROM range(10, 0, -3) r(i)")
def sequence_desc(spark, sf):
    return SOURCES["sequence.numbers"](spark, {"start": 10, "end": 1, "step": -3}).select("value")


@query("SELECT 1000 AS n, true AS within")
def random_source(spark, sf):
    return SOURCES["random.numbers"](spark, {"count": 1000, "min": 5, "max": 9}).agg(F.count("*").cast("int").alias("n"), ((F.min(F.col("value").cast("int")) == 5) & (F.max(F.col("value").cast("int")) == 9)).alias("within"))


@query("SELECT * FROM (VALUES ('{\"a\":1}'), ('\"x\"'), ('2')) v(value)")
def memory_source(spark, sf):
    return SOURCES["memory.collection"](spark, {"data": [{"a": 1}, "x", 2]}).select("value")


# Filter and map dialect


def _part_lines(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("_seq"), _line("p_size", "p_name", "p_brand").alias("value"))


PART_LINES = "SELECT concat_ws(',', CAST(p_size AS VARCHAR), p_name, p_brand) AS value FROM part"


@query(f"SELECT * FROM ({PART_LINES}) WHERE coalesce(TRY_CAST(split_part(value, ',', 1) AS DOUBLE) > 25, true)")
def filter_first_field_gt(spark, sf):
    return transforms.filter_rows(spark, {"condition": "size > 25"}, _part_lines(spark, sf)).select("value")


@query(f"SELECT * FROM ({PART_LINES}) WHERE coalesce(TRY_CAST(split_part(value, ',', 1) AS DOUBLE) < 10, true)")
def filter_first_field_lt(spark, sf):
    return transforms.filter_rows(spark, {"condition": "size < 10"}, _part_lines(spark, sf)).select("value")


@query(f"SELECT * FROM ({PART_LINES}) WHERE contains(value, 'Brand#1')")
def filter_contains(spark, sf):
    return transforms.filter_rows(spark, {"condition": "contains 'Brand#1'"}, _part_lines(spark, sf)).select("value")


@query("SELECT p_name AS value FROM part")
def filter_unparsable_passes(spark, sf):
    return transforms.filter_rows(spark, {"condition": "size > 25"}, t(spark, sf, "part").select(F.col("p_name").alias("value")))


@query(PART_LINES)
def filter_or_equal_passes(spark, sf):
    return transforms.filter_rows(spark, {"condition": "size >= 25"}, _part_lines(spark, sf)).select("value")


@query("SELECT event_id, value FROM events WHERE value > 400")
def scan_filter_gt(spark, sf):
    return t(spark, sf, "events").filter("value > 400").select("event_id", "value")


def _names(spark, sf, expression, name="p_name"):
    return transforms.map_rows(spark, {"expression": expression}, t(spark, sf, "part").select("p_partkey", F.expr(name).alias("value")))


@query("SELECT p_partkey, upper(p_name) AS value FROM part")
def map_upper(spark, sf):
    return _names(spark, sf, "toUpperCase")


@query("SELECT p_partkey, lower(p_name) AS value FROM part")
def map_lower(spark, sf):
    return _names(spark, sf, "toLowerCase")


@query("SELECT p_partkey, p_name AS value FROM part")
def map_trim(spark, sf):
    return _names(spark, sf, "trim", "concat(' \t', p_name, '\n ')")


@query("SELECT p_partkey, 'part-' || p_name AS value FROM part")
def map_prefix(spark, sf):
    return _names(spark, sf, "prefix:part-")


@query("SELECT event_type, user_id, min(event_id) AS _seq FROM events GROUP BY ALL")
def distinct_first_occurrence(spark, sf):
    return transforms.distinct(spark, {}, t(spark, sf, "events").select(F.col("event_id").alias("_seq"), "event_type", "user_id"))


@query("SELECT event_id AS _seq, CAST(floor(event_id / 100) AS BIGINT) AS _batch FROM events")
def batch_assign(spark, sf):
    return transforms.batch(spark, {"batchSize": 100}, t(spark, sf, "events").select(F.col("event_id").alias("_seq")))


@query("SELECT c_custkey, trim(c_name) AS c_name FROM customer WHERE c_acctbal >= 0")
def data_clean(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name").alias("c_name"), F.when(F.col("c_acctbal") >= 0, 1).alias("ok"))
    return transforms.clean(spark, {"trim": True, "removeNull": True}, rows).drop("ok")


@query("SELECT o_orderkey, round(o_totalprice * 2, 4) AS twice FROM orders")
def data_transform(spark, sf):
    return transforms.transform(spark, {"columns": {"twice": "round(o_totalprice * 2, 4)"}, "select": ["o_orderkey", "twice"]}, t(spark, sf, "orders"))


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1")
def aggregate_sum_node(spark, sf):
    return transforms.aggregate_sum(spark, {"field": "o_totalprice", "groupBy": ["o_orderstatus"]}, t(spark, sf, "orders")).withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def aggregate_count_node(spark, sf):
    return transforms.aggregate_count(spark, {"groupBy": ["event_type"]}, t(spark, sf, "events"))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE floor(100 / (user_id % 5)) END AS q FROM events WHERE user_id % 5 <> 0")
def resume_on_error(spark, sf):
    return t(spark, sf, "events").select("event_id", F.floor(F.try_divide(F.lit(100), F.col("user_id") % 5)).cast("double").alias("q")).filter("q is not null")


# SQL nodes


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def sql_param_named(spark, sf):
    return run_sql(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :least AND o_orderstatus = {{status}}", {"least": 100000, "status": "O"}, orders=t(spark, sf, "orders"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def sql_param_positional(spark, sf):
    return run_sql(spark, "SELECT c_custkey FROM customer WHERE c_nationkey = ? AND c_mktsegment = ?", [3, "BUILDING"], customer=t(spark, sf, "customer"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def sql_param_array(spark, sf):
    return run_sql(spark, "SELECT o_orderkey FROM orders WHERE array_contains(:p, o_orderpriority)", {"p": ["1-URGENT", "2-HIGH"]}, orders=t(spark, sf, "orders"))


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def sql_chain(spark, sf):
    return _graph(
        spark,
        [("s", "source", "table.scan", {"path": f"{sf}/customer.parquet"}), ("a", "transform", "sql.query", {"sql": "SELECT * FROM input WHERE c_acctbal > 0"}),
         ("b", "transform", "sql.query", {"sql": "SELECT c_nationkey, count(*) AS n FROM input GROUP BY 1"}), ("k", "sink", "console.log", {})],
        [("s", "a"), ("a", "b"), ("b", "k")], "k")


def sql(name: str, text: str, *tables: str):
    """A statement that Spark and the oracle read alike."""

    def run(spark, sf):
        return run_sql(spark, text, None, **{x: t(spark, sf, x) for x in tables})

    run.__name__ = name
    query(text)(run)


sql("scan_all", "SELECT * FROM nation", "nation")
sql("literal_select", "SELECT 1 AS id, 'test' AS name")
sql("range_sorted", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 100 AND c_acctbal <= 2000 ORDER BY c_acctbal, c_custkey", "customer")
sql("order_by_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "orders")
sql("limit_rows", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 3", "nation")
sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "orders")
sql("count_all", "SELECT count(*) AS n FROM lineitem", "lineitem")
sql("avg_min_max", "SELECT round(avg(c_acctbal), 4) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer", "customer")
sql("group_having", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10", "orders")
sql("case_bucket", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'mid' ELSE 'low' END AS bucket FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "customer")
sql("multi_key_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus DESC", "lineitem")
sql("join_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey", "customer", "nation")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey", "customer", "orders")
sql("join_right", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer ON c_custkey = o_custkey", "customer", "orders")
sql("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20", "customer", "supplier")
sql("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", "customer", "orders")
sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer", "orders")
sql("join_cross_small", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation")
sql("join_filtered", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000", "orders", "customer")
sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", "orders")
sql("cte_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE s > 500000) SELECT count(*) AS n FROM b", "orders")
sql("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
sql("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "lineitem")
sql("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag", "lineitem")
sql("rank_topn", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 3", "orders")
sql("ranks", "SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)", "part")
sql("lag_delta", "SELECT event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS following FROM events", "events")
sql("running_total", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM orders", "orders")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "customer", "supplier")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "customer", "supplier")
sql("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000", "customer", "orders")


@query("SELECT user_id, event_id, round(m, 4) AS moving_sum FROM (SELECT *, sum(value) OVER w AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE r >= 5")
def moving_sum5(spark, sf):
    return transforms.moving_sum(t(spark, sf, "events"), "value", ["event_id"], ["user_id"], 5).select("user_id", "event_id", F.round("moving_sum", 4).alias("moving_sum"))


@query("SELECT e.event_id, max(o.event_id) AS purchase FROM events e LEFT JOIN events o ON o.user_id = e.user_id AND o.event_type = 'purchase' AND o.event_id <= e.event_id WHERE e.event_type = 'click' GROUP BY 1")
def join_asof(spark, sf):
    """The last purchase before each click: one window over both sides, no join."""
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = t(spark, sf, "events").filter(F.col("event_type").isin("click", "purchase"))
    return e.withColumn("purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(before)).filter("event_type = 'click'").select("event_id", "purchase")


@query("SELECT p_partkey, b.lo FROM part JOIN (SELECT * FROM (VALUES (0, 10), (10, 25), (25, 60)) v(lo, hi)) b ON p_size > b.lo AND p_size <= b.hi")
def join_range(spark, sf):
    bands = F.broadcast(spark.createDataFrame([(0, 10), (10, 25), (25, 60)], "lo int, hi int"))  # three rows
    return t(spark, sf, "part").join(bands, (F.col("p_size") > F.col("lo")) & (F.col("p_size") <= F.col("hi"))).select("p_partkey", "lo")


@query("SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 1 HOUR")
def join_interval(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    a = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("at"))
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "ts")
    # The hour is part of the key, so a user's clicks meet only the purchases of two hours.
    hour = lambda at: F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / 3600)
    a = a.withColumn("hour", F.explode(F.array(hour("at"), hour("at") + 1)))
    return a.join(b.withColumn("hour", hour("ts")), ["user_id", "hour"]).filter("ts >= at and ts < at + interval 1 hour").select("click", "purchase")


@query("SELECT c_custkey AS k, 'rich' AS side FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 'poor' FROM customer WHERE c_acctbal <= 0")
def branch_merge(spark, sf):
    return _graph(
        spark,
        [("s", "source", "table.scan", {"path": f"{sf}/customer.parquet"}), ("a", "transform", "sql.query", {"sql": "SELECT c_custkey AS k, 'rich' AS side FROM input WHERE c_acctbal > 5000"}),
         ("b", "transform", "sql.query", {"sql": "SELECT c_custkey AS k, 'poor' AS side FROM input WHERE c_acctbal <= 0"}), ("k", "sink", "console.log", {})],
        [("s", "a"), ("s", "b"), ("a", "k"), ("b", "k")], "k")


# Event log and metrics: an execution is a user's day.

LOG_SQL = """(SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS workflow_id, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS execution_id, event_id AS "timestamp",
  CASE event_type WHEN 'view' THEN 'WorkflowStarted' WHEN 'purchase' THEN 'WorkflowCompleted' WHEN 'error' THEN 'WorkflowFailed' WHEN 'click' THEN 'NodeExecutionStarted' ELSE 'NodeExecutionCompleted' END AS event_type,
  CASE WHEN event_type IN ('click', 'signup') THEN 'n' || (event_id % 3) END AS node_id FROM events)"""


def _log(spark, sf):
    kinds = {"view": events.START, "purchase": events.DONE, "error": events.FAILED, "click": events.NODE_START}
    kind = F.lit(events.NODE_DONE)
    for k, v in kinds.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    user = F.col("user_id").cast("string")
    node = F.when(F.col("event_type").isin("click", "signup"), F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")))
    return t(spark, sf, "events").select(F.col("event_id").alias("seq"), user.alias("workflow_id"), F.concat_ws("-", user, F.date_format("ts", "yyyyMMdd")).alias("execution_id"), F.col("event_id").alias("timestamp"), kind.alias("event_type"), node.alias("node_id"))


SUMMARY_SQL = f"""SELECT workflow_id, execution_id, start_time, end_time, CASE e WHEN 'WorkflowCompleted' THEN 'completed' WHEN 'WorkflowFailed' THEN 'failed' ELSE 'running' END AS status, end_time - start_time AS duration FROM
  (SELECT workflow_id, execution_id, min("timestamp") FILTER (event_type = 'WorkflowStarted') AS start_time, min("timestamp") FILTER (event_type IN ('WorkflowCompleted', 'WorkflowFailed')) AS end_time,
   arg_min(event_type, "timestamp") FILTER (event_type IN ('WorkflowCompleted', 'WorkflowFailed')) AS e FROM {LOG_SQL} GROUP BY 1, 2) WHERE start_time IS NOT NULL"""
NODE_SQL = f"""SELECT execution_id, node_id, s AS start_time, d AS end_time, CASE WHEN d IS NOT NULL THEN 'completed' ELSE 'running' END AS status, d - s AS duration FROM
  (SELECT execution_id, node_id, min("timestamp") FILTER (event_type = 'NodeExecutionStarted') AS s, min("timestamp") FILTER (event_type = 'NodeExecutionCompleted') AS d FROM {LOG_SQL} WHERE node_id IS NOT NULL GROUP BY 1, 2)"""


@query(SUMMARY_SQL)
def exec_summary(spark, sf):
    return events.summaries(_log(spark, sf))


@query(NODE_SQL)
def node_detail(spark, sf):
    return events.node_details(_log(spark, sf))


@query(f"SELECT s.execution_id, s.status, coalesce(n.n, 0) AS n_nodes FROM ({SUMMARY_SQL}) s LEFT JOIN (SELECT execution_id, count(*) AS n FROM ({NODE_SQL}) GROUP BY 1) n USING (execution_id)")
def exec_detail(spark, sf):
    return events.details(_log(spark, sf)).select("execution_id", "status", F.coalesce(F.size("nodes"), F.lit(0)).cast("long").alias("n_nodes")).withColumn("n_nodes", F.greatest("n_nodes", F.lit(0).cast("long")))


@query(f"""SELECT workflow_id, execution_id, CASE k WHEN 'WorkflowStarted' THEN 'running' WHEN 'WorkflowCompleted' THEN 'completed' ELSE 'failed' END AS state FROM (SELECT workflow_id, arg_max(execution_id, seq) AS execution_id, arg_max(event_type, seq) AS k FROM {LOG_SQL} WHERE event_type LIKE 'Workflow%' GROUP BY 1)""")
def state_fold(spark, sf):
    return events.fold_state(_log(spark, sf)).select("workflow_id", "execution_id", "state")


@query("SELECT event_type, count(*) AS executions, round(sum(value), 2) AS total_duration, round(avg(value), 4) AS avg_duration, round(avg(user_id), 4) AS avg_rows, round(count(*) FILTER (value < 250) * 100.0 / count(*), 4) AS success_rate FROM events GROUP BY 1")
def node_stats(spark, sf):
    out = metrics.node_stats(t(spark, sf, "events"), F.col("value"), F.col("user_id"), F.col("value") < 250, "event_type")
    return out.select("event_type", "executions", F.round("total_duration", 2).alias("total_duration"), *[F.round(c, 4).alias(c) for c in ("avg_duration", "avg_rows", "success_rate")])


@query("SELECT event_type, count(*) FILTER (value <= 10.0) AS le_10_0, count(*) FILTER (value <= 50.0) AS le_50_0, count(*) FILTER (value <= 250.0) AS le_250_0, count(value) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def latency_histogram(spark, sf):
    return metrics.histogram(t(spark, sf, "events"), F.col("value"), [10.0, 50.0, 250.0], "event_type").withColumn("total", F.round("total", 2))


@query("SELECT event_type, max(value) FILTER (r = floor(n * 0.5) + 1) AS p50, max(value) FILTER (r = floor(n * 0.95) + 1) AS p95, max(value) FILTER (r = floor(n * 0.99) + 1) AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def percentile_index(spark, sf):
    return metrics.indexed_percentiles(t(spark, sf, "events"), "value", [0.5, 0.95, 0.99], "event_type")


@query("SELECT user_id, round(count(*) FILTER (event_type <> 'error') * 100.0 / count(*), 4) AS success_rate FROM events GROUP BY 1")
def success_rate(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.round(metrics.rate(F.count_if(F.col("event_type") != "error"), F.count("*"), 100.0), 4).alias("success_rate"))


@query("SELECT event_id, round(user_id * 1000.0 / value, 4) AS per_second FROM events WHERE value > 0")
def throughput(spark, sf):
    return t(spark, sf, "events").filter("value > 0").select("event_id", F.round(metrics.throughput(F.col("user_id"), F.col("value")), 4).alias("per_second"))


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_gauge(spark, sf):
    return metrics.latest_gauge(t(spark, sf, "events"), "user_id", "value", "event_id")


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS BIGINT) AS value FROM events GROUP BY 1")
def counter_value(spark, sf):
    return metrics.counter(t(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("d")), "d", "user_id")


JHASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296)"
SHARD = f"CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 100 AS INT)"


@query(f"SELECT c_custkey, {SHARD} AS shard FROM (SELECT c_custkey, {JHASH.format('c_name')} AS h FROM customer)")
def shard_assign(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", exprs.shard_of(F.col("c_name")).alias("shard"))


@query(f"SELECT shard, count(*) AS n FROM (SELECT {SHARD} AS shard FROM (SELECT {JHASH.format('c_name')} AS h FROM customer)) GROUP BY 1")
def shard_distribution(spark, sf):
    return shard_assign(spark, sf).groupBy("shard").agg(F.count("*").alias("n"))


# Change data capture: position is a scrambled event_id, arrival is event_id.

CDC_SQL = "(SELECT event_id, user_id, event_type AS kind, value, (event_id * 7919) % 10007 AS position FROM events)"


def _changes(spark, sf):
    return t(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), "value", (F.col("event_id") * 7919 % 10007).alias("position"))


@query(f"SELECT event_id, position FROM {CDC_SQL} WHERE position > 1000 AND position <= 9000")
def cdc_gate(spark, sf):
    return _changes(spark, sf).filter(cdc.in_range(F.col("position"), 1000, 9000)).select("event_id", "position")


@query(f"SELECT event_id, user_id, position FROM (SELECT *, max(position) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {CDC_SQL} WHERE position <= 9000) WHERE position > greatest(100, coalesce(b, 100))")
def cdc_running_max(spark, sf):
    return cdc.accepted(_changes(spark, sf), None, "user_id", "event_id", "position", 100, 9000).select("event_id", "user_id", "position")


@query(f"SELECT user_id, p AS position, value FROM (SELECT user_id, max(position) AS p, arg_max(kind, position * 1000000000 + event_id) AS k, arg_max(value, position * 1000000000 + event_id) AS value FROM {CDC_SQL} GROUP BY 1) WHERE k <> 'error'")
def cdc_latest_image(spark, sf):
    return cdc.latest(_changes(spark, sf), "user_id", "position", "kind", "error", "value", arrival="event_id")


@query(f"SELECT user_id, CAST(floor((max(position) - 0) * 100.0 / 10007) AS INT) AS pct FROM {CDC_SQL} GROUP BY 1")
def cdc_progress(spark, sf):
    return _changes(spark, sf).groupBy("user_id").agg(F.max("position").alias("p")).select("user_id", cdc.progress(F.col("p"), F.lit(0), F.lit(10007)).alias("pct"))


@query(f"SELECT count(*) AS processed, count(*) FILTER (kind <> 'error') AS success, count(*) FILTER (kind = 'error') AS errors, max(position) AS last_position FROM {CDC_SQL}")
def cdc_counters(spark, sf):
    return cdc.counters(_changes(spark, sf), "position", F.col("kind") != "error")


# Windows on event time

WIN = "date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end"


@query(f"SELECT {WIN}, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return windows.tumbling(t(spark, sf, "events"), "ts", "1 day", ["event_type"], [F.count("*").alias("n")])


@query("SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS s FROM events, (VALUES (0), (1)) v(k)) GROUP BY ALL")
def hopping(spark, sf):
    return windows.hopping(t(spark, sf, "events"), "ts", "2 hours", "1 hour", [], [F.count("*").alias("n")])


@query("SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s")
def session(spark, sf):
    return windows.session(t(spark, sf, "events"), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])


# JSON and SQL tools


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf):
    return t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"none\":null,\"r_name\":\"' || r_name || '\"}' AS value FROM region")
def json_rows(spark, sf):
    return t(spark, sf, "region").select(F.col("r_regionkey"), F.lit(None).cast("string").alias("none"), "r_name").select(exprs.json_row("r_regionkey", "none", "r_name").alias("value"))


@query("SELECT * FROM (VALUES (0, 'orders'), (1, 'customer'), (2, 'nation')) v(pos, name)")
def table_refs(spark, sf):
    text = "WITH big AS (SELECT * FROM orders) SELECT * FROM customer JOIN big ON 1 = 1 WHERE EXISTS (SELECT 1 FROM nation)"
    found = sqltools.table_references(spark, text)
    return spark.createDataFrame(list(enumerate(found)), "pos int, name string")


@query("SELECT * FROM (VALUES ('key', 'customer.c_custkey'), ('who', 'customer.c_name'), ('who', 'nation.n_name')) v(col, src)")
def lineage_rows(spark, sf):
    df = run_sql(spark, "SELECT c.c_custkey AS key, concat(c.c_name, n.n_name) AS who FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey", None, customer=t(spark, sf, "customer"), nation=t(spark, sf, "nation"))
    names = {"c": "customer", "n": "nation"}
    return spark.createDataFrame([(k, f"{names.get(a, a)}.{b}") for k, v in sqltools.lineage(df).items() for a, b in v], "col string, src string")

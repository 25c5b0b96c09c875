"""Schedules, workflows as a service, timeouts, pushed rows, MySQL text, trees, order over ranges, shard properties."""

import statistics
import time
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weir.functions import binding, exprs, mysql, service
from weir.operators import cdc, ordered, sinks, transforms
from weir.plans import emitter, sqltools
from weir.plans.facade import Workflows
from weir.plans.runner import REGISTRY, register
from weir.plans.scheduler import Cron, Schedule, ScheduleError, Scheduler, trigger, wait_until
from weir.sources.builders import SOURCES
from weir.sources.pushed import BufferFull, PushSource


class Clock:
    def __init__(self):
        self.now = datetime(2024, 1, 1)

    def __call__(self):
        return self.now


def test_schedules():
    clock, ran = Clock(), []
    s = Scheduler(clock)
    s.add("rate", Schedule("fixed_rate", "10s"), lambda: ran.append("rate"))
    s.add("delay", Schedule("fixed_delay", "10s", initial_delay="5s"), lambda: ran.append("delay"))
    s.add("once", Schedule("immediate"), lambda: ran.append("once"))
    s.add("bad", Schedule("fixed_rate", "1h"), lambda: 1 / 0)
    assert s.tick() == ["bad", "once", "rate"] and s.tick() == []
    clock.now += timedelta(seconds=10)
    assert s.tick() == ["delay", "rate"]
    s.pause("rate")
    clock.now += timedelta(seconds=60)
    assert s.tick() == ["delay"]
    s.resume("rate")
    assert s.tick() == ["rate"]
    s.pause("once")
    s.resume("once")
    assert "once" not in s.tick()  # it has run
    s.stop("rate")
    with pytest.raises(ScheduleError):
        s.resume("rate")
    with pytest.raises(ScheduleError):
        s.add("delay", Schedule("immediate"), print)
    assert {e.name: (e.state, e.failures) for e in s.list()} == {"rate": ("stopped", 0), "delay": ("running", 0), "once": ("running", 0), "bad": ("running", 1)}
    assert ran.count("rate") == 3
    live = Scheduler()
    live.add("x", Schedule("fixed_rate", "1s"), lambda: ran.append("live"))
    live.start(0.02)
    assert wait_until(lambda: "live" in ran, 5)
    live.close()


@pytest.mark.parametrize(("text", "after", "want"), [("0 0 * * *", "2024-02-28 13:00", "2024-02-29 00:00"), ("0 * * * *", "2024-12-31 23:30", "2025-01-01 00:00"), ("*/15 9-17 * * mon-fri", "2024-01-05 17:50", "2024-01-08 09:00"), ("5 4 1 * 0", "2024-01-01 05:00", "2024-01-07 04:05"), ("0 0 29 feb *", "2024-03-01 00:00", "2028-02-29 00:00"), ("0 12 * * 7", "2024-01-01 00:00", "2024-01-07 12:00")])
def test_cron(text, after, want):
    assert Cron(text).next(datetime.fromisoformat(after)) == datetime.fromisoformat(want)


def test_bad_schedules():
    for text in ("* * * *", "60 * * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ScheduleError):
            Cron(text)
    with pytest.raises(ScheduleError):
        Schedule.from_config({"scheduleType": "fixed_rate", "interval": "soon"})
    with pytest.raises(ScheduleError):
        Schedule.from_config({"scheduleType": "sometimes"})
    with pytest.raises(ScheduleError):
        Cron("0 0 31 2 *").next(datetime(2024, 1, 1))
    assert trigger(Schedule("fixed_rate", "5m")) == {"processingTime": "300 seconds"} and trigger(Schedule("cron", cron="0 0 * * *")) == {"availableNow": True}


def definition(name, sql="SELECT * FROM input WHERE CAST(value AS INT) > 7"):
    return {"id": name, "name": name, "nodes": [{"id": "s", "type": "source", "nodeType": "sequence.numbers", "config": {"end": 10}}, {"id": "q", "type": "transform", "nodeType": "sql.query", "config": {"sql": sql}}, {"id": "a", "type": "sink", "nodeType": "ignore"}, {"id": "b", "type": "sink", "nodeType": "console.log", "config": {"limit": 2}}],
            "edges": [{"source": "s", "target": "q"}, {"source": "q", "target": "a"}, {"source": "q", "target": "b"}]}


def test_workflows(spark, tmp_path):
    w = Workflows(spark, f"file://{tmp_path}/flows")
    assert w.executions().count() == 0
    w.create(definition("one"))
    w.create(definition("two", "SELECT nothing FROM input"))
    with pytest.raises(KeyError):
        w.create(definition("one"))
    with pytest.raises(ValueError):
        w.create({"id": "none"})
    first, result = w.execute("one")
    assert result.rows == {"a": 3, "b": 3} and len(result.shown["b"]) == 2
    time.sleep(0.01)
    second, failed = w.execute("two")
    assert failed.status == "failed" and w.status("two") == "failed" and w.status("one") == "completed"
    assert [(r.workflow_id, r.status) for r in w.executions().collect()] == [("two", "failed"), ("one", "completed")]
    assert [n.node_id for n in w.execution(first).first().nodes] == ["a", "b"]
    assert [r.event_type for r in w.timeline(second).collect()] == ["WorkflowStarted", "WorkflowFailed"]
    assert [r.level for r in w.logs(second).collect()] == ["ERROR"]
    w.update("two", definition("two"))
    assert w.execute("two")[1].status == "completed" and w.executions("two").count() == 2
    w.schedule("one", {"scheduleType": "immediate"})
    assert w.scheduler.tick() == ["one"] and w.executions("one").count() == 2
    w.delete("two")
    assert [x["id"] for x in w.list()] == ["one"] and "sql.query" in w.node_types()["transform"]


def test_own_nodes(spark):
    register("transform", "double", lambda spark, c, df: df.withColumn("value", (F.col("value").cast("int") * 2).cast("string")))
    d = definition("own")
    d["nodes"][1] = {"id": "q", "type": "transform", "nodeType": "double"}
    w = Workflows(spark)
    w.create(d)
    assert [r["value"] for r in w.execute("own")[1].shown["b"]] == ["2", "4"]
    del REGISTRY["transform"]["double"]


def test_timeout(spark):
    slow = "SELECT sum(id % 7) AS s FROM range(100000000000000)"
    began = time.time()
    out = service.execute(spark, slow, timeout=1)
    assert not out.success and out.message.startswith("timeout") and time.time() - began < 60
    assert service.execute(spark, "SELECT 1 AS one", timeout=60).data == [{"one": 1}]
    with pytest.raises(Exception, match="(?i)malformed|parse|invalid"):
        service.from_json_lines(spark, spark.createDataFrame([("{}",), ("{",)], "value string"), "a int").collect()
    assert service.from_json_lines(spark, spark.createDataFrame([('{"a": 1}',)], "value string")).first().a == 1


def test_views_come_back(spark):
    spark.range(3).createOrReplaceTempView("input")
    out = binding.run_sql(spark, "SELECT count(*) AS n FROM input", None, input=spark.range(7), extra=spark.range(1))
    assert out.first().n == 7 and spark.table("input").count() == 3 and not spark.catalog.tableExists("extra")
    spark.catalog.dropTempView("input")


def test_push_source(spark, tmp_path):
    def source(name, policy):
        return PushSource(spark, "k long", f"file://{tmp_path}/{name}", capacity=3, policy=policy)

    def kept(s):
        return sorted(r.k for r in spark.read.schema("k long").json(s.path).collect())

    for policy, want in (("drop_head", [1, 2, 3]), ("drop_new", [0, 1, 2]), ("drop_buffer", [3])):
        s = source(policy, policy)
        taken = [s.push([{"k": k}]) for k in range(4)]
        assert kept(s) == want and taken == [True, True, True, policy != "drop_new"]
    s = source("fail", "fail")
    for k in range(3):
        s.push([{"k": k}])
    with pytest.raises(BufferFull):
        s.push([{"k": 3}])
    with pytest.raises(ValueError):
        source("x", "other")


def test_change_ticks(spark):
    stream = SOURCES["cdc.ticks"](spark, {"rowsPerSecond": 50})
    assert stream.isStreaming and stream.columns == SOURCES["cdc.events"](spark, {}).columns
    q = stream.writeStream.format("memory").queryName("ticks").trigger(processingTime="200 milliseconds").start()
    try:
        assert wait_until(lambda: spark.table("ticks").count() > 5, 60)
    finally:
        q.stop()
    rows = spark.table("ticks").orderBy("position").collect()
    assert [r.event_id for r in rows[:3]] == ["evt-1", "evt-2", "evt-3"]


def test_mysql_text(spark):
    df = spark.createDataFrame([(1, "x", "2024-05-06 07:08:09")], "a int, b string, at string")
    row = mysql.run_mysql(spark, "SELECT DAY(DATE(at)) AS d, CONVERT(a, CHAR(5)) AS c, JSON_ARRAY(a, b, NULL, \"it's\", 'a,(b') AS j, CONVERT(b USING gbk) AS u, IFNULL(NULL, 3) AS i FROM t WHERE b != \"y\" AND `a` = :k", {"k": 1}, t=df).first()
    assert (row.d, row.c, row.u, row.i) == (6, "1", "x", 3) and row.j == '[1, "x", null, "it\'s", "a,(b"]'
    assert sqltools.to_postgres("SELECT 'ifnull(`x`)', `update`(1), ifnull (a, \"q\") FROM t LIMIT 3") == "SELECT 'ifnull(`x`)', \"update\"(1), COALESCE (a, 'q') FROM t LIMIT 3"
    with pytest.raises(ValueError):
        mysql.ddl_schema(spark, "SELECT 1")


def test_trees(spark):
    q = emitter.Query("t").filter(emitter.infix("or", emitter.infix("=", emitter.col("a"), emitter.lit("it's")), emitter.infix(">", emitter.col("b"), emitter.lit(2)))).filter(emitter.infix("<>", emitter.col("b"), emitter.lit(9)))
    q = q.project(emitter.col("a")).sort((emitter.col("a"), True)).limit(5)
    assert q.sql() == "SELECT \"a\"\nFROM \"t\"\nWHERE (\"a\" = 'it''s' OR \"b\" > 2) AND \"b\" <> 9\nORDER BY \"a\" DESC\nLIMIT 5"
    rows = spark.createDataFrame([("x", 1), ("y", 3), ("z", 9), ("w", 4)], "a string, b int")
    assert [r.a for r in binding.run_sql(spark, q.sql("`"), None, t=rows).collect()] == ["y", "w"]


def test_upsert_text():
    own = sinks.merge_statement("jdbc:mysql://h/d", "t", "s", ["k", "v"], ["k"])
    assert own == "INSERT INTO t (`k`, `v`) SELECT `k`, `v` FROM s ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"
    assert "WHEN MATCHED" not in sinks.merge_statement("jdbc:derby:x", "t", "s", ["k"], ["k"]).replace("NOT MATCHED", "")


def test_foreach(spark, tmp_path):
    path = str(tmp_path / "seen")

    def each(rows):
        with open(path, "a") as f:
            f.writelines(f"{r['value']}\n" for r in rows)

    sinks.SINKS["foreach"](spark, {"each": each}, spark.range(10).selectExpr("cast(id as string) as value").coalesce(1))
    assert sorted(open(path).read().split()) == [str(k) for k in range(10)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), max_size=40))
def test_positions_are_gapless(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = sorted((r["_pos"], r.v) for r in ordered.positions(df, "v").collect())
    assert [p for p, _ in got] == list(range(len(values))) and [v for _, v in got] == sorted(values, key=lambda v: (v is not None, v or 0))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=60))
def test_values_at_an_index(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    row = ordered.at_index(df, "k", "v", [0.0, 0.5, 0.95]).first()
    assert (row.p0, row.p50, row.p95) == tuple(sorted(values)[int(len(values) * p)] for p in (0.0, 0.5, 0.95))


def test_hash_beyond_the_basic_plane(spark):
    def jvm(text):
        h, raw = 0, text.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[k : k + 2], "big")) % (1 << 32)
        return h - (1 << 32) if h >= 1 << 31 else h

    texts = ["", "a", "😀", "x😀y𝔘", "é中", "\u0000z"]
    df = spark.createDataFrame([(x,) for x in texts], "n string")
    assert {r.n: r.h for r in df.withColumn("h", exprs.jvm_hash(df["n"])).collect()} == {x: jvm(x) for x in texts}


@pytest.mark.parametrize(("prefix", "shards"), [("workflow", 100), ("job", 10), ("pipeline", 200), ("wf", 50)])
def test_shards_are_even(spark, prefix, shards):
    """The same id always gives the same shard, in range; ids spread evenly."""
    names = spark.range(1, 10_001).select(F.concat(F.lit(f"{prefix}-"), "id").alias("n"))
    shard = exprs.shard_of(F.col("n"), shards)
    rows = names.select(shard.alias("a"), shard.alias("b")).collect()
    counts = [0] * shards
    for r in rows:
        assert r.a == r.b and 0 <= r.a < shards
        counts[r.a] += 1
    assert statistics.pstdev(counts) < 0.2 * statistics.mean(counts) or shards > 150 and statistics.pstdev(counts) < 0.5 * statistics.mean(counts)
    assert sum(c > 0 for c in counts) >= 0.8 * shards


def test_controls_and_versions(spark, tmp_path):
    from weir.streaming.sync import VersionedTable

    w = cdc.Watermarks.start(100)
    for name, value in (("high", 5), ("low", 7), ("current", 300), ("other", 1)):
        w.control(name, value)
    assert (w.low, w.current, w.high) == (7, 300, cdc.MAX_POSITION)
    w.reset()
    assert (w.low, w.current, w.high) == (0, 0, cdc.MAX_POSITION)
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.version() == -1
    t.write(spark.range(2), 0)
    t.write(spark.range(5), 1)
    assert t.read().count() == 5 and t.read(0).count() == 2


def test_stream_keeps_values_within_the_watermark(spark, tmp_path):
    from weir.streaming import windows

    path = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "k int, at string").withColumn("at", F.to_timestamp("at")).write.parquet(path)
    stream = spark.readStream.schema("k int, at timestamp").parquet(path)
    from weir.functions.storage import drained

    assert sorted(r.k for r in drained(windows.within(stream, "at", "", "1 hour", ["k"])).collect()) == [1, 2]
    assert transforms.balanced(spark.range(400), 4, "id").groupBy("_worker").count().filter("count > 60").count() == 4

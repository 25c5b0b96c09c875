"""Workflows as a service: definitions, runs, histories, logs. Histories are event tables, read with DataFrames."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import work_dir
from ..operators import events
from .model import Workflow
from .runner import REGISTRY, Result, run
from .scheduler import Schedule, Scheduler

EVENTS = "seq long, event_type string, workflow_id string, workflow_name string, execution_id string, node_id string, node_type string, total_nodes int, duration long, records_processed long, reason string, timestamp long"
LOGS = "timestamp long, level string, kind string, workflow_id string, execution_id string, message string, fields map<string,string>"
CLUSTER = "timestamp long, kind string, subject string, source string, target string, fields map<string,string>"


class EventTable:
    """An append-only table of JSON lines: each append is a file of its own, written before it counts."""

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None, name: str = "events"):
        self.spark, self.schema, self.path, self.name = spark, schema, path or work_dir(spark, name), name

    def append(self, rows: list[dict]) -> None:
        lines = self.spark.createDataFrame([(json.dumps(r, default=str),) for r in rows], "value string")
        lines.coalesce(1).write.mode("append").text(self.path)

    def frame(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("mode", "FAILFAST").json(self.path)


def cluster_event(kind: str, subject: str, source: str = "", target: str = "", **fields) -> dict:
    """A row of the cluster log: migration, rebalance, failover, member_up, member_down, ..."""
    return {"timestamp": int(time.time() * 1000), "kind": kind, "subject": subject, "source": source, "target": target, "fields": {k: str(v) for k, v in fields.items()}}


def query_log(log: DataFrame) -> DataFrame:
    """Query records of a structured log as columns: node, status, milliseconds, rows, rows a second, error kind."""
    f = F.col("fields")
    ms, rows = f["duration_ms"].try_cast("double"), f["rows"].try_cast("double")
    return log.filter("kind = 'query'").select("timestamp", f["node_id"].alias("node_id"), f["status"].alias("status"), ms.alias("duration_ms"), rows.alias("rows"), F.when(ms > 0, rows * 1000 / ms).otherwise(0.0).alias("per_second"), f["error_type"].alias("error_type"))


@dataclass
class Stored:
    flow: Workflow
    created: int
    updated: int
    status: str = "idle"
    history: list[str] = field(default_factory=list)


class Workflows:
    """Create, list, change, delete and run workflows; look at what they did."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.stored, self.seq = spark, {}, 0
        self.events = EventTable(spark, EVENTS, path and f"{path}/events", "events")
        self.log = EventTable(spark, LOGS, path and f"{path}/logs", "logs")
        self.scheduler = Scheduler()

    def create(self, definition: str | dict) -> str:
        flow = Workflow.from_json(definition)
        flow.id = flow.id or uuid.uuid4().hex
        if flow.id in self.stored:
            raise KeyError(f"workflow {flow.id} exists")
        if wrong := flow.validate():
            raise ValueError("; ".join(wrong))
        now = int(time.time() * 1000)
        self.stored[flow.id] = Stored(flow, now, now)
        return flow.id

    def get(self, workflow: str) -> Workflow:
        return self.stored[workflow].flow

    def list(self) -> list[dict]:
        return [{"id": k, "name": s.flow.name, "status": s.status, "nodes": len(s.flow.nodes), "created": s.created, "updated": s.updated} for k, s in sorted(self.stored.items())]

    def update(self, workflow: str, definition: str | dict) -> None:
        flow = Workflow.from_json(definition)
        flow.id = workflow
        if wrong := flow.validate():
            raise ValueError("; ".join(wrong))
        self.stored[workflow].flow, self.stored[workflow].updated = flow, int(time.time() * 1000)

    def delete(self, workflow: str) -> None:
        del self.stored[workflow]

    def validate(self, definition: str | dict) -> list[str]:
        return Workflow.from_json(definition).validate()

    def node_types(self) -> dict[str, list[str]]:
        return {kind: sorted(names) for kind, names in REGISTRY.items()}

    def _event(self, kind: str, flow: Workflow, execution: str, **more) -> dict:
        self.seq += 1
        return {"seq": self.seq, "event_type": kind, "workflow_id": flow.id, "workflow_name": flow.name, "execution_id": execution, "timestamp": int(time.time() * 1000), **more}

    def execute(self, workflow: str) -> tuple[str, Result]:
        """Run it; a run that failed is logged as failed."""
        stored = self.stored[workflow]
        flow, execution = stored.flow, uuid.uuid4().hex
        stored.status = "running"
        rows = [self._event(events.START, flow, execution, total_nodes=len(flow.nodes))]
        result = run(self.spark, flow)
        kinds = {n.id: n.node_type for n in flow.nodes}
        for node, n in result.rows.items():
            rows.append(self._event(events.NODE_START, flow, execution, node_id=node, node_type=kinds[node]) | {"timestamp": rows[0]["timestamp"]})
            rows.append(self._event(events.NODE_DONE, flow, execution, node_id=node, node_type=kinds[node], records_processed=n))
        done = result.status == "completed"
        rows.append(self._event(events.DONE if done else events.FAILED, flow, execution, duration=result.duration_ms, reason=None if done else result.message))
        self.events.append(rows)
        stored.status = result.status
        stored.history.append(execution)
        self.log.append([{"timestamp": rows[-1]["timestamp"], "level": "INFO" if done else "ERROR", "kind": "workflow", "workflow_id": flow.id, "execution_id": execution, "message": result.status if done else result.message, "fields": {"duration_ms": str(result.duration_ms)}}])
        return execution, result

    def status(self, workflow: str) -> str:
        return self.stored[workflow].status

    def executions(self, workflow: str | None = None) -> DataFrame:
        """Summaries, newest first."""
        rows = self.events.frame()
        return events.newest_first(events.summaries(rows.filter(F.col("workflow_id") == workflow) if workflow else rows))

    def execution(self, execution: str) -> DataFrame:
        return events.details(self.events.frame().filter(F.col("execution_id") == execution))

    def timeline(self, execution: str) -> DataFrame:
        return events.timeline(self.events.frame(), execution)

    def logs(self, execution: str) -> DataFrame:
        return self.log.frame().filter(F.col("execution_id") == execution).orderBy("timestamp")

    def schedule(self, workflow: str, config: dict) -> None:
        self.get(workflow)
        self.scheduler.add(workflow, Schedule.from_config(config), lambda: self.execute(workflow))

"""Execution history over an event log (workflow_id, execution_id, node_id, event_type, timestamp, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, DONE, FAILED = "WorkflowStarted", "WorkflowCompleted", "WorkflowFailed"
NODE_START, NODE_DONE, NODE_FAILED = "NodeExecutionStarted", "NodeExecutionCompleted", "NodeExecutionFailed"


def _first(kind, what):
    return F.min(F.when(F.col("event_type").isin(kind), F.struct("timestamp", what)))


def summaries(log: DataFrame) -> DataFrame:
    """One row an execution: start, first terminal event, state and duration."""
    out = log.filter(F.col("event_type").isin(START, DONE, FAILED)).groupBy("workflow_id", "execution_id").agg(F.min(F.when(F.col("event_type") == START, F.col("timestamp"))).alias("start_time"), _first([DONE, FAILED], "event_type").alias("e"))
    state = F.when(F.col("e.event_type") == DONE, "completed").when(F.col("e.event_type") == FAILED, "failed").otherwise("running")
    return out.filter("start_time is not null").select("workflow_id", "execution_id", "start_time", F.col("e.timestamp").alias("end_time"), state.alias("status"), (F.col("e.timestamp") - F.col("start_time")).alias("duration"))


def node_details(log: DataFrame) -> DataFrame:
    """One row a node of an execution; completed beats failed beats running."""
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("timestamp")))
    out = log.filter("node_id is not null").groupBy("execution_id", "node_id").agg(at(NODE_START).alias("start_time"), at(NODE_DONE).alias("done"), at(NODE_FAILED).alias("failed"))
    end = F.coalesce("done", "failed")
    status = F.when(F.col("done").isNotNull(), "completed").when(F.col("failed").isNotNull(), "failed").otherwise("running")
    return out.select("execution_id", "node_id", "start_time", end.alias("end_time"), status.alias("status"), (end - F.col("start_time")).alias("duration"))


def details(log: DataFrame) -> DataFrame:
    """Summaries with the sorted list of node details."""
    nodes = node_details(log).groupBy("execution_id").agg(F.sort_array(F.collect_list(F.struct("start_time", "node_id", "status", "duration"))).alias("nodes"))
    return summaries(log).join(nodes, "execution_id", "left")


def fold_state(log: DataFrame, seq: str = "seq") -> DataFrame:
    """State of each workflow after its whole log, and its last execution's finished nodes."""
    state = F.when(F.col("event_type") == START, "running").when(F.col("event_type") == DONE, "completed").when(F.col("event_type") == FAILED, "failed")
    last = log.filter(state.isNotNull()).groupBy("workflow_id").agg(F.max_by(state, seq).alias("state"), F.max_by("execution_id", seq).alias("execution_id"))
    nodes = log.filter(F.col("event_type") == NODE_DONE).groupBy("workflow_id", "execution_id").agg(F.sort_array(F.collect_set("node_id")).alias("completed_nodes"))
    return last.join(nodes, ["workflow_id", "execution_id"], "left").withColumn("completed_nodes", F.coalesce("completed_nodes", F.array().cast("array<string>")))


def newest_first(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(F.desc("start_time"), "execution_id")


def state_stream(log: DataFrame, seq: str = "seq") -> DataFrame:
    """The state fold over a stream of events, as a running aggregate: a workflow's state and last execution after its latest event."""
    state = F.when(F.col("event_type") == START, "running").when(F.col("event_type") == DONE, "completed").when(F.col("event_type") == FAILED, "failed")
    return log.filter(state.isNotNull()).groupBy("workflow_id").agg(F.max_by(state, seq).alias("state"), F.max_by("execution_id", seq).alias("execution_id"))


def timeline(log: DataFrame, execution: str) -> DataFrame:
    return log.filter(F.col("execution_id") == execution).orderBy("timestamp")

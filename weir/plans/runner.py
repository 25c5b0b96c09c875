"""Compile a workflow graph to DataFrames and run its sinks."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.sinks import SINKS
from ..operators.transforms import TRANSFORMS
from ..sources.builders import SOURCES
from .model import Workflow

REGISTRY = {"source": dict(SOURCES), "transform": dict(TRANSFORMS), "sink": dict(SINKS)}


def register(kind: str, name: str, builder) -> None:
    """Add a node type of one's own."""
    REGISTRY[kind][name] = builder


@dataclass
class Result:
    status: str
    message: str = ""
    duration_ms: int = 0
    rows: dict[str, int] = field(default_factory=dict)  # rows that reached each sink
    shown: dict[str, list] = field(default_factory=dict)


class WorkflowError(ValueError):
    pass


def compile_graph(spark: SparkSession, flow: Workflow, held: list | None = None) -> dict[str, DataFrame]:
    """A DataFrame for each node; a sink's is its input. Roles come from ``node.type``; several inputs are united by name, and a SQL node also sees each by its node's id. Nodes that several others read are persisted and added to ``held``, if given."""
    if wrong := flow.validate():
        raise WorkflowError("; ".join(wrong))
    nodes, out = {n.id: n for n in flow.nodes}, {}
    for i in flow.order():
        node = nodes[i]
        if node.type != "sink" and node.node_type not in REGISTRY[node.type]:
            raise WorkflowError(f"unknown {node.type} {node.node_type}")
        if node.type == "source":
            out[i] = REGISTRY["source"][node.node_type](spark, node.config)
            continue
        inputs = [out[p] for p in flow.parents(i)]
        df = inputs[0]
        for other in inputs[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
        views = {p.replace("-", "_"): out[p] for p in flow.parents(i)} if node.node_type == "sql.query" else {}
        out[i] = df if node.type == "sink" else REGISTRY["transform"][node.node_type](spark, node.config, df, **views)
        if held is not None and node.type == "transform" and len({e.target for e in flow.edges if e.source == i}) > 1 and not out[i].isStreaming:
            held.append(out[i].persist())
    return out


def run(spark: SparkSession, flow: Workflow) -> Result:
    """Run all sinks; failures are reported as failed, never as done."""
    began = time.time()
    result, held = Result("completed"), []
    try:
        frames = compile_graph(spark, flow, held)
        for node in (n for n in flow.nodes if n.type == "sink"):
            if node.node_type not in REGISTRY["sink"]:
                raise WorkflowError(f"unknown sink {node.node_type}")
            seen = Observation(f"sink-{uuid.uuid4().hex}")
            limited = node.node_type == "console.log" and "limit" in node.config  # the observation would see the limit's rows only
            df = frames[node.id]
            shown = REGISTRY["sink"][node.node_type](spark, node.config, df if limited else df.observe(seen, F.count(F.lit(1)).alias("n")))
            result.rows[node.id] = df.count() if limited else seen.get.get("n", 0)
            if shown is not None:
                result.shown[node.id] = shown
    except Exception as e:
        result.status, result.message = "failed", f"{type(e).__name__}: {str(e).splitlines()[0]}"
    for df in held:
        df.unpersist()
    result.duration_ms = int((time.time() - began) * 1000)
    return result

"""Connected components as Spark joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: So many edges at most are joined up by one task (4 MB); more by rounds of joins. The outcome is the same.
SMALL = 1 << 18


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low = label.copy()
        np.minimum.at(low, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (low[low] != low).any():
            low = low[low]
        label = low
    return nodes, nodes[label]


def _at_once(batches):
    ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if ends:
        node, component = labels_of(*map(np.concatenate, zip(*ends)))
        for k in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[k : k + (1 << 16)]), pa.array(component[k : k + (1 << 16)])], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the undirected edges (a, b); a component is named by its smallest node.

    Few edges are joined up by one task. Beyond ``SMALL``, each round takes the smallest label among a node, its neighbours and its
    label's own label, and writes the labels to the shared folder. Chains
    shorten by pointer jumping; no edge reaches the driver.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= SMALL:
        labels = cut(edges.coalesce(1).mapInArrow(_at_once, "node long, component long"), "labels")
        drop(edges)
        return labels
    both = edges.union(edges.select("b", "a"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        of = labels.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        new = (
            labels.join(near, labels["node"] == near["a"])
            .join(of, F.col("component") == F.col("at"))
            .select("node", F.least("component", "near", "jump").alias("component"), F.col("component").alias("was"))
        )
        new = cut(new, "labels")
        done = not new.filter("component < was").take(1)
        drop(labels)
        labels = new
        if done:
            drop(edges)
            return labels.select("node", "component")

"""Workflow graphs: parsing, checks and order."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter


@dataclass(frozen=True)
class Node:
    id: str
    type: str  # source, transform or sink
    node_type: str
    config: dict = field(default_factory=dict)
    label: str = ""


@dataclass(frozen=True)
class Edge:
    source: str
    target: str


@dataclass
class Workflow:
    id: str
    nodes: list[Node]
    edges: list[Edge]
    name: str = ""
    metadata: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str | dict) -> "Workflow":
        """Edges may be spelt source/target or from/to; node types nodeType or node_type."""
        d = json.loads(text) if isinstance(text, str) else text
        nodes = [Node(n["id"], n["type"], n.get("nodeType") or n.get("node_type") or "", n.get("config") or {}, n.get("label", "")) for n in d.get("nodes", [])]
        edges = [Edge(e.get("source", e.get("from")), e.get("target", e.get("to"))) for e in d.get("edges", [])]
        return cls(d.get("id", ""), nodes, edges, d.get("name", ""), d.get("metadata") or {})

    def parents(self, node: str) -> list[str]:
        return list(dict.fromkeys(e.source for e in self.edges if e.target == node))

    def validate(self) -> list[str]:
        """What is wrong with the graph; empty if nothing."""
        ids = [n.id for n in self.nodes]
        wrong = [] if self.nodes else ["workflow has no nodes"]
        wrong += [f"duplicate node id {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
        wrong += [f"workflow has no {kind}" for kind in ("source", "sink") if self.nodes and not any(n.type == kind for n in self.nodes)]
        wrong += [f"node {n.id} has unknown type {n.type}" for n in self.nodes if n.type not in ("source", "transform", "sink")]
        wrong += [f"edge to unknown node {x}" for e in self.edges for x in (e.source, e.target) if x not in ids]
        wrong += [f"node {n.id} has no input" for n in self.nodes if n.type != "source" and not self.parents(n.id)]
        try:
            self.order()
        except CycleError:
            wrong.append("workflow has a cycle")
        return wrong

    def order(self) -> list[str]:
        """Node ids, parents first; a duplicate edge counts once."""
        known = {n.id for n in self.nodes}
        return list(TopologicalSorter({n.id: [p for p in self.parents(n.id) if p in known] for n in self.nodes}).static_order())

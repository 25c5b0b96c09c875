"""Relational trees and their SQL text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    """A column, literal or call; ``sql`` writes it with quoted names."""

    kind: str  # column, literal, call or infix
    name: str = ""
    value: object = None
    args: tuple = ()

    def sql(self) -> str:
        if self.kind == "column":
            return ".".join(f'"{p}"' for p in self.name.split("."))
        if self.kind == "literal":
            return "NULL" if self.value is None else str(self.value).upper() if isinstance(self.value, bool) else str(self.value) if not isinstance(self.value, str) else "'" + self.value.replace("'", "''") + "'"
        if self.kind == "infix":
            return f" {self.name} ".join(f"({a.sql()})" if a.kind == "infix" and a.name == "OR" and self.name == "AND" else a.sql() for a in self.args)
        return f"{self.name}({', '.join(a.sql() for a in self.args)})"


def col(name: str) -> Expr:
    return Expr("column", name)


def lit(value) -> Expr:
    return Expr("literal", value=value)


def call(name: str, *args: Expr) -> Expr:
    return Expr("call", name.upper(), args=args)


def infix(name: str, *args: Expr) -> Expr:
    return Expr("infix", name.upper(), args=args)


@dataclass
class Query:
    """A tree of scan, filter, join, aggregate, project, sort and limit, built step by step."""

    table: str
    alias: str = ""
    columns: list[tuple[Expr, str]] = field(default_factory=list)
    joins: list[tuple[str, str, str, Expr]] = field(default_factory=list)
    condition: Expr | None = None
    keys: list[Expr] = field(default_factory=list)
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    rows: int | None = None

    def project(self, *items: Expr | tuple[Expr, str]) -> "Query":
        self.columns = [i if isinstance(i, tuple) else (i, "") for i in items]
        return self

    def filter(self, condition: Expr) -> "Query":
        self.condition = infix("AND", self.condition, condition) if self.condition else condition
        return self

    def join(self, kind: str, table: str, alias: str, on: Expr) -> "Query":
        self.joins.append((kind.upper(), table, alias, on))
        return self

    def aggregate(self, keys: list[Expr], *items: tuple[Expr, str]) -> "Query":
        self.keys, self.columns = keys, [*((k, "") for k in keys), *items]
        return self

    def sort(self, *items: tuple[Expr, bool]) -> "Query":
        self.order = list(items)
        return self

    def limit(self, rows: int) -> "Query":
        self.rows = rows
        return self

    def sql(self, quote: str = '"') -> str:
        def named(table, alias):
            return ".".join(f'"{p}"' for p in table.split(".")) + (f' AS "{alias}"' if alias else "")

        out = ["SELECT " + (", ".join(e.sql() + (f' AS "{a}"' if a else "") for e, a in self.columns) or "*"), "FROM " + named(self.table, self.alias)]
        out += [f"{kind} JOIN {named(t, a)} ON {on.sql()}" for kind, t, a, on in self.joins]
        if self.condition:
            out.append("WHERE " + self.condition.sql())
        if self.keys:
            out.append("GROUP BY " + ", ".join(k.sql() for k in self.keys))
        if self.order:
            out.append("ORDER BY " + ", ".join(e.sql() + (" DESC" if down else "") for e, down in self.order))
        if self.rows is not None:
            out.append(f"LIMIT {self.rows}")
        text = "\n".join(out)
        return text if quote == '"' else re.sub(r"'(?:[^']|'')*'|\"", lambda m: quote if m[0] == '"' else m[0], text)

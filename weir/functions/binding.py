"""SQL node configuration and parameter binding, through Spark's own markers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

BRACES = re.compile(r"\{\{\s*(\w+)\s*\}\}")
NAMED = re.compile(r"(?<![:\w]):([A-Za-z_]\w*)")
QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"")
#: Words and signs that the optional screen rejects in string parameters.
SCREENED = ("DROP", "DELETE", "INSERT", "UPDATE", "CREATE", "ALTER", "TRUNCATE", "EXEC", "EXECUTE", "--", "/*", "*/", "';", '";', "' OR", '" OR')


class BindingError(ValueError):
    pass


@dataclass
class SqlNodeConfig:
    sql: str
    batch_size: int = 1000
    timeout: int = 30
    parameters: dict = field(default_factory=dict)

    @classmethod
    def from_config(cls, c: dict) -> "SqlNodeConfig":
        if not isinstance(c.get("sql"), str):
            raise BindingError("sql is required and must be a string")
        for key, kind in (("batchSize", int), ("timeout", int), ("parameters", dict)):
            if key in c and (not isinstance(c[key], kind) or isinstance(c[key], bool)):
                raise BindingError(f"{key} must be {kind.__name__}")
        out = cls(c["sql"], c.get("batchSize", 1000), c.get("timeout", 30), c.get("parameters", {}))
        if wrong := out.validate():
            raise BindingError("; ".join(wrong))
        return out

    def validate(self) -> list[str]:
        return [w for w, bad in (("sql is blank", not self.sql.strip()), ("batchSize must be positive", self.batch_size <= 0), ("timeout must be positive", self.timeout <= 0)) if bad]


def markers(sql: str) -> str:
    """``{{x}}`` as ``:x``."""
    return BRACES.sub(r":\1", sql)


def parameter_names(sql: str) -> list[str]:
    bare = QUOTED.sub("''", markers(sql))
    return list(dict.fromkeys(NAMED.findall(bare)))


def has_parameters(sql: str) -> bool:
    return bool(parameter_names(sql)) or "?" in QUOTED.sub("''", sql)


def missing(sql: str, parameters: dict) -> list[str]:
    return [n for n in parameter_names(sql) if n not in parameters]


def screen(parameters: dict) -> None:
    """Reject string values with SQL words. Markers make this unnecessary; it is a policy one may add."""
    for k, v in parameters.items():
        if isinstance(v, str) and any(w in v.upper() for w in SCREENED):
            raise BindingError(f"parameter {k} holds SQL")


def run_sql(spark, sql: str, parameters: dict | list | None = None, **views):
    """Run a statement; named (``:x``, ``{{x}}``) or positional (``?``) parameters; DataFrames as views."""
    if isinstance(parameters, list):
        n = QUOTED.sub("''", sql).count("?")
        if n != len(parameters):
            raise BindingError(f"{n} markers and {len(parameters)} parameters")
    elif lost := missing(sql, parameters or {}):
        raise BindingError(f"missing parameters: {', '.join(lost)}")
    before = {name: spark.table(name) for name in views if _is_view(spark, name)}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(markers(sql), args=parameters or None)  # analysed here, so the views may go
    finally:
        for name in views:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _is_view(spark, name: str) -> bool:
    return spark._jsparkSession.sessionState().catalog().getTempView(name).isDefined()


class QueryBuilder:
    """Collects a statement and its parameters."""

    def __init__(self):
        self.clear()

    def sql(self, text: str) -> "QueryBuilder":
        self.text = text
        return self

    def set(self, name: str, value) -> "QueryBuilder":
        self.named[name] = value
        return self

    def add(self, value) -> "QueryBuilder":
        self.positional.append(value)
        return self

    def clear(self) -> "QueryBuilder":
        self.text, self.named, self.positional = "", {}, []
        return self

    def run(self, spark):
        if not self.text.strip():
            raise BindingError("no statement")
        return run_sql(spark, self.text, self.positional or self.named)

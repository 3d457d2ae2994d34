"""The facade: connect(path) and a Connection with everything behind it, and role checks for tools that call it by name."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from tesserae.errors import EngineError
from tesserae.operators.cypher import is_write
from tesserae.operators.graph import ContextStore, Graph
from tesserae.plans.fanout import fan_out
from tesserae.session import Session
from tesserae.sources import files

READ, WRITE, ADMIN = range(3)
_READS = re.compile(r"(?is)\s*(select|with|values|show|describe|desc|explain|pragma|use)\b")


def connect(root: str, spark: SparkSession | None = None) -> Connection:
    """Open or make a warehouse."""
    if spark is None:
        spark = (
            SparkSession.builder.appName("tesserae").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.timestampType", "TIMESTAMP_NTZ").getOrCreate()
        )
    return Connection(Session(spark, root))


open = connect  # noqa: A001


class Connection:
    def __init__(self, session: Session) -> None:
        self.session, self._graph = session, None

    def frame(self, sql: str) -> DataFrame:
        return self.session.sql(sql)

    def sql(self, sql: str) -> list[dict]:
        """Rows as dictionaries, for results that fit the driver."""
        return self.session.sql(sql).toArrow().to_pylist()

    def query(self, sql: str) -> str:
        return files.encode(self.session.sql(sql), "json")

    def query_arrow(self, sql: str) -> bytes:
        return files.encode(self.session.sql(sql), "arrow")

    def create_table(self, ddl: str) -> None:
        self.session.sql(ddl)

    def insert_json(self, table: str, rows: str | list[dict]) -> int:
        values = json.loads(rows) if isinstance(rows, str) else rows
        t = self.session.catalog.get(table)
        text = self.session.spark.createDataFrame([(json.dumps(r, default=str),) for r in values], "value string")
        from pyspark.sql import functions as F

        return self.session.insert(table, text.select(F.from_json("value", t.schema).alias("r")).select("r.*"))

    def load(self, table: str, path: str) -> int:
        return self.session.insert(table, files.load(self.session.spark, path, self.session.catalog.get(table)))

    def tables(self) -> list[str]:
        return self.session.catalog.names()

    def describe(self, table: str) -> list[dict]:
        return self.sql(f"DESCRIBE {table}")

    def optimize(self, table: str) -> None:
        self.session.sql(f"OPTIMIZE TABLE {table}")

    def fan_out(self, sql: str, shards: int = 4) -> DataFrame:
        return fan_out(self.session, sql, shards)

    @property
    def graph(self) -> Graph:
        if self._graph is None:
            self._graph = Graph(self.session.spark, self.session.store)
        return self._graph

    @property
    def context(self) -> ContextStore:
        return ContextStore(self.graph)

    def health(self) -> dict:
        return {"status": "ok", "tables": len(self.tables()), **self.session.metrics}

    def call(self, tool: str, arguments: dict | None = None, role: int = READ):
        """Run a tool by name.  A statement's own kind decides the role that it needs, not the tool's name."""
        a = arguments or {}
        if tool not in _TOOLS:
            raise EngineError(f"unknown tool '{tool}'")
        need, fn = _TOOLS[tool]
        if tool == "query" and not _READS.match(a["sql"]) or tool == "cypher" and is_write(a["query"]):
            need = WRITE
        if role < need:
            raise EngineError(f"'{tool}' needs the role {('read', 'write', 'admin')[need]} here")
        return fn(self, **a)


_rows = lambda df: df.toArrow().to_pylist()
_TOOLS = {
    "query": (READ, lambda c, sql: c.sql(sql)), "explain": (READ, lambda c, sql: c.sql(f"EXPLAIN {sql}")[0]["plan"]), "tables": (READ, lambda c: c.tables()), "schema": (READ, lambda c, table: c.describe(table)),
    "stats": (READ, lambda c, table: c.session.stats(table)), "optimize": (WRITE, lambda c, table: c.optimize(table)), "cypher": (READ, lambda c, query: _rows(c.graph.cypher(query))),
    "context_put": (WRITE, lambda c, **a: c.context.put(**a)), "context_get": (READ, lambda c, key: c.context.get(key)), "context_find": (READ, lambda c, query, limit=10: c.context.find(query, limit)),
    "context_link": (WRITE, lambda c, a, b, kind="LINKS": c.context.link(a, b, kind)), "context_unlink": (WRITE, lambda c, a, b, kind=None: c.context.unlink(a, b, kind)), "context_delete": (WRITE, lambda c, key: c.context.delete(key)),
    "context_neighbors": (READ, lambda c, key, depth=1: c.context.neighbors(key, depth)), "context_path": (READ, lambda c, a, b: c.context.path(a, b)), "context_stats": (READ, lambda c: c.context.stats()),
    "vector_create": (ADMIN, lambda c, name, dim, metric="l2", index="flat": c.session.vectors.create(name, dim, metric, index)), "vector_drop": (ADMIN, lambda c, name: c.session.vectors.drop(name)), "vector_list": (READ, lambda c: c.session.vectors.names()),
    "vector_add": (WRITE, lambda c, name, vectors, payloads=None: c.session.vectors.add(name, vectors, payloads)), "vector_search": (READ, lambda c, name, query, k, nprobe=8: _rows(c.session.vectors.search(name, query, k, nprobe))), "vector_embed": (READ, lambda c, name, text: c.session.vectors.embed(name, text)),
    "memory_create": (ADMIN, lambda c, name, fields, key=None: c.session.memory.create(name, [tuple(f) for f in fields], key)), "memory_insert": (WRITE, lambda c, name, rows: c.session.memory.insert(name, rows)), "memory_get": (READ, lambda c, name, key: c.session.memory.get(name, key)),
    "memory_compact": (WRITE, lambda c, name: c.session.memory.compact(name)), "memory_query": (READ, lambda c, sql: c.sql(sql) if _READS.match(sql) else c.call("query", {"sql": sql})), "memory_tables": (READ, lambda c: sorted(c.session.memory.tables)),
}

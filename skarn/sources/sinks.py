"""Where a code graph is written to: Parquet tables, or a graph or SQL database by merge statements.

A sink merges: vertices by their key, edges by their two ends, the newest properties win.
Database sinks send each partition's rows in batches over one connection that ``connect``
opens on the executor; a repeated task merges the same rows again, which changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from skarn.sources.store import VersionedTable

BATCH = 1000


@dataclass(frozen=True)
class End:
    """One end of an edge: a vertex label, and the edge's column for each of its key properties."""

    label: str
    key: tuple[tuple[str, str], ...]


class GraphSink(Protocol):
    def create_indexes(self, keys: dict[str, list[str]]) -> None: ...

    def write_vertices(self, label: str, key: list[str], rows: DataFrame) -> None: ...

    def write_edges(self, name: str, source: End, target: End, rows: DataFrame) -> None: ...


class Runner(Protocol):
    """An open connection: a database's own client behind three calls."""

    def run(self, statement: str, parameters: dict | list | None) -> None: ...

    def commit(self) -> None: ...

    def close(self) -> None: ...


class ParquetSink:
    """One versioned table for each label and each kind of edge; files are bucketed by key, so there are no indexes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str, rows: DataFrame, key: list[str]) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{name}", rows.schema, key)

    def create_indexes(self, keys: dict[str, list[str]]) -> None:
        pass

    def write_vertices(self, label: str, key: list[str], rows: DataFrame) -> None:
        self.table(label, rows, key).merge(rows, key)

    def write_edges(self, name: str, source: End, target: End, rows: DataFrame) -> None:
        key = [c for _, c in (*source.key, *target.key)]
        self.table(f"{name}/{source.label}-{target.label}", rows, list(dict.fromkeys(key))).merge(rows, list(dict.fromkeys(key)))


def literal(value) -> str:
    """A value as Cypher text: strings in single quotes, lists in brackets."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, list | tuple):
        return f"[{', '.join(map(literal, value))}]"
    marks = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "$": "\\u0024"}
    return "'" + "".join(marks.get(c, c) for c in str(value)) + "'"


class Cypher:
    """Parameterised Cypher: a batch of rows is one statement."""

    def index(self, label: str, key: list[str]) -> str:
        return f"CREATE INDEX {label}_key IF NOT EXISTS FOR (n:{label}) ON ({', '.join(f'n.{k}' for k in key)})"

    def vertices(self, label: str, key: list[str], rows: list[dict]) -> Iterator[tuple[str, dict]]:
        yield f"UNWIND $rows AS row MERGE (n:{label} {{{', '.join(f'{k}: row.{k}' for k in key)}}}) SET n += row", {"rows": rows}

    def edges(self, name: str, source: End, target: End, rows: list[dict]) -> Iterator[tuple[str, dict]]:
        match = lambda n, e: f"({n}:{e.label} {{{', '.join(f'{k}: row.ends.{c}' for k, c in e.key)}}})"
        ends = {c for _, c in (*source.key, *target.key)}
        rows = [{"ends": {c: r[c] for c in ends}, "properties": {c: v for c, v in r.items() if c not in ends}} for r in rows]
        yield f"UNWIND $rows AS row MATCH {match('a', source)} MATCH {match('b', target)} MERGE (a)-[e:{name}]->(b) SET e += row.properties", {"rows": rows}


class InlineCypher:
    """Cypher within SQL (``cypher(graph, $$...$$)``), one statement a row, values as literals."""

    def __init__(self, graph: str):
        self.graph = graph

    def _sql(self, text: str) -> tuple[str, None]:
        return f"SELECT * FROM cypher('{self.graph}', $$ {text} $$) AS (v agtype)", None

    def index(self, label: str, key: list[str]) -> str:
        return f'CREATE INDEX IF NOT EXISTS "{label}_key" ON {self.graph}."{label}" USING gin (properties)'

    def vertices(self, label: str, key: list[str], rows: list[dict]) -> Iterator[tuple[str, None]]:
        for row in rows:
            sets = [f"n.{c} = {literal(v)}" for c, v in row.items() if c not in key]
            yield self._sql(f"MERGE (n:{label} {{{', '.join(f'{k}: {literal(row[k])}' for k in key)}}}){' SET ' + ', '.join(sets) if sets else ''} RETURN n")

    def edges(self, name: str, source: End, target: End, rows: list[dict]) -> Iterator[tuple[str, None]]:
        ends = {c for _, c in (*source.key, *target.key)}
        for row in rows:
            match = lambda n, e, row=row: f"({n}:{e.label} {{{', '.join(f'{k}: {literal(row[c])}' for k, c in e.key)}}})"
            sets = [f"e.{c} = {literal(v)}" for c, v in row.items() if c not in ends]
            yield self._sql(f"MATCH {match('a', source)}, {match('b', target)} MERGE (a)-[e:{name}]->(b){' SET ' + ', '.join(sets) if sets else ''} RETURN e")


class Sql:
    """SQL ``MERGE`` into one table for each label and kind of edge; lists are JSON text, values are positional."""

    def __init__(self, mark: Callable[[int], str] = lambda n: f":{n}", one_row: str = " FROM dual"):
        self.mark, self.one_row = mark, one_row

    def index(self, label: str, key: list[str]) -> str:
        return f"CREATE UNIQUE INDEX {label}_key ON {label} ({', '.join(key)})"

    def _merge(self, table: str, key: list[str], rows: list[dict]) -> Iterator[tuple[str, list]]:
        for row in rows:
            columns = list(row)
            rest = [c for c in columns if c not in key]
            given = ", ".join(f"{self.mark(n)} AS {c}" for n, c in enumerate(columns, 1))
            update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = s.{c}' for c in rest)}" if rest else ""
            insert = f" WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join(f's.{c}' for c in columns)})"
            yield (
                f"MERGE INTO {table} t USING (SELECT {given}{self.one_row}) s ON ({' AND '.join(f't.{k} = s.{k}' for k in key)}){update}{insert}",
                [json.dumps(v) if isinstance(v, list) else v for v in row.values()],
            )

    def vertices(self, label: str, key: list[str], rows: list[dict]) -> Iterator[tuple[str, list]]:
        yield from self._merge(label, key, rows)

    def edges(self, name: str, source: End, target: End, rows: list[dict]) -> Iterator[tuple[str, list]]:
        key = list(dict.fromkeys(c for _, c in (*source.key, *target.key)))
        yield from self._merge(f"{name}_{source.label}_{target.label}", key, rows)


class DatabaseSink:
    """Merges by a dialect's statements; ``connect`` is pickled to the executors and returns a ``Runner``."""

    def __init__(self, dialect: Cypher | InlineCypher | Sql, connect: Callable[[], Runner], batch: int = BATCH):
        self.dialect, self.connect, self.batch = dialect, connect, batch

    def create_indexes(self, keys: dict[str, list[str]]) -> None:
        runner = self.connect()
        try:
            for label, key in keys.items():
                runner.run(self.dialect.index(label, key), None)
            runner.commit()
        finally:
            runner.close()

    def _send(self, rows: DataFrame, statements: Callable[[list[dict]], Iterator[tuple]]) -> None:
        connect, size = self.connect, self.batch

        def send(part) -> None:
            runner = None
            try:
                while batch := [r.asDict(recursive=True) for r in islice(part, size)]:
                    runner = runner or connect()
                    for statement, parameters in statements(batch):
                        runner.run(statement, parameters)
                    runner.commit()
            finally:
                if runner:
                    runner.close()

        rows.foreachPartition(send)

    def write_vertices(self, label: str, key: list[str], rows: DataFrame) -> None:
        dialect = self.dialect
        self._send(rows, lambda batch: dialect.vertices(label, key, batch))

    def write_edges(self, name: str, source: End, target: End, rows: DataFrame) -> None:
        dialect = self.dialect
        self._send(rows, lambda batch: dialect.edges(name, source, target, batch))


LABELS = {
    "functions": "Function", "variables": "Variable", "types": "Type", "interfaces": "Interface", "classes": "Class", "constants": "Constant",
    "jsx_elements": "JSXElement", "css_rules": "CSSRule", "references": "Reference", "imports": "Import", "files": "File", "calls": "FunctionCall",
}
CALL_KEY = ["called_func", "caller_file", "caller_func", "call_location"]


def write_graph(graph, sink: GraphSink) -> None:
    """All vertices of a ``CodeGraph``, and then all edges between them."""
    from skarn.operators.graph import VERTEX_KEYS

    keys = {LABELS[k]: key for k, key in VERTEX_KEYS.items()} | {"Import": ["module"], "File": ["path"], "FunctionCall": CALL_KEY}
    sink.create_indexes(keys)
    vertices = graph.vertices | {"files": graph.files, "calls": graph.unresolved_calls()}
    for kind, rows in vertices.items():
        sink.write_vertices(LABELS[kind], keys[LABELS[kind]], rows.drop("seq"))

    file = lambda column: End("File", (("path", column),))
    own = lambda kind, **columns: End(LABELS[kind], tuple((k, columns.get(k, k)) for k in keys[LABELS[kind]]))
    homes = {"BELONGS_TO": ("functions", "types", "interfaces", "classes"), "DEFINED_IN": ("variables", "constants", "css_rules"), "USED_IN": ("jsx_elements",)}
    for name, kinds in homes.items():
        for kind in kinds:
            known = graph.vertices[kind].join(graph.files.select(graph.files["path"].alias("file")), "file", "left_semi")
            sink.write_edges(name, own(kind), file("file"), known.select(*VERTEX_KEYS[kind]))
    sink.write_edges("IMPORTS", file("file"), own("imports"), graph.imports())
    sink.write_edges("RENDERS", own("functions", name="component"), own("jsx_elements"), graph.renders())
    sink.write_edges("CALLS", own("functions", file="caller_file", name="caller_func"), own("functions", file="target_file", name="resolved_target"), graph.calls())
    sink.write_edges("CONTAINS_CALL", file("caller_file"), own("calls"), graph.contains_call().select(*CALL_KEY))
    sink.write_edges("MAKES_CALL", own("functions", file="caller_file", name="caller_func"), own("calls"), graph.makes_call().select(*CALL_KEY))
    sink.write_edges("IMPLEMENTS", own("classes", name="class_name"), own("interfaces", file="interface_file", name="interface_name"), graph.implements())
    sink.write_edges("CONTAINS", file("source_file"), own("references"), graph.contains().withColumnRenamed("file", "source_file"))
    uses, extends = graph.uses_type(), graph.extends()
    for kind in ("types", "interfaces"):
        sink.write_edges("USES_TYPE", file("using_file"), own(kind, file="target_file"), uses.where(uses["target_kind"] == kind).drop("target_kind"))
    for child in ("classes", "interfaces"):
        for parent in ("classes", "interfaces"):
            rows = extends.where((extends["child_kind"] == child) & (extends["parent_kind"] == parent)).drop("child_kind", "parent_kind")
            sink.write_edges("EXTENDS", own(child, name="child_name"), own(parent, file="parent_file", name="parent_name"), rows)

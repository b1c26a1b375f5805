"""Parsing of file rows into entity tables.

Files are rows (path, content); every Arrow batch is parsed in one Python call, giving
one row per file with an array of structs for each kind.  The parsed rows are written
or cached once, and each entity table is an ``inline`` of its array.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .parse import parse_source

#: Fields of each kind, in order; the file field comes first.
FIELDS = {
    "functions": "file string, name string, start_line int, end_line int, signature string, is_async boolean, is_export boolean, seq bigint",
    "imports": "file string, module string, imported_names array<string>, is_default boolean, is_namespace boolean, seq bigint",
    "variables": "file string, name string, var_type string, is_const boolean, is_let boolean, start_line int, seq bigint",
    "types": "file string, name string, kind string, definition string, is_export boolean, seq bigint",
    "interfaces": "file string, name string, is_export boolean, properties array<string>, seq bigint",
    "classes": "file string, name string, start_line int, end_line int, is_export boolean, is_abstract boolean, methods array<string>, seq bigint",
    "constants": "file string, name string, value string, seq bigint",
    "jsx_elements": "file string, tag_name string, containing_component string, props array<string>, line int, is_custom_component boolean, seq bigint",
    "css_rules": "file string, selector string, rule_type string, line int, property_name string, value string, seq bigint",
    "function_calls": "caller_file string, caller_func string, called_func string, call_location int, call_context string, resolved_target string, target_file string, seq bigint",
    "type_usages": "using_file string, using_entity string, used_type string, usage_context string, usage_location int, seq bigint",
    "extends": "file string, child_name string, parent_name string, seq bigint",
    "implements": "file string, class_name string, interface_name string, seq bigint",
    "references": "source_file string, source_entity string, target_entity string, ref_type string, line int, seq bigint",
}
SCHEMA = "path string, language string, error string, " + ", ".join(f"{k} array<struct<{', '.join(f.replace(' ', ': ', 1) for f in v.split(', '))}>>" for k, v in FIELDS.items())


def parsed(files: DataFrame) -> DataFrame:
    """(path, language, error and an array for each kind) of files (path, content); a null content is empty."""
    schema = T.StructType.fromDDL(SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                records, error = parse_source(path, text or "")
                rows.append({"path": path, "language": path.rsplit(".", 1)[-1], "error": error} | records)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def entity_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Every kind's table, and ``errors`` (path, error)."""
    tables = {kind: rows.select(F.inline(kind)) for kind in FIELDS}
    tables["errors"] = rows.where(F.col("error").isNotNull()).select("path", "error")
    return tables

"""A source tree with one or two files for every document, and its extraction and graph queries.

The file of document i holds the whole text in a comment, and then declarations whose names,
parents, calls and types follow from i.  The SQL says what must come out from the ids and from
the line breaks of the texts alone; it knows nothing of the parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skarn.operators import chunks as C, extract, stats
from skarn.operators.graph import CodeGraph

from .base import parsed_once, query

#: ``{i}`` is the id, ``{b}`` its half, ``{ten}``, ``{seven}``, ``{hundred}`` its remainders.
SCRIPT = """import {{ D{b} }} from './d{b}';
export interface I{i} extends I{b} {{ size: number; }}
export type T{i} = string;
const LIMIT = {hundred};
export class D{i} extends D{b} implements I{ten} {{
  run(x: T{b}): void {{
    helper(x);
    this.go(x);
    other{seven}(x);
  }}
}}
export function helper(x) {{
  return x;
}}
"""
ELEMENTS = 'export function App() {{ return <Card size="1"><b /></Card>; }}\n'
STYLE = ".c{ten}, #k{i} {{ --v{i}: {hundred}px; }}\n"


def filled(template: str):
    """The template as a column over doc_id."""
    names = {"i": "doc_id", "b": "doc_id div 2", "ten": "doc_id % 10", "seven": "doc_id % 7", "hundred": "doc_id % 100"}
    marked = template.format(**{k: f"\0{k}\0" for k in names}).split("\0")
    return F.concat(*[F.expr(names[p]).cast("string") if n % 2 else F.lit(p) for n, p in enumerate(marked)])


def files(t) -> DataFrame:
    """(path, language, content)."""
    docs = t.documents.select("doc_id", F.concat(F.lit("/* "), F.translate(F.coalesce("text", F.lit("")), "*", " "), F.lit(" */\n")).alias("head"))
    path = lambda extension: F.concat(F.lit("gen/d"), F.col("doc_id").cast("string"), F.lit("."), extension)
    markup = F.col("doc_id") % 4 == 0
    kind = F.when(markup, "tsx").otherwise("ts")
    script = F.struct(path(kind).alias("path"), kind.alias("language"), F.concat("head", filled(SCRIPT), F.when(markup, filled(ELEMENTS)).otherwise("")).alias("content"))
    style = F.struct(path(F.lit("css")).alias("path"), F.lit("css").alias("language"), F.concat("head", filled(STYLE)).alias("content"))
    return docs.select(F.explode(F.when(F.col("doc_id") % 4 == 1, F.array(script, style)).otherwise(F.array(script))).alias("x")).select("x.*")


def tables(t) -> dict[str, DataFrame]:
    return extract.entity_tables(parsed_once(t, "generated", files))


def graph(t) -> CodeGraph:
    return CodeGraph(tables(t), files(t))


#: ``k`` is the line on which the comment ends.
TREE = """WITH s AS (SELECT doc_id AS i, doc_id // 2 AS b, (1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))::INTEGER AS k,
'gen/d' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '.tsx' ELSE '.ts' END AS file, 'gen/d' || doc_id || '.css' AS css FROM documents)
"""


@query(TREE + """SELECT file, 'helper' AS name, k + 12 AS start_line, k + 14 AS end_line, '(x)' AS signature, true AS is_export FROM s
UNION ALL SELECT file, 'run', k + 6, k + 10, '(x: T' || b || ')', false FROM s UNION ALL SELECT file, 'App', k + 15, k + 15, '()', true FROM s WHERE i % 4 = 0""")
def tree_functions(t):
    return tables(t)["functions"].select("file", "name", "start_line", "end_line", "signature", "is_export")


@query(TREE + "SELECT file, 'D' || i AS name, k + 5 AS start_line, k + 11 AS end_line, true AS is_export, 'run' AS methods FROM s")
def tree_classes(t):
    return tables(t)["classes"].select("file", "name", "start_line", "end_line", "is_export", F.array_join("methods", ",").alias("methods"))


@query(TREE + """SELECT file AS caller_file, 'run' AS caller_func, 'helper' AS called_func, k + 7 AS call_location, 'helper' AS resolved_target FROM s
UNION ALL SELECT file, 'run', 'this.go', k + 8, '' FROM s UNION ALL SELECT file, 'run', 'other' || i % 7, k + 9, '' FROM s""")
def tree_calls(t):
    return tables(t)["function_calls"].select("caller_file", "caller_func", "called_func", "call_location", "resolved_target")


@query(TREE + "SELECT file, './d' || b AS module, 'D' || b AS imported_names, false AS is_default FROM s")
def tree_import_edges(t):
    return graph(t).imports().select("file", "module", F.array_join("imported_names", ",").alias("imported_names"), "is_default")


@query(TREE + """SELECT 'variables' AS source_kind, 'LIMIT' AS source, file AS target FROM s UNION ALL SELECT 'constants', 'LIMIT', file FROM s
UNION ALL SELECT 'css_rules', unnest(['.c' || i % 10, '#k' || i, '--v' || i]), css FROM s WHERE i % 4 = 1""")
def tree_defined_in(t):
    return graph(t).defined_in().select("source_kind", "source", "target")


@query(TREE + "SELECT unnest(['Card', 'b']) AS source, file AS target FROM s WHERE i % 4 = 0")
def tree_used_in(t):
    return graph(t).used_in().select("source", "target")


@query(TREE + """SELECT 'functions' AS source_kind, unnest(['run', 'helper']) AS source, file AS target FROM s UNION ALL SELECT 'functions', 'App', file FROM s WHERE i % 4 = 0
UNION ALL SELECT 'types', 'T' || i, file FROM s UNION ALL SELECT 'interfaces', 'I' || i, file FROM s UNION ALL SELECT 'classes', 'D' || i, file FROM s""")
def tree_belongs_to(t):
    return graph(t).belongs_to().select("source_kind", "source", "target")


@query(TREE + """SELECT 'classes' AS child_kind, 'D' || c.i AS child_name, 'D' || p.i AS parent_name, 'classes' AS parent_kind, p.file AS parent_file FROM s c JOIN s p ON p.i = c.b
UNION ALL SELECT 'interfaces', 'I' || c.i, 'I' || p.i, 'interfaces', p.file FROM s c JOIN s p ON p.i = c.b""")
def tree_extends(t):
    return graph(t).extends().drop("file")


@query(TREE + "SELECT c.file, 'D' || c.i AS class_name, 'I' || p.i AS interface_name, p.file AS interface_file FROM s c JOIN s p ON p.i = c.i % 10")
def tree_implements(t):
    return graph(t).implements()


@query(TREE + "SELECT u.file AS using_file, 'T' || d.i AS name, d.file AS target_file, 'types' AS target_kind, 'parameter' AS usage_context, u.k + 6 AS usage_location FROM s u JOIN s d ON d.i = u.b")
def tree_uses_type(t):
    return graph(t).uses_type().select("using_file", "name", "target_file", "target_kind", "usage_context", "usage_location")


@query(TREE + """SELECT css AS file, '.c' || i % 10 AS selector, 'class' AS rule_type, k + 1 AS line, '' AS value FROM s WHERE i % 4 = 1 UNION ALL SELECT css, '#k' || i, 'id', k + 1, '' FROM s WHERE i % 4 = 1
UNION ALL SELECT css, '--v' || i, 'variable', k + 1, i % 100 || 'px' FROM s WHERE i % 4 = 1""")
def tree_css(t):
    return tables(t)["css_rules"].select("file", "selector", "rule_type", "line", "value")


@query(TREE + """SELECT 'func_' || file || '_' || unnest(['run', 'helper']) AS id, 'function' AS chunk_type FROM s UNION ALL SELECT 'func_' || file || '_App', 'function' FROM s WHERE i % 4 = 0
UNION ALL SELECT 'class_' || file || '_D' || i, 'class' FROM s UNION ALL SELECT 'interface_' || file || '_I' || i, 'interface' FROM s UNION ALL SELECT 'type_' || file || '_T' || i, 'type' FROM s
UNION ALL SELECT 'jsx_' || file || '_App', 'jsx_component' FROM s WHERE i % 4 = 0 UNION ALL SELECT 'imports_' || file, 'imports' FROM s UNION ALL SELECT 'file_' || css, 'file' FROM s WHERE i % 4 = 1""")
def tree_chunks(t):
    return C.all_chunks(tables(t), files(t)).select("id", "chunk_type")


@query(TREE + """SELECT 'class' AS chunk_type, 'class_' || file || '_D' || i AS id, md5('export class D' || i || ' extends D' || b || ' implements I' || i % 10 || ' {' || chr(10) || '  run(x: T' || b || '): void {' || chr(10) || '    helper(x);'
|| chr(10) || '    this.go(x);' || chr(10) || '    other' || i % 7 || '(x);' || chr(10) || '  }' || chr(10) || '}') AS digest FROM s""")
def tree_class_contents(t):
    return C.class_chunks(tables(t)["classes"], files(t)).select("chunk_type", "id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(TREE + """SELECT unnest(['functions', 'imports', 'variables', 'types', 'interfaces', 'classes', 'constants', 'jsx_elements', 'css_rules', 'function_calls', 'type_usages', 'extends', 'implements', 'references', 'errors']) AS kind,
unnest([2 * count(*) + count(*) FILTER (i % 4 = 0), count(*), count(*), count(*), count(*), count(*), count(*), 2 * count(*) FILTER (i % 4 = 0), 3 * count(*) FILTER (i % 4 = 1), 3 * count(*), count(*), 2 * count(*), count(*), 0, 0]) AS n FROM s""")
def tree_report(t):
    return stats.entity_counts(tables(t))

"""Extraction, graph and chunk queries over the fixture tree, with hand-derived golden rows as their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skarn.operators import chunks as C, extract, stats
from skarn.operators.graph import CodeGraph

from .base import parsed_once, query
from .corpus import FILES


def files(t) -> DataFrame:
    rows = t.spark.createDataFrame(list(FILES.items()), "path string, content string")  # the fixture tree: nine rows
    return rows.withColumn("language", F.regexp_extract("path", r"\.([^./]+)$", 1))


def tables(t) -> dict[str, DataFrame]:
    return extract.entity_tables(parsed_once(t, "fixture", files))


def graph(t) -> CodeGraph:
    return CodeGraph(tables(t), files(t))


def golden(columns: str, *rows: tuple) -> str:
    """``SELECT`` of literal rows; whole numbers are integers."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(_literal(x) for x in r) + ')' for r in rows)}) AS g({columns})"


def _literal(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    return f"{x}::INTEGER" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def flat(df: DataFrame) -> DataFrame:
    """Lists as comma-joined text, without seq."""
    return df.select([F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes if c != "seq"])


M, S, U, A, L, T, V = "src/models.ts", "src/service.ts", "src/util.js", "src/App.tsx", "src/Legacy.jsx", "src/theme.css", "src/vars.scss"


@query(golden("file, name, start_line, end_line, signature, is_async, is_export",
    (M, "format", 32, 34, "(text: string)", False, False), (M, "describe", 16, 18, "(level: number)", False, False), (M, "constructor", 22, 24, "(private data: UserData)", False, False),
    (M, "load", 26, 29, "(repo: Repo<UserData>)", True, False), (M, "describe", 3, 3, "(level: number)", False, False), (S, "format", 23, 26, "(value: Data)", False, True),
    (S, "promote", 9, 13, "(target: User)", False, False), (S, "audit", 16, 19, "", True, True), (S, "plain", 21, 21, "", False, False), (U, "helper", 11, 14, "(n)", False, False),
    (U, "add", 5, 8, "(n)", False, False), (U, "twice", 16, 16, "", False, False), (A, "App", 4, 15, "({ title }: Props)", False, True), (A, "Footer", 17, 17, "", False, False), (L, "Old", 1, 3, "", False, False)))
def extract_functions(t):
    return flat(tables(t)["functions"])


@query(golden("file, module, imported_names, is_default, is_namespace",
    (S, "./models", "User,UserData,Data", False, False), (S, "path", "path", False, True), (S, "./logger", "Logger", True, False), (U, "fs", "", False, False),
    (A, "react", "React,useState", True, False), (A, "./Card", "Card", False, False)))
def extract_imports(t):
    return flat(tables(t)["imports"])


@query(golden("file, name, var_type, is_const, is_let, start_line",
    (M, "found", "variable", True, False, 27), (S, "LIMIT", "variable", True, False, 5), (S, "cache", "variable", False, True, 6), (S, "parts", "variable", True, False, 24),
    (U, "fs", "variable", True, False, 1), (U, "total", "variable", False, False, 2), (U, "rate", "variable", False, False, 2)))
def extract_variables(t):
    return flat(tables(t)["variables"])


@query(golden("file, name, kind, definition, is_export", (M, "Tag", "type_alias", "string | Label", True), (M, "Label", "type_alias", "{ text: string }", False)))
def extract_types(t):
    return flat(tables(t)["types"])


@query(golden("file, name, is_export, properties", (M, "Entity", True, "id"), (M, "UserData", True, "name,tags")))
def extract_interfaces(t):
    return flat(tables(t)["interfaces"])


@query(golden("file, name, start_line, end_line, is_export, is_abstract, methods",
    (M, "Base", 14, 19, True, True, "describe"), (M, "User", 21, 30, True, False, "constructor,load"), (S, "Admin", 8, 14, True, False, "promote"), (U, "Counter", 4, 9, False, False, "add")))
def extract_classes(t):
    return flat(tables(t)["classes"])


@query(golden("file, name, value", (S, "LIMIT", "10")))
def extract_constants(t):
    return flat(tables(t)["constants"])


CALLS = [
    (M, "describe", "format", 17, "", "format", M), (M, "load", "repo.fetch", 27, "repo", "", ""), (M, "format", "text.trim", 33, "text", "", ""), (S, "promote", "audit", 10, "", "audit", S), (S, "audit", "format", 17, "", "format", S),
    (S, "format", "plain", 24, "", "plain", S), (S, "", "audit", 28, "", "audit", S), (S, "promote", "this.log", 11, "this", "", ""), (S, "promote", "Admin.promote", 12, "Admin", "promote", S), (S, "audit", "path.join", 17, "path", "", ""),
    (S, "audit", "Logger.write", 18, "Logger", "", ""), (S, "format", "map", 24, "", "", ""), (S, "format", "parts.join", 25, "parts", "", ""), (U, "", "require", 1, "", "", ""), (U, "add", "helper", 7, "", "helper", U),
    (U, "helper", "String", 12, "", "", ""), (U, "helper", "twice", 13, "", "twice", U), (U, "helper", "test", 12, "", "", ""), (A, "App", "useState", 5, "", "", ""), (A, "App", "setOpen", 9, "", "", ""), (A, "App", "items.map", 11, "items", "", ""),
]


@query(golden("caller_file, caller_func, called_func, call_location, call_context, resolved_target, target_file", *CALLS))
def extract_calls(t):
    return flat(tables(t)["function_calls"])


@query(golden("using_file, using_entity, used_type, usage_context, usage_location",
    (M, "interface:UserData", "Tag", "property", 8), (M, "function:constructor", "UserData", "parameter", 22), (M, "function:load", "Repo", "parameter", 26), (M, "function:load", "UserData", "type_argument", 26),
    (M, "function:load", "Promise", "return_type", 26), (M, "function:load", "User", "type_argument", 26), (S, "", "Map", "annotation", 6), (S, "", "User", "type_argument", 6), (S, "function:promote", "User", "parameter", 9),
    (S, "function:audit", "User", "parameter", 16), (S, "function:format", "Data", "parameter", 23), (A, "function:App", "Props", "parameter", 4)))
def extract_type_usages(t):
    return flat(tables(t)["type_usages"])


JSX = [
    (A, "Layout", "App", "className,dark", 7, True), (A, "h1", "App", "id", 8, False), (A, "ul", "App", "", 10, False), (A, "li", "App", "key", 11, False), (A, "footer", "Footer", "", 17, False),
    (A, "Card", "App", "size,onClick", 9, True), (A, "br", "Footer", "", 17, False), (L, "div", "Old", "", 2, False), (L, "Icon", "Old", "name", 2, True),
]


@query(golden("file, tag_name, containing_component, props, line, is_custom_component", *JSX))
def extract_jsx(t):
    return flat(tables(t)["jsx_elements"])


@query(golden("file, selector, rule_type, line, property_name, value",
    (T, ".button", "class", 5, "", ""), (T, ".primary", "class", 5, "", ""), (T, ".button", "class", 9, "", ""), (T, ".icon", "class", 9, "", ""), (T, "#save", "id", 5, "", ""),
    (T, "--main-color", "variable", 2, "--main-color", "#ff0000"), (T, "--gap", "variable", 3, "--gap", "4px"), (V, ".card", "class", 3, "", ""), (V, ".title", "class", 4, "", ""), (V, "--depth", "variable", 4, "--depth", "1")))
def extract_css(t):
    return flat(tables(t)["css_rules"])


@query(golden("path, failed", ("src/broken.ts", True)))
def parse_errors(t):
    return tables(t)["errors"].select("path", F.col("error").isNotNull().alias("failed"))


@query(golden("name, signature, start_line", ("describe", "(level: number)", 3), ("constructor", "(private data: UserData)", 22), ("load", "(repo: Repo<UserData>)", 26), ("format", "(text: string)", 32)))
def graph_q1(t):
    return graph(t).functions_of(M)


PAIRS = [("describe", "format", 17), ("promote", "audit", 10), ("audit", "format", 17), ("format", "plain", 24), ("promote", "promote", 12), ("add", "helper", 7), ("helper", "twice", 13)]


@query(golden("caller, target, call_location", *PAIRS))
def graph_q2(t):
    return graph(t).call_pairs()


@query(golden("child, parent", ("User", "Base"), ("Admin", "User"), ("Counter", "Base")))
def graph_q3(t):
    return graph(t).class_parents()


@query(golden("class, interface", ("Base", "Entity"), ("User", "Entity"), ("User", "UserData"), ("Admin", "UserData")))
def graph_q4(t):
    return graph(t).interface_classes()


@query(golden("tag_name, containing_component, path", *[(tag, component, file) for file, tag, component, *_ in JSX if file == A]))
def graph_q5(t):
    return graph(t).elements_in(".tsx")


@query(golden("name, signature, path", ("describe", "(level: number)", M), ("constructor", "(private data: UserData)", M), ("load", "(repo: Repo<UserData>)", M), ("format", "(text: string)", M)))
def graph_q6(t):
    return graph(t).functions_using("UserData")


@query(golden("name, signature", ("App", "({ title }: Props)"), ("Footer", "")))
def graph_q7(t):
    graph(t).create_views("g_")
    return t.spark.sql(f"SELECT f.name, f.signature FROM g_functions f JOIN g_files p ON f.file = p.path WHERE p.path = '{A}'")


@query(golden("using_file, name, target_file, target_kind, usage_context, usage_location", (M, "Tag", M, "types", "property", 8), (M, "UserData", M, "interfaces", "type_argument", 26)))
def graph_uses_type(t):
    return graph(t).uses_type().select("using_file", "name", "target_file", "target_kind", "usage_context", "usage_location")


@query(golden("child_name, child_kind, parent_name, parent_kind, parent_file", ("UserData", "interfaces", "Entity", "interfaces", M), ("User", "classes", "Base", "classes", M), ("Admin", "classes", "User", "classes", M), ("Counter", "classes", "Base", "classes", M)))
def graph_extends(t):
    return graph(t).extends().drop("file")


@query(golden("file, class_name, interface_name, interface_file", (M, "Base", "Entity", M), (M, "User", "Entity", M), (M, "User", "UserData", M), (S, "Admin", "UserData", M)))
def graph_implements(t):
    return graph(t).implements()


@query(golden("file, source_entity, target_entity, ref_type, line", (M, "function:load", "User", "instantiates", 28), (S, "", "Map", "instantiates", 6)))
def graph_references(t):
    return graph(t).contains()


@query(golden("called_func, caller_file, caller_func, call_location", *[(c[2], c[0], c[1], c[3]) for c in CALLS if not c[5]]))
def graph_unresolved_calls(t):
    return graph(t).contains_call().select("called_func", "caller_file", "caller_func", "call_location")


@query(golden("called_func, caller_func, call_location", *[(c[2], c[1], c[3]) for c in CALLS if not c[5] and c[1]]))
def graph_makes_call(t):
    return graph(t).makes_call().select("called_func", "caller_func", "call_location")


@query(golden("file, component, tag_name, line", *[(file, component, tag, line) for file, tag, component, _, line, _ in JSX]))
def graph_renders(t):
    return graph(t).renders()


@query(golden("kind, n", *[(k, n) for k, n in (("functions", 15), ("imports", 6), ("variables", 7), ("types", 2), ("interfaces", 2), ("classes", 4), ("constants", 1), ("jsx_elements", 9), ("css_rules", 10), ("function_calls", 21), ("type_usages", 12), ("extends", 4), ("implements", 4), ("references", 2), ("errors", 1))]))
def parse_report(t):
    return stats.entity_counts(tables(t)).select("kind", F.col("n").cast("int").alias("n"))


CHUNKS = [
    *[("function", f"func_{f}_{n}") for f, n in ((M, "format"), (M, "describe"), (M, "constructor"), (M, "load"), (M, "describe"), (S, "format"), (S, "promote"), (S, "audit"), (S, "plain"), (U, "helper"), (U, "add"), (U, "twice"), (A, "App"), (A, "Footer"), (L, "Old"))],
    *[("class", f"class_{f}_{n}") for f, n in ((M, "Base"), (M, "User"), (S, "Admin"), (U, "Counter"))], ("interface", f"interface_{M}_Entity"), ("interface", f"interface_{M}_UserData"), ("type", f"type_{M}_Tag"), ("type", f"type_{M}_Label"),
    ("jsx_component", f"jsx_{A}_App"), ("jsx_component", f"jsx_{A}_Footer"), ("jsx_component", f"jsx_{L}_Old"), ("imports", f"imports_{S}"), ("imports", f"imports_{U}"), ("imports", f"imports_{A}"),
    ("file", f"file_{T}"), ("file", f"file_{V}"), ("file", "file_src/broken.ts"),
]


@query(golden("chunk_type, id", *CHUNKS))
def code_chunks(t):
    return C.all_chunks(tables(t), files(t)).select("chunk_type", "id")


@query(golden("id, content", (f"func_{S}_plain", "const plain = function (x) { return x; };"), (f"func_{U}_twice", "const twice = n => n * 2;"), (f"imports_{S}", f"// Imports for {S}\nimport from './models'\nimport from 'path'\nimport from './logger'\n"), (f"type_{M}_Tag", "string | Label")))
def code_chunk_contents(t):
    rows = C.all_chunks(tables(t), files(t))
    return rows.where(F.col("id").isin(f"func_{S}_plain", f"func_{U}_twice", f"imports_{S}", f"type_{M}_Tag")).select("id", "content")


@query(golden("digest_text", (f"Type: class\nName: Counter\nFile: {U}\nLanguage: js\nMethods: add\n\n--- Content ---\n\n" + "class Counter extends Base {\n  add(n) {\n    total += n;\n    return helper(n);\n  }\n}",)))
def code_embedding_text(t):
    rows = C.class_chunks(tables(t)["classes"], files(t)).where("name = 'Counter'")
    return rows.select(C.embedding_text().alias("digest_text"))

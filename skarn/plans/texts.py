"""Path, line, hash and markup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import exprs as X
from skarn.operators import markup

from .base import query

URL_PATH = "regexp_replace(url, '^[a-z]+://[^/]*/', '')"


@query("SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", X.content_hash(F.col("text").cast("binary")).alias("hash"))


@query("""SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines_2_4,
 CASE WHEN 3 <= len(string_split(text, chr(10))) THEN array_to_string(string_split(text, chr(10))[3:100000], chr(10)) ELSE '' END AS lines_from_3, '' AS none FROM documents
 WHERE len(string_split(text, chr(10))) >= 2""")
def line_slice(t):
    text, lit = F.col("text"), F.lit
    rows = t.documents.where(X.line_count(text) >= 2)
    return rows.select("doc_id", X.line_slice(text, lit(2), lit(4)).alias("lines_2_4"), X.line_slice(text, lit(3), lit(100000)).alias("lines_from_3"), X.line_slice(text, lit(4), lit(2)).alias("none"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents")
def line_count(t):
    return t.documents.select("doc_id", X.line_count(F.col("text")).alias("n_lines"))


@query(f"SELECT page_id, {URL_PATH} AS path FROM pages WHERE NOT list_has_any(string_split({URL_PATH}, '/')[1:len(string_split({URL_PATH}, '/')) - 1], ['en', 'dist', 'build'])")
def path_prune(t):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    return t.pages.select("page_id", path.alias("path")).where(~X.pruned(F.col("path"), ("en", "dist", "build")))


@query("""SELECT page_id, name, regexp_extract(name, '(\\.[^./]+)$', 1) AS extension, substr(regexp_extract(name, '(\\.[^./]+)$', 1), 2) AS lang FROM (
SELECT page_id, 'src/p' || page_id || CASE page_id % 9 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' WHEN 3 THEN '.jsx' WHEN 4 THEN '.css' WHEN 5 THEN '.scss' WHEN 6 THEN '.TS' WHEN 7 THEN '.d.md' ELSE '' END AS name FROM pages)
WHERE regexp_extract(name, '(\\.[^./]+)$', 1) IN ('.ts', '.tsx', '.js', '.jsx', '.css', '.scss')""")
def ext_filter(t):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".tsx", ".js", ".jsx", ".css", ".scss", ".TS", ".d.md", "")]), (F.col("page_id") % 9 + 1).cast("int"))
    names = t.pages.select("page_id", F.concat(F.lit("src/p"), F.col("page_id").cast("string"), suffix).alias("name"))
    return names.where(X.supported(F.col("name"))).select("page_id", "name", X.extension(F.col("name")).alias("extension"), X.language(F.col("name")).alias("lang"))


@query("""SELECT page_id, CASE WHEN starts_with(path, '/srv/even/') THEN substr(path, 11) ELSE path END AS relative, regexp_extract(path, '([^/]*)$', 1) AS base FROM (
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/srv/even/' ELSE '/srv/odd/' END || 'a/b' || page_id || '.ts' AS path FROM pages)""")
def rel_path(t):
    folder = F.when(F.col("page_id") % 2 == 0, "/srv/even/").otherwise("/srv/odd/")
    rows = t.pages.select("page_id", F.concat(folder, F.lit("a/b"), F.col("page_id").cast("string"), F.lit(".ts")).alias("path"))
    return rows.select("page_id", X.relative(F.col("path"), "/srv/even").alias("relative"), X.base_name(F.col("path")).alias("base"))


TAGS = "unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9.]*)([^<>]*)>', 1)) AS tag_name"


@query(f"SELECT page_id, tag_name, count(*) AS n FROM (SELECT page_id, {TAGS} FROM pages) GROUP BY ALL")
def markup_elements(t):
    return markup.elements(t.pages, "page_id", "html").groupBy("page_id", "tag_name").agg(F.count("*").alias("n"))


@query("""SELECT page_id, tag, array_to_string(regexp_extract_all(attributes, '([A-Za-z_][A-Za-z0-9_-]*)=', 1), ',') AS props, count(*) AS n FROM (
SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9.]*)([^<>]*)>', 1)) AS tag, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9.]*)([^<>]*)>', 2)) AS attributes FROM pages)
WHERE len(regexp_extract_all(attributes, '([A-Za-z_][A-Za-z0-9_-]*)=', 1)) > 0 GROUP BY ALL""")
def markup_props(t):
    rows = markup.elements(t.pages, "page_id", "html").withColumn("props", markup.props(F.col("attributes"))).where(F.size("props") > 0)
    return rows.groupBy("page_id", F.col("tag_name").alias("tag"), F.array_join("props", ",").alias("props")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, name, upper(substr(name, 1, 1)) = substr(name, 1, 1) AS is_custom FROM (SELECT p_partkey,
CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name WHEN 2 THEN '_' || p_name ELSE p_size::VARCHAR END AS name FROM part)""")
def custom_component(t):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_type")).when(k == 1, F.col("p_name")).when(k == 2, F.concat(F.lit("_"), F.col("p_name"))).otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", name.alias("name")).withColumn("is_custom", X.is_custom_component(F.col("name")))


SHEET = "'.b' || {k} || ' .in { color: #fff; }' || chr(10) || '#m' || {k} || ' { --gap: ' || {k} || 'px; }' || chr(10) || 'p { margin: 0 }'"


@query("""SELECT page_id, 1 AS line, '.b' || page_id AS selector, 'class' AS rule_type, '' AS value FROM pages
UNION ALL SELECT page_id, 1, '.in', 'class', '' FROM pages UNION ALL SELECT page_id, 2, '#m' || page_id, 'id', '' FROM pages
UNION ALL SELECT page_id, 2, '--gap', 'variable', page_id || 'px' FROM pages""")
def css_selectors(t):
    k = F.col("page_id").cast("string")
    sheet = F.concat(F.lit(".b"), k, F.lit(" .in { color: #fff; }\n#m"), k, F.lit(" { --gap: "), k, F.lit("px; }\np { margin: 0 }"))
    rows = markup.style_rules(t.pages.select("page_id", sheet.alias("css")), "page_id", "css")
    return rows.select("page_id", F.col("line").cast("int").alias("line"), "selector", "rule_type", "value")


@query("""SELECT page_id, called, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<script>(.*?)</script>', 1), '([A-Za-z_$][A-Za-z0-9_$]*)\\(', 1)) AS called FROM pages) GROUP BY ALL""")
def call_sites(t):
    code = F.regexp_extract("html", r"<script>(.*?)</script>", 1)
    return markup.calls(t.pages.withColumn("code", code), "page_id", "code").groupBy("page_id", "called").agg(F.count("*").alias("n"))


@query("""SELECT page_id, module, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS module FROM pages) GROUP BY ALL""")
def import_refs(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("module")).groupBy("page_id", "module").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, (o_totalprice > 100000)::INT AS flag, o_orderstatus || ',' || o_orderpriority AS list FROM orders")
def oracle_values(t):
    return t.orders.select("o_orderkey", X.oracle_value(F.col("o_totalprice") > 100000, "boolean").alias("flag"), X.oracle_value(F.array("o_orderstatus", "o_orderpriority"), "list").alias("list"))


@query("""SELECT doc_id, upper(lang) AS upper_lang, trim('  ' || lang || ' ') AS trimmed, replace(source, 'src', 'file') AS replaced, starts_with(source, 'src1') AS starts, ends_with(source, '1') AS ends,
contains(source, 'c1') AS has, len(string_split(source || '.' || lang, '.')) AS parts FROM documents""")
def string_functions(t):
    s, g = F.col("source"), F.col("lang")
    return t.documents.select(
        "doc_id", F.upper(g).alias("upper_lang"), F.trim(F.concat(F.lit("  "), g, F.lit(" "))).alias("trimmed"), F.replace(s, F.lit("src"), F.lit("file")).alias("replaced"),
        s.startswith("src1").alias("starts"), s.endswith("1").alias("ends"), s.contains("c1").alias("has"), F.size(F.split(F.concat_ws(".", s, g), r"\.", -1)).cast("bigint").alias("parts"),
    )


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS modified FROM events")
def unix_seconds(t):
    return t.events.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("modified"))

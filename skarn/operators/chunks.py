"""Code chunks and the text that is embedded for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skarn.functions.exprs import chunk_id, line_slice, non_empty

from .merge import latest, merge

COLUMNS = ("id", "chunk_type", "name", "file_path", "content", "start_line", "end_line", "language", "metadata")


def _chunk(rows: DataFrame, kind: str, prefix: str, name: Column, content: Column, metadata: list[Column], lines: bool = False, named: bool = True) -> DataFrame:
    zero = F.lit(0)
    return rows.select(
        chunk_id(prefix, F.col("file"), name if named else None).alias("id"), F.lit(kind).alias("chunk_type"), name.alias("name"), F.col("file").alias("file_path"), content.alias("content"),
        (F.col("start_line") if lines else zero).cast("int").alias("start_line"), (F.col("end_line") if lines else zero).cast("int").alias("end_line"), "language", F.to_json(F.struct(*metadata)).alias("metadata"),
    )


def function_chunks(functions: DataFrame, files: DataFrame) -> DataFrame:
    rows = functions.join(files.select(F.col("path").alias("file"), "language", F.col("content").alias("source")), "file")
    return _chunk(rows, "function", "func", F.col("name"), line_slice(F.col("source"), F.col("start_line"), F.col("end_line")), [F.col(c) for c in ("signature", "is_async", "is_export")], True)


def class_chunks(classes: DataFrame, files: DataFrame) -> DataFrame:
    rows = classes.join(files.select(F.col("path").alias("file"), "language", F.col("content").alias("source")), "file")
    return _chunk(rows, "class", "class", F.col("name"), line_slice(F.col("source"), F.col("start_line"), F.col("end_line")), [F.col(c) for c in ("is_export", "is_abstract", "methods")], True)


def interface_chunks(interfaces: DataFrame, files: DataFrame) -> DataFrame:
    rows = interfaces.join(files.select(F.col("path").alias("file"), "language"), "file")
    return _chunk(rows, "interface", "interface", F.col("name"), F.lit(""), [F.col("is_export"), F.col("properties")])


def type_chunks(types: DataFrame, files: DataFrame) -> DataFrame:
    rows = types.join(files.select(F.col("path").alias("file"), "language"), "file")
    return _chunk(rows, "type", "type", F.col("name"), F.col("definition"), [F.col("kind"), F.col("is_export")])


def jsx_chunks(elements: DataFrame, files: DataFrame) -> DataFrame:
    """One chunk for each named component: its elements in order; the content stays empty."""
    rows = elements.where(non_empty(F.col("containing_component"))).groupBy("file", "containing_component")
    item = F.struct("seq", F.struct(F.col("tag_name").alias("tag"), "props", "line").alias("item"))
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("jsx_elements"))
    rows = rows.join(files.select(F.col("path").alias("file"), "language"), "file")
    chunk = _chunk(rows, "jsx_component", "jsx", F.col("containing_component"), F.lit(""), [F.col("containing_component").alias("component_name"), F.col("jsx_elements")])
    return chunk.withColumn("name", F.concat("name", F.lit("_jsx")))


def import_lines(imports: DataFrame) -> DataFrame:
    """(file, content, modules): header and one line for each import, in order."""
    rows = imports.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "module"))), lambda x: x["module"]).alias("modules"))
    lines = F.array_join(F.transform("modules", lambda m: F.concat(F.lit("import from '"), m, F.lit("'\n"))), "")
    return rows.select("file", F.concat(F.lit("// Imports for "), F.col("file"), F.lit("\n"), lines).alias("content"), "modules")


def import_chunks(imports: DataFrame, files: DataFrame) -> DataFrame:
    rows = import_lines(imports).join(files.select(F.col("path").alias("file"), "language"), "file")
    return _chunk(rows, "imports", "imports", F.lit("imports"), F.col("content"), [F.col("modules")], named=False)


def fallback_chunks(files: DataFrame, chunked: DataFrame) -> DataFrame:
    """A whole-file chunk for files (file_path, content, language) with content and no other chunk."""
    rows = files.where(non_empty(F.col("content"))).join(chunked.select("file_path").distinct(), "file_path", "left_anti").withColumnRenamed("file_path", "file")
    return _chunk(rows, "file", "file", F.col("file"), F.col("content"), [F.lit(True).alias("is_fallback")], named=False)


def all_chunks(tables: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """The union of the six kinds, and the fallback for files that have none."""
    kinds = [
        function_chunks(tables["functions"], files), class_chunks(tables["classes"], files), interface_chunks(tables["interfaces"], files),
        type_chunks(tables["types"], files), jsx_chunks(tables["jsx_elements"], files), import_chunks(tables["imports"], files),
    ]
    found = reduce(DataFrame.unionByName, kinds)
    rest = fallback_chunks(files.select(F.col("path").alias("file_path"), "content", "language"), found)
    return found.unionByName(rest)


def newest(chunks: DataFrame) -> DataFrame:
    """One chunk for each id: same-named functions of a file share one, the last in the file stays."""
    return latest(chunks, ["id"], ["start_line", "end_line", "content"])


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """``store`` with the new chunks in the place of those with their ids."""
    return merge(store, newest(new), ["id"]).drop("change")


def embedding_text() -> Column:
    """The text of a chunk row: header lines, those with a value only, a separator line and the content."""
    line = lambda label, value: F.when(non_empty(value), F.concat(F.lit(f"{label}: "), value))
    listed = lambda path: F.array_join(F.from_json(F.get_json_object("metadata", path), "array<string>"), ", ")
    kind = F.col("chunk_type")
    lines = F.array(
        F.concat(F.lit("Type: "), kind), line("Name", F.col("name")), F.concat(F.lit("File: "), F.col("file_path")), line("Language", F.col("language")),
        F.when(kind == "function", line("Signature", F.get_json_object("metadata", "$.signature"))),
        F.when(kind == "class", line("Methods", listed("$.methods"))), F.when(kind == "interface", line("Properties", listed("$.properties"))),
        F.lit("\n--- Content ---\n"), F.coalesce("content", F.lit("")),
    )
    return F.array_join(F.array_compact(lines), "\n")

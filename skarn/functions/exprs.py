"""Scalar expressions over files, code lines, names and vectors; all are Catalyst columns but the Arrow vector kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, functions as F

#: Fixed extension and directory lists of the file scan.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".css", ".scss")
BATCH_SKIP = ("node_modules", "out", "dist", "build", ".git", ".vscode-test", "resources", "coverage", ".next")
MONITOR_SKIP = ("node_modules", "dist", "build", ".git", "coverage", ".next", "vendor", ".vscode", ".idea", "__pycache__", ".pytest_cache")


def extension(path: Column) -> Column:
    """The last dotted suffix of the base name, dot included; '' if it has none."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def language(path: Column) -> Column:
    return F.substring(extension(path), 2, 1 << 20)


def supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def pruned(path: Column, skip: tuple[str, ...] = BATCH_SKIP) -> Column:
    """Whether a directory of the path (not its last segment) is one to skip."""
    parts = F.split(path, "/", -1)
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skip]))


def relative(path: Column, root: str) -> Column:
    """The path below ``root``, or the path itself where it lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(path)


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive); '' for bounds below 1, a start past the end or behind ``end``."""
    lines = F.split(text, "\n", -1)
    good = (start > 0) & (end > 0) & (start <= F.size(lines)) & (start <= end)
    return F.when(good, F.array_join(F.slice(lines, F.when(good, start).otherwise(1), F.when(good, end - start + 1).otherwise(0)), "\n")).otherwise("")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1)).cast("bigint")


def content_hash(content: Column) -> Column:
    return F.md5(content)


def is_custom_component(tag: Column) -> Column:
    """The first character is its own upper case (so digits and underscores count)."""
    first = F.substring(tag, 1, 1)
    return F.upper(first) == first


def non_empty(column: Column) -> Column:
    return column.isNotNull() & (column != "")


def chunk_id(kind: str, path: Column, name: Column | None = None) -> Column:
    return F.concat_ws("_", F.lit(kind), path, *([name] if name is not None else []))


def vector_text(vector: Column) -> Column:
    """'[x,y,...]' with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]]", ""), ","), lambda x: x.cast("double"))


def oracle_value(column: Column, kind: str) -> Column:
    """Booleans as 0/1 and lists as comma-joined text."""
    return column.cast("int") if kind == "boolean" else F.concat_ws(",", column)


def keyword_match(column: Column, keyword: str) -> Column:
    """Case-insensitive containment of literal text."""
    return F.contains(F.lower(column), F.lower(F.lit(keyword)))


def cosine_distance_to(column: Column, vector: list[float]) -> Column:
    """1 - cosine of a list column with a fixed vector, in double: one matrix product for each Arrow batch.

    Null where the vector is null, of another length, or zero.
    """
    query = np.asarray(vector, np.float64)
    norm = float(np.linalg.norm(query))

    def distance(batch: pa.Array) -> pa.Array:
        out = np.full(len(batch), np.nan)
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch), -1))
        good = np.flatnonzero(lengths == len(query))
        if len(good) and norm:
            rows = batch.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), -1)
            sizes = np.linalg.norm(rows, axis=1) * norm
            with np.errstate(invalid="ignore", divide="ignore"):
                out[good] = 1.0 - rows @ query / sizes
        return pa.array(out, pa.float64(), mask=~np.isfinite(out))

    return F.arrow_udf(distance, "double")(column)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two list columns, in double, as Catalyst expressions."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), 1 - dot(a, b) / size)

"""Entity diffs between two snapshots, and their application.

A diff is one full outer join on the key.  It works for every entity kind: give the key
and the properties that count as a change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .merge import latest

#: What makes an entity differ, by kind; the key is (file, name) unless stated.
COMPARED = {
    "functions": ("start_line", "end_line", "signature", "is_async", "is_export"),
    "classes": ("start_line", "end_line", "is_export", "is_abstract", "methods"),
    "interfaces": ("is_export", "properties"),
    "types": ("kind", "definition", "is_export"),
    "variables": ("var_type", "is_const", "is_let", "start_line"),
    "imports": ("imported_names", "is_default", "is_namespace"),
    "jsx_elements": ("containing_component", "props"),
    "css_rules": ("rule_type", "line", "property_name", "value"),
    "function_calls": ("call_context", "resolved_target"),
}
KEYS = {"imports": ["file", "module"], "jsx_elements": ["file", "tag_name", "line"], "css_rules": ["file", "selector"], "function_calls": ["caller_file", "called_func", "caller_func", "call_location"]}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def diff(old: DataFrame, new: DataFrame, key: list[str], compared: list[str] | tuple[str, ...], order: list[str] | None = None) -> DataFrame:
    """key, change (added, modified, removed), old and new (structs of ``compared``) of the entities that changed.

    With ``order`` a key that occurs more than once in a snapshot counts as its last row.
    """
    keep = [*key, *compared]
    sides = [(latest(df, key, order) if order else df).select(*keep).withColumn("_in", F.lit(True)) for df in (old, new)]
    o, n = sides[0].alias("o"), sides[1].alias("n")
    joined = o.join(n, _all([F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]), "full_outer")
    same = _all([F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in compared]) if compared else F.lit(True)
    change = F.when(F.col("o._in").isNull(), "added").when(F.col("n._in").isNull(), "removed").when(~same, "modified")
    side = lambda s: F.when(F.col(f"{s}._in"), F.struct(*[F.col(f"{s}.{c}").alias(c) for c in compared]))
    keys = [F.when(F.col("n._in"), F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in key]
    return joined.select(*keys, change.alias("change"), side("o").alias("old"), side("n").alias("new")).where(F.col("change").isNotNull())


def apply_diff(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with added and modified entities upserted and removed ones deleted."""
    kept = old.join(changes.select(*key), key, "left_anti")
    return kept.unionByName(changes.where("change <> 'removed'").select(*key, "new.*").select(*old.columns))


def diff_all(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(file, entity_kind, change, key) over every kind that both snapshots have."""
    parts = []
    for kind in (k for k in COMPARED if k in old and k in new):
        key = KEYS.get(kind, ["file", "name"])
        found = diff(old[kind], new[kind], key, COMPARED[kind], ["seq"])
        parts.append(found.select(F.col(key[0]).alias("file"), F.lit(kind).alias("entity_kind"), "change", F.concat_ws(":", *[F.col(k).cast("string") for k in key[1:]]).alias("key")))
    return reduce(DataFrame.unionByName, parts)

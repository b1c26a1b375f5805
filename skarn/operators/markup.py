"""Markup and style extraction in Catalyst only: pattern matches, exploded with their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skarn.functions.exprs import is_custom_component

TAG = r"<([A-Za-z][A-Za-z0-9.]*)([^<>]*)>"


def elements(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """One row for each opening tag: key, seq, tag_name, attributes (text) and is_custom_component."""
    found = F.arrays_zip(F.regexp_extract_all(markup, F.lit(TAG), F.lit(1)).alias("tag"), F.regexp_extract_all(markup, F.lit(TAG), F.lit(2)).alias("attributes"))
    rows = pages.select(key, F.posexplode(found).alias("seq", "x"))
    return rows.select(key, F.col("seq").cast("bigint").alias("seq"), F.col("x.tag").alias("tag_name"), F.col("x.attributes").alias("attributes"), is_custom_component(F.col("x.tag")).alias("is_custom_component"))


def props(attributes: Column) -> Column:
    return F.regexp_extract_all(attributes, F.lit(r"([A-Za-z_][A-Za-z0-9_-]*)="), F.lit(1))


def style_rules(sheets: DataFrame, key: str, text: str) -> DataFrame:
    """Class and id selectors (outside declaration blocks) and custom properties: key, seq, line, selector, rule_type, value."""
    lines = sheets.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "code"))
    lines = lines.withColumn("line", (F.col("line") + 1).cast("bigint"))
    outside = F.regexp_replace("code", r"\{[^}]*\}?", "{")
    selector = r"([.#][A-Za-z_-][A-Za-z0-9_-]*)"
    rules = lines.select(key, "line", F.posexplode(F.regexp_extract_all(outside, F.lit(selector), F.lit(1))).alias("seq", "selector"))
    rules = rules.select(key, "line", "seq", "selector", F.when(F.col("selector").startswith("."), "class").otherwise("id").alias("rule_type"), F.lit("").alias("value"))
    variable = r"(--[A-Za-z0-9_-]+)\s*:\s*([^;}]+)"
    pairs = F.arrays_zip(F.regexp_extract_all("code", F.lit(variable), F.lit(1)).alias("name"), F.regexp_extract_all("code", F.lit(variable), F.lit(2)).alias("value"))
    found = lines.select(key, "line", F.posexplode(pairs).alias("seq", "x"))
    return rules.unionByName(found.select(key, "line", "seq", F.col("x.name").alias("selector"), F.lit("variable").alias("rule_type"), F.trim("x.value").alias("value")))


def calls(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Direct calls ``name(`` in code text: key, seq, called."""
    names = F.regexp_extract_all(code, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)\("), F.lit(1))
    return rows.select(key, F.posexplode(names).alias("seq", "called")).withColumn("seq", F.col("seq").cast("bigint"))

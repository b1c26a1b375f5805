"""The joins by which graph edges are made and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def belongs_to(entities: DataFrame, files: DataFrame, entity_key: str, file_key: str) -> DataFrame:
    """Entities joined to an existing file; Spark broadcasts the files only if they are small."""
    return entities.join(files, entities[entity_key] == files[file_key])


def optional_match(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left")


def fallback_join(usages: DataFrame, first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """Matches in ``first`` by name; usages without any there match in ``second``."""
    missing = usages.join(first.select(name).distinct(), name, "left_anti")
    return usages.join(first, name).unionByName(missing.join(second, name), allowMissingColumns=True)


def coalesce_join(children: DataFrame, first: DataFrame, second: DataFrame, name: str, target: str) -> DataFrame:
    """Each child with all matches of ``name`` in ``first``, else those in ``second``; children without either go."""
    found = children.join(first.select(name, target), name).unionByName(
        children.join(first.select(name).distinct(), name, "left_anti").join(second.select(name, target), name)
    )
    return found


def resolve_local(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls (file, called, ...) with ``target``: the last definition of that name in the file, or null."""
    last = functions.groupBy("file", "name").agg(F.max("seq").alias("target_seq"))
    return calls.join(last.select("file", F.col("name").alias("called"), "target_seq"), ["file", "called"], "left").withColumn("target", F.when(F.col("target_seq").isNotNull(), F.col("called")))


def resolve_qualified(calls: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """``C.m`` calls whose C is a class of the file, with the first function named m there."""
    parts = F.split("called", r"\.", -1)
    two = calls.where(F.size(parts) == 2).withColumn("owner", parts[0]).withColumn("method", parts[1])
    known = two.join(classes.select("file", F.col("name").alias("owner")).distinct(), ["file", "owner"], "left_semi")
    first = functions.groupBy("file", "name").agg(F.min("seq").alias("target_seq")).withColumnRenamed("name", "method")
    return known.join(first, ["file", "method"])


def innermost(points: DataFrame, spans: DataFrame, group: list[str], at: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Every point, repeated ones too, with the columns of the innermost span of its group that contains it.

    Innermost is the latest start, then the earliest end; points in no span have nulls.
    The span depends on the group and the place only, so distinct places meet the spans of
    their group in ranges of places, and the points then join their place's span.  The
    ranges are so wide that a span lies in at most about ``1024``.
    """
    low, high = spans.agg(F.min(start), F.max(end)).first()
    width = max(1.0, (float(high) - float(low)) / 1024) if low is not None else 1.0
    part = lambda c: F.floor(c / width).cast("bigint")
    own = [c for c in spans.columns if c not in group]
    each = spans.where(F.col(start) <= F.col(end)).withColumn("_part", F.explode(F.sequence(part(F.col(start)), part(F.col(end)))))
    places = points.select(*group, at).where(F.col(at).isNotNull()).distinct().withColumn("_part", part(F.col(at)))
    inside = places.join(each, [*group, "_part"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    best = inside.groupBy(*group, at).agg(F.max_by(F.struct(*own), F.struct(F.col(start), -F.col(end))).alias("_span"))
    return points.join(best, [*group, at], "left").select(*points.columns, *[F.col("_span")[c].alias(c) for c in own])


def one_hop(edges: DataFrame, source: DataFrame, target: DataFrame, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
    """source -[edge]-> target by their keys: (edge column, vertex column)."""
    return edges.join(source, edges[src[0]] == source[src[1]]).join(target, edges[dst[0]] == target[dst[1]])

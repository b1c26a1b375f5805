"""Counts over stores and entity tables; one pass each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def store_totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.count("embedding").alias("embedded_chunks"), F.avg(F.length("content")).alias("average_content_length"))


def by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chunk_type")


def by_language(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("language").isNotNull()).groupBy("language").agg(F.count("*").alias("n"))


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, n) over entity tables, absent kinds as zero."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def exists(df: DataFrame) -> DataFrame:
    """One boolean: whether there is any row (reads no more than one)."""
    return df.limit(1).agg((F.count("*") > 0).alias("found"))


def rolling_mean(rows: DataFrame, order: str, value: str, width: int = 1000, groups: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Mean of the last ``width`` integer values up to each row of its group, truncated; ``order`` is a number without repeats.

    A running total is made in ``ranges`` of ``order`` whose own totals add up before, so no
    task orders a whole group; the row that left the window is met by its number.
    """
    groups = groups or []
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(rows.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<double>"), lambda b: b <= F.col(order)))
    dealt = rows.withColumn("_part", part)
    totals = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_rows"), F.count(value).alias("_n"), F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offset = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0")
    offsets = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), *[offset(c) for c in ("_rows", "_n", "_sum")])
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_part") == F.col("_p"))
    within = Window.partitionBy(*groups, "_part").orderBy(order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumns({"_row": F.row_number().over(within), "_count": F.count(value).over(upto), "_total": F.coalesce(F.sum(value).over(upto), F.lit(0))}).join(offsets, same)
    dealt = dealt.withColumns({"_row": F.col("_row") + F.col("_rows0"), "_count": F.col("_count") + F.col("_n0"), "_total": F.col("_total") + F.col("_sum0")}).select(*rows.columns, "_row", "_count", "_total")
    gone = dealt.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], (F.col("_row") + width).alias("_left"), F.col("_count").alias("_count0"), F.col("_total").alias("_total0"))
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_row") == F.col("_left"))
    n = F.col("_count") - F.coalesce("_count0", F.lit(0))
    mean = F.when(n > 0, F.floor((F.col("_total") - F.coalesce("_total0", F.lit(0))) / n))
    return dealt.join(gone, same, "left").select(*rows.columns, mean.alias("mean"))

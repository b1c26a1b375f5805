"""Shared Spark plumbing of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOCAL_SHARED = "/tmp/skarn-shared"
#: A key is hot from so many rows on, or from a share of one in ``HOT_KEYS`` on: there are fewer hot keys than that.
HOT_ROWS, HOT_KEYS = 256, 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local default only where none is configured and all tasks run on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or LOCAL_SHARED


def written(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The table is deleted when the driver's JVM ends.  ``drop_shuffles``: the shuffle files
    of the write go once the table stands, not when the driver next collects its garbage.
    """
    path = f"{shared_dir(df.sparkSession)}/skarn/{name}-{uuid.uuid4().hex}"
    conf, option = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(option)
    if drop_shuffles:
        conf.set(option, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(option, before)
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; else they stand until the driver's JVM ends."""
    for df in tables:
        context, files = df.sparkSession.sparkContext, df.inputFiles()
        if files:
            place = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(files[0])).getParent()
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def join_hot(rows: DataFrame, one: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``one``, which has one row for each value of ``key`` (no nulls), without a hot partition.

    The rows of a key that has more than ``max(HOT_ROWS, rows / HOT_KEYS)`` are dealt to
    as many parts as that needs, and its row of ``one`` goes to each of them.  Fewer than
    ``HOT_KEYS`` keys can be that hot: only those are broadcast.  ``rows`` must come
    straight from a written table, as the parts follow the places of its rows; ``total``
    is at least their number, where that is known.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    if total is None:
        total = counts.agg(F.sum("_n")).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = written(counts.where(F.col("_n") > least).select(key, F.ceil(F.col("_n") / least).cast("int").alias("_parts")), "hot-keys")
    dealt = rows.withColumn("_spot", F.monotonically_increasing_id()).join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_spot"), F.col("_parts")), F.lit(0))).drop("_spot", "_parts")
    each = one.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_parts").cast("bigint") - 1, F.lit(0))))).drop("_parts")
    return dealt.join(each, [key, "_part"], how).drop("_part")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hands texts to Python ``rows`` at a time from now on in this session, unless it asks for fewer already.

    The default of 10,000 whole texts takes tens of megabytes in the JVM and again in the
    worker, for each task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column: str, buckets: int):
    """crc32 of the id as text, modulo ``buckets``: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def bounded_ids(labels: DataFrame, id_col: str, class_col: str, per_class: int) -> DataFrame:
    """About ``per_class`` labelled ids of each class (at most 1.5 times it), chosen by hash.

    The result has at most ``1.5 * per_class * classes`` rows whatever the size of
    ``labels``, so it may be broadcast.  Rows with a null id or class are left out.
    A repeated id keeps its largest class.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull()).groupBy(id_col).agg(F.max(class_col).alias(class_col))
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, per_class / n)
        keep = keep | ((F.col(class_col) == F.lit(value)) & (F.pmod(F.xxhash64(F.lit("pick"), id_col), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))))
    return rows.where(keep)


def per_group(df: DataFrame, key: str, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``function`` on the Arrow table of every group of ``key`` (groups must be of bounded size)."""
    return df.groupBy(key).applyInArrow(function, schema)


def columns_of(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Just the needed columns, cast to the stated types; other columns and their names don't matter."""
    return df.select([F.col(f"`{name}`").cast(kind).alias(name) for name, kind in needed.items()])


def labelled_sample(docs: DataFrame, labels: DataFrame, class_col: str, fold, per_class: int, name: str) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of labelled rows that ``fold`` (a condition on doc_id) lets in.

    The chosen ids are a hash sample of bounded size, so they are broadcast and the
    texts never shuffle; the sample is written to the shared folder and read from there.
    """
    ids = bounded_ids(columns_of(labels, {"doc_id": "bigint", class_col: "string"}).where(fold), "doc_id", class_col, per_class)
    ids = ids.select("doc_id", F.col(class_col).alias("label"))
    rows = columns_of(docs, {"doc_id": "bigint", "text": "string"})
    return written(rows.join(F.broadcast(ids), "doc_id"), name)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each lengthened until ``df`` has no such column: for private columns beside its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quantiles(rows: DataFrame, column: str, ranges: int) -> list[int]:
    """At most ``ranges - 1`` distinct bounds that cut a bigint column into ranges of about equal counts."""
    if ranges < 2:
        return []
    known = rows.where(F.col(column).isNotNull()).approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    return sorted({int(b) for b in known})


def above(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the value, by binary search over a literal array."""
    if not bounds:
        return F.lit(0)
    low, high = F.lit(0), F.lit(len(bounds))
    start = F.struct(low.alias("low"), high.alias("high"))
    array = F.array(*[F.lit(b).cast("bigint") for b in bounds])

    def step(s: Column, _: Column) -> Column:
        half = F.floor((s["low"] + s["high"]) / 2).cast("int")
        up = F.get(array, half) <= value
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(up, half + 1).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(half).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, step)["low"]

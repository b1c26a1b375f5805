"""Jump consistent hashing of stable keys onto shards.

The jump sequence of a key is its 64-bit linear congruential stream: from shard
``b`` the key jumps to ``floor((b + 1) * 2**31 / ((state >> 33) + 1))`` until that
is not below the shard count.  Nothing but the key and the count decides, and one
more shard takes rows only into itself.  All of it is DataFrame expressions: the
64-bit product is built from 32- and 16-bit limbs, so no step overflows under ANSI
arithmetic.

Defined results: a null key counts as key 0; a null text has size 1 and the crc of
the empty text; repeated rows share a shard and get slots of their own; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import above, columns_of, quantiles

MULTIPLIER = 2862933555777941757
ROWS_PER_BUCKET = 50_000
MOST_BUCKETS = 8192
_AH, _A1, _A0 = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF
_M16, _M32 = 0xFFFF, 0xFFFFFFFF


def _step(s: Column, shards: int) -> Column:
    """One jump: the state times the multiplier plus one, modulo 2**64, and the next target."""
    hi, lo = s["hi"], s["lo"]
    low, mid = lo * F.lit(_A0) + F.lit(1), lo * F.lit(_A1)
    total = low + F.shiftleft(mid.bitwiseAND(F.lit(_M16)), 16)
    cross = hi * F.lit(_A0) + F.shiftleft((hi * F.lit(_A1)).bitwiseAND(F.lit(_M16)), 16) + (lo * F.lit(_AH)).bitwiseAND(F.lit(_M32))
    high = (F.shiftright(total, 32) + F.shiftright(mid, 16) + cross).bitwiseAND(F.lit(_M32))
    target = F.floor((s["j"] + 1).cast("double") * F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
    moved = F.struct(high.alias("hi"), total.bitwiseAND(F.lit(_M32)).alias("lo"), s["j"].alias("b"), target.alias("j"))
    return F.when(s["j"] < F.lit(shards), moved).otherwise(s)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a bigint key among ``shards``.

    A key makes about ``ln(shards)`` jumps and never more than ``shards``; the fold runs
    64 steps, and only keys that are still jumping then go on for the rest.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_M32)).alias("lo"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j")
    )
    fold = lambda first, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), first, lambda s, _: _step(s, shards))
    done = fold(start, min(shards, 64))
    if shards > 64:
        done = F.when(done["j"] < F.lit(shards), fold(done, shards)).otherwise(done)
    return done["b"].cast("int")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Slots are gapless within a shard and follow the ids (nulls first).  A shard's rows are
    numbered in ranges of ids, cut at quantiles so that a shard has about
    ``rows_per_bucket`` rows of a range (more in tables that would need over
    ``MOST_BUCKETS`` ranges), whose offsets are a running sum of their counts, so no task
    holds a whole shard.  The text stays at the scan; only its size and crc travel.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = columns_of(docs, {id_col: "bigint"}).toDF("doc_id")
    bounds = quantiles(keys, "doc_id", min(MOST_BUCKETS, max(1, -(-keys.count() // (rows_per_bucket * shards)))))
    bucket = F.coalesce(above(F.col("doc_id"), bounds), F.lit(0)).cast("int")
    rows = columns_of(docs, {id_col: "bigint", text_col: "string"}).toDF("doc_id", "text").select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
        bucket.alias("bucket"),
    )
    counts = keys.select(jump_shard(F.col("doc_id"), shards).alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard")
    )

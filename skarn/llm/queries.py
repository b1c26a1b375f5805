"""The operators applied to their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .oracles import REPEATS, SECRETS, SHARDS


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "words")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import fit, rated

    docs = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")
    return rated(docs, fit(docs, labelled)[0])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spanprint import fingerprinted

    return fingerprinted(table(spark, sf_dir, "documents"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import digest, repeated

    return digest(repeated(table(spark, sf_dir, "documents")))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan_history

    return digest(scan_history(table(spark, sf_dir, "documents"))[1])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_digits, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import repair

    return repair(table(spark, sf_dir, "conversations"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 8)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.array_join("items", ",").alias("items"), "share")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_quality, op4_fingerprints, op5_suffix_array, op6_secret_scans, op7_simhash, op8_chat, op9_sharding, op10_decontamination)}

ORACLE: dict[str, str] = {"op5_suffix_array": REPEATS, "op6_secret_scans": SECRETS, "op9_sharding": SHARDS}

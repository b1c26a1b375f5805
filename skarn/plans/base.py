"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder, read lazily by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


_PARSED: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def parsed_once(t: Tables, name: str, files: Callable[[Tables], DataFrame]) -> DataFrame:
    """The parsed rows of a tree, kept for the queries of a session that read the same folder.

    One folder's rows are kept for each tree; they are recomputed where an executor is lost.
    """
    from skarn.operators import extract

    key, place = (t.spark.sparkContext.applicationId, name), t.folder
    if _PARSED.get(key, ("", None))[0] != place:
        if key in _PARSED:
            _PARSED[key][1].unpersist()
        for old in [k for k in _PARSED if k[0] != key[0]]:
            del _PARSED[old]  # of a session that has ended
        _PARSED[key] = (place, extract.parsed(files(t)).persist(StorageLevel.MEMORY_AND_DISK))
    return _PARSED[key][1]


def query(sql: str | None = None):
    """Registers a function of ``Tables`` under its name, with its SQL where SQL can say the same."""

    def add(function):
        QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add

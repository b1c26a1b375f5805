"""Versioned Parquet tables: every write is a new folder, and readers take the last complete one.

A version counts once Spark's committer has put its ``_SUCCESS`` mark, so a failed or
running write is never read.  Paths may be on any file system that Spark reads.

A table with a ``key`` is kept in buckets of it: replacing some keys writes their buckets
only, and the version's ``_buckets`` file, written last, says which folder holds each.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from skarn.operators import merge as M


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _files(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, place: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        folder, files = self._files()
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        mark = "_buckets" if self.key else "_SUCCESS"
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and files.exists(self._at(f"{n}/{mark}")))

    def written(self) -> int | None:
        """When the last version was completed, in seconds."""
        known = self.versions()
        mark = "_buckets" if self.key else "_SUCCESS"
        return self._files()[1].getFileStatus(self._at(f"v-{known[-1]}/{mark}")).getModificationTime() // 1000 if known else None

    def _places(self, version: int) -> dict[int, int]:
        """The version whose folder holds each bucket; empty buckets are absent."""
        stream = self._files()[1].open(self._at(f"v-{version}/_buckets"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A version's rows, the last one's without a number; ``only`` takes some buckets."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        places = [f"{self.path}/v-{version}"]
        if self.key:
            places = [f"{self.path}/v-{v}/bucket={b}" for b, v in self._places(version).items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """Writes a version; one that is complete already is left as it is (a repeated batch)."""
        known = self.versions()
        version = (known[-1] + 1 if known else 0) if version is None else version
        if version not in known:
            rows = rows.select(*self.schema.names)
            if self.key:
                self._write_buckets(rows, version, {})
            else:
                rows.write.mode("overwrite").parquet(f"{self.path}/v-{version}")
        return version

    def _write_buckets(self, rows: DataFrame, version: int, kept: dict[int, int]) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v-{version}")
        _, files = self._files()
        names = [s.getPath().getName() for s in files.listStatus(self._at(f"v-{version}"))]
        places = kept | {int(n.split("=")[1]): version for n in names if n.startswith("bucket=")}
        out = files.create(self._at(f"v-{version}/_buckets"), True)
        out.write(bytearray(json.dumps(places), "utf-8"))
        out.close()

    def merge(self, rows: DataFrame, key: list[str], order: list[str] | None = None, version: int | None = None) -> int:
        merged = M.merge(self.read(), rows.select(*self.schema.names), key, order)
        return self.write(merged.drop("change"), version)

    def replace_for(self, rows: DataFrame, key: list[str], gone: DataFrame) -> int:
        """Deletes the rows of ``gone``'s keys and adds ``rows``: a file's rows are rebuilt as a whole.

        Where the table's own key is asked for, only the buckets of those keys are read and written.
        """
        rows = rows.select(*self.schema.names)
        known = self.versions()
        if key != self.key or not known:
            return self.write(M.delete_by(self.read(), gone, key).unionByName(rows))
        touched = [r[0] for r in gone.select(*key).unionByName(rows.select(*key)).select(self._bucket()).distinct().collect()]  # at most ``buckets``
        places = {b: v for b, v in self._places(known[-1]).items() if b not in touched}
        self._write_buckets(M.delete_by(self.read(known[-1], touched), gone, key).unionByName(rows), known[-1] + 1, places)
        return known[-1] + 1

    def vacuum(self, keep: int = 2) -> list[int]:
        """Removes all but the last ``keep`` complete versions; of older ones the buckets that these still use stay."""
        _, files = self._files()
        known = self.versions()
        old, used = known[:-keep], set()
        for version in known[-keep:] if self.key else []:
            used |= {(v, b) for b, v in self._places(version).items()}
        for version in old:
            if not any(v == version for v, _ in used):
                files.delete(self._at(f"v-{version}"), True)
                continue
            # Its list goes first: what is left is no version any more.
            files.delete(self._at(f"v-{version}/_buckets"), False)
            for name in [s.getPath().getName() for s in files.listStatus(self._at(f"v-{version}"))]:
                if name.startswith("bucket=") and (version, int(name.split("=")[1])) not in used:
                    files.delete(self._at(f"v-{version}/{name}"), True)
        return old

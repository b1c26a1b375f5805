"""File scans, the state file and configuration.

Spark's own file index lists everything and hides names that start with ``_`` or ``.``;
the scan here prunes directories while listing, on the driver (names only), and reads
the bytes on the executors.  ``binary_files`` is the form for stores that only Spark reads.
"""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.functions import exprs as X
from skarn.streaming.monitor import STATE

FILES_PER_TASK = 200


def list_files(root: str, skip: tuple[str, ...] = X.BATCH_SKIP, extensions: tuple[str, ...] = X.EXTENSIONS) -> list[tuple[str, int, int]]:
    """(relative path, modified seconds, size) in lexical order, without entering skipped directories.

    A folder that can't be listed is an error: its files must not pass for removed ones.
    """

    def fail(error: OSError):
        raise error

    found = []
    for folder, names, files in os.walk(root, onerror=fail):
        names[:] = sorted(n for n in names if n not in skip)
        for name in sorted(files):
            if os.path.splitext(name)[1] in extensions:
                path = os.path.join(folder, name)
                stat = os.stat(path)
                found.append((os.path.relpath(path, root).replace(os.sep, "/"), int(stat.st_mtime), stat.st_size))
    return sorted(found)


def scan(spark: SparkSession, root: str, skip: tuple[str, ...] = X.BATCH_SKIP, only: DataFrame | None = None) -> DataFrame:
    """(path, language, modified, hash, content, error) of a source tree that executors can open.

    ``only`` (path) limits the reading; an unreadable file becomes an error row.
    """
    rows = list_files(root, skip)
    listing = spark.createDataFrame(rows, "path string, modified bigint, size bigint")
    if only is not None:
        listing = listing.join(only.select("path"), "path", "left_semi")
    listing = listing.repartition(max(1, -(-len(rows) // FILES_PER_TASK)))

    def read(batches):
        for batch in batches:
            content, errors = [], []
            for path in batch.column("path").to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content.append(f.read())
                        errors.append(None)
                except OSError as e:
                    content.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("modified"), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["path", "modified", "raw", "error"])

    return _described(listing.mapInArrow(read, "path string, modified bigint, raw binary, error string"))


def binary_files(spark: SparkSession, root: str, skip: tuple[str, ...] = X.BATCH_SKIP) -> DataFrame:
    """The same rows through Spark's reader, for any store (it lists neither hidden names nor empty files)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace("path", "^[a-zA-Z0-9]+:/*(?=/)", "")
    top = os.path.abspath(root) if "://" not in root else root.split("://", 1)[1]
    rows = rows.select(X.relative(plain, top).alias("path"), F.unix_timestamp("modificationTime").alias("modified"), F.col("content").alias("raw"), F.lit(None).cast("string").alias("error"))
    return _described(rows.where(X.supported(F.col("path")) & ~X.pruned(F.col("path"), skip)))


def file_stream(spark: SparkSession, root: str, skip: tuple[str, ...] = X.MONITOR_SKIP, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, language, modified, hash, content, error): each new file once.

    Spark's file source reports a path only once; changes and removals of known paths are
    found by comparing listings (``monitor.classify``) or by ingesting again.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(root)
    plain = F.regexp_replace("path", "^[a-zA-Z0-9]+:/*(?=/)", "")
    top = os.path.abspath(root) if "://" not in root else root.split("://", 1)[1]
    rows = stream.select(X.relative(plain, top).alias("path"), F.unix_timestamp("modificationTime").alias("modified"), F.col("content").alias("raw"), F.lit(None).cast("string").alias("error"))
    return _described(rows.where(X.supported(F.col("path")) & ~X.pruned(F.col("path"), skip)))


def _described(rows: DataFrame) -> DataFrame:
    return rows.select("path", X.language(F.col("path")).alias("language"), "modified", F.md5("raw").alias("hash"), F.decode("raw", "UTF-8").alias("content"), "error")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state file, a JSON list of {path, hash, modified}; no file is an empty state."""
    if not os.path.exists(path):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).option("multiLine", True).json(path)


def write_state(state: DataFrame, path: str) -> None:
    """Writes the state as one JSON list (an interchange form; larger states belong in a VersionedTable)."""
    temporary = f"{path}.tmp"
    with open(temporary, "w") as f:
        f.write("[")
        for i, row in enumerate(state.orderBy("path").toLocalIterator()):
            f.write((",\n " if i else "\n ") + json.dumps(row.asDict()))
        f.write("\n]\n")
    os.replace(temporary, path)


def _git(repository: str, *arguments: str) -> list[str]:
    done = subprocess.run(["git", "-C", repository, *arguments], capture_output=True, text=True, check=True, timeout=60)
    return done.stdout.splitlines()


def git_status_lines(spark: SparkSession, repository: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _git(repository, "status", "--porcelain")], "line string")


class GitRange:
    """Changes between the last seen commit and HEAD, and then the working tree's."""

    def __init__(self, repository: str):
        self.repository, self.seen = repository, ""

    def head(self) -> str:
        return _git(self.repository, "rev-parse", "HEAD")[0].strip()

    def changes(self, spark: SparkSession, extended: bool = True) -> DataFrame:
        """(path, status): of the commits since the last call if HEAD moved, else of the working tree."""
        from skarn.streaming.monitor import git_diff, git_status

        now, before = self.head(), self.seen
        self.seen = now
        if before and before != now:
            lines = _git(self.repository, "diff", "--name-status", before, now)
            return git_diff(spark.createDataFrame([(x,) for x in lines], "line string"), extended)
        return git_status(git_status_lines(spark, self.repository), extended)


def _env(name: str, default: str) -> str:
    return os.environ.get(name) or default


@dataclass(frozen=True)
class Config:
    """Settings from the environment, or a ``.env`` file, with defaults; nothing secret has one."""

    store: str = field(default_factory=lambda: _env("GRAPH_STORE_PATH", "./graph-store"))
    state: str = field(default_factory=lambda: _env("STATE_FILE", ".parse_state.json"))
    provider: str = field(default_factory=lambda: _env("EMBEDDING_PROVIDER", "hashing"))
    model: str = field(default_factory=lambda: _env("EMBEDDING_MODEL", "text-embedding-3-small"))
    dimension: int = field(default_factory=lambda: int(_env("EMBEDDING_DIMENSION", "0")))
    api_key: str = field(default_factory=lambda: _env("EMBEDDING_API_KEY", ""), repr=False)

    @classmethod
    def load(cls, env_file: str = ".env") -> Config:
        """Values of the file count where the environment has none."""
        if os.path.exists(env_file):
            with open(env_file) as f:
                for line in f:
                    name, mark, value = line.strip().partition("=")
                    if mark and not name.startswith("#"):
                        os.environ.setdefault(name.strip(), value.strip().strip("\"'"))
        return cls()

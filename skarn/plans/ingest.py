"""From a source tree to graph, chunk and state tables, whole or incremental."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.functions.exprs import BATCH_SKIP
from skarn.functions.embed import HashingProvider, Provider, embedded
from skarn.operators import chunks as C, diff as D, extract, search, stats
from skarn.operators.graph import CodeGraph
from skarn.sources.files import list_files, scan
from skarn.sources.store import VersionedTable
from skarn.streaming import monitor

CHUNK_SCHEMA = "id string, chunk_type string, name string, file_path string, content string, start_line int, end_line int, language string, metadata string, embedding array<float>"
FILE_FIELD = {"function_calls": "caller_file", "type_usages": "using_file", "references": "source_file"}
#: Files changed so shortly before the last state was written are read even if their time is the known one.
RECENT_SECONDS = 60


@dataclass
class Report:
    parsed: int
    removed: int
    errors: int


class CodeBase:
    """The stored tables of one source tree, and the operations on them."""

    def __init__(self, spark: SparkSession, root: str, store: str, provider: Provider | None = None, skip: tuple[str, ...] = BATCH_SKIP):
        self.spark, self.root, self.provider, self.skip = spark, root, provider or HashingProvider(), skip
        table = lambda name, schema, key=None: VersionedTable(spark, f"{store}/{name}", schema, key)
        self.files = table("files", "path string, language string, content string", ["path"])
        self.state = table("state", monitor.STATE)
        self.chunks = table("chunks", CHUNK_SCHEMA, ["file_path"])
        self.changes = table("changes", "file string, entity_kind string, change string, key string")
        self.kinds = {kind: table(kind, schema, [FILE_FIELD.get(kind, "file")]) for kind, schema in extract.FIELDS.items()}

    def ingest(self, force: bool = False, only: DataFrame | None = None, removals_only: bool = False) -> Report:
        """Parses what is new or changed, drops what is gone, and rebuilds those files' rows in every table.

        Names and times are compared first; only files that they make suspect are read and
        hashed.  ``only`` (path) leaves all other files as they are; ``removals_only`` parses nothing.
        """
        listing = self.spark.createDataFrame(list_files(self.root, self.skip), "path string, modified bigint, size bigint")
        state = self.state.read()
        known = state.select("path").unionByName(self.files.read().select("path")).distinct()
        if only is not None:
            known = known.join(only.select("path"), "path", "left_semi")
        gone = known.join(listing, "path", "left_anti")
        suspects = listing if only is None else listing.join(only.select("path"), "path", "left_semi")
        if removals_only:
            suspects = suspects.limit(0)
        elif not force:
            times = state.select("path", F.col("modified").alias("_known"))
            recent = F.col("modified") >= (self.state.written() or 0) - RECENT_SECONDS
            suspects = suspects.join(times, "path", "left").where(F.col("_known").isNull() | (F.col("_known") != F.col("modified")) | recent)
        found = scan(self.spark, self.root, self.skip, suspects.select("path"))
        changed = found if force else monitor.changed_files(found.select("path", "hash", "modified"), state).select("path").join(found, "path")
        held = [found.persist()]
        try:
            return self._apply(state, found, changed, gone, held)
        finally:
            for df in held:
                df.unpersist()

    def _apply(self, state: DataFrame, found: DataFrame, changed: DataFrame, gone: DataFrame, held: list[DataFrame]) -> Report:
        """Rebuilds the rows of ``changed`` and drops those of ``gone``; frames kept meanwhile go to ``held``."""
        changed, gone = changed.persist(), gone.persist()
        # What can't be read keeps its rows, and is tried again: it has no place in the state.
        read = changed.where("error is null")
        touched = read.select("path").unionByName(gone)
        rows = extract.parsed(read).persist()
        held += [changed, gone, rows]
        report = Report(changed.count(), gone.count(), rows.where("error is not null").count() + changed.where("error is not null").count())
        if not (report.parsed or report.removed):
            return report
        new = extract.entity_tables(rows)
        old = {k: t.read().join(touched.select(F.col("path").alias(FILE_FIELD.get(k, "file"))), FILE_FIELD.get(k, "file"), "left_semi") for k, t in self.kinds.items()}
        self.changes.write(D.diff_all(old, new))
        for kind, table in self.kinds.items():
            field = FILE_FIELD.get(kind, "file")
            table.replace_for(new[kind], [field], touched.withColumnRenamed("path", field))
        self.files.replace_for(read.select("path", "language", "content"), ["path"], touched)
        made = embedded(C.newest(C.all_chunks(new, read.select("path", "language", "content"))), self.provider)
        self.chunks.replace_for(made, ["file_path"], touched.withColumnRenamed("path", "file_path"))
        rest = state.join(gone.unionByName(found.select("path")), "path", "left_anti")
        self.state.write(rest.unionByName(found.where("error is null").select("path", "hash", "modified")))
        return report

    def tables(self) -> dict[str, DataFrame]:
        return {k: t.read() for k, t in self.kinds.items()}

    def graph(self) -> CodeGraph:
        return CodeGraph(self.tables(), self.files.read())

    def report(self) -> DataFrame:
        """(kind, n) for every kind, and the chunk store's total."""
        return stats.entity_counts(self.tables() | {"files": self.files.read(), "chunks": self.chunks.read()})

    def search(self, text: str, limit: int = 10, keyword: str | None = None, filters: dict | None = None) -> DataFrame:
        chunks = self.chunks.read()
        if keyword is None:
            return search.search_text(chunks, self.provider, text, limit, filters)
        return search.hybrid(chunks, self.provider.embed([text])[0], keyword, limit, filters)

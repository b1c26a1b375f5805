"""Change detection, coalescing, retries and metrics, for batches and micro-batches alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from skarn.operators.merge import delete_by, latest, merge
from skarn.sources.store import VersionedTable

STATE = "path string, hash string, modified bigint"
MOST_RETRIES = 3


def changed_files(current: DataFrame, state: DataFrame, hash_only: bool = False) -> DataFrame:
    """The rows of ``current`` (path, hash, modified) that the state doesn't know or knows otherwise."""
    known = state.select("path", F.col("hash").alias("_hash"), F.col("modified").alias("_modified"))
    differs = F.col("_hash").isNull() | ~F.col("hash").eqNullSafe(F.col("_hash"))
    if not hash_only:
        differs = differs | ~F.col("modified").eqNullSafe(F.col("_modified"))
    return current.join(known, "path", "left").where(differs).select(*current.columns)


def update_state(state: DataFrame, seen: DataFrame) -> DataFrame:
    return merge(state, seen.select(*state.columns), ["path"]).drop("change")


def remove_state(state: DataFrame, gone: DataFrame) -> DataFrame:
    return delete_by(state, gone, ["path"])


def classify(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, event) between two listings (path, is_dir, hash): create_dir, create, modify, remove; equal ones don't show."""
    a, b = before.withColumn("_in", F.lit(True)).alias("a"), after.withColumn("_in", F.lit(True)).alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
    event = (
        F.when(F.col("b._in").isNull(), "remove")
        .when(F.col("a._in").isNull() & F.col("b.is_dir"), "create_dir")
        .when(F.col("a._in").isNull(), "create")
        .when(~F.col("b.is_dir") & ~F.col("a.hash").eqNullSafe(F.col("b.hash")), "modify")
    )
    return both.select(F.coalesce("a.path", "b.path").alias("path"), event.alias("event")).where(F.col("event").isNotNull())


def raw_event(code: Column, known: Column) -> Column:
    """The kind of a raw file event: a rename of a path that still exists is a modification."""
    return F.when(code == "CREATE_DIR", "create_dir").when(code == "CREATE", "create").when(code == "WRITE", "modify").when(code == "REMOVE", "remove").when((code == "RENAME") & known, "modify").when(code == "RENAME", "rename")


def coalesce_changes(changes: DataFrame, order: list[str]) -> DataFrame:
    """The latest pending change of each path."""
    return latest(changes, ["path"], order)


def flush_assignment(changes: DataFrame, size: int, seconds: int, order: list[str], slices: int = 64) -> DataFrame:
    """``tick`` and ``flush`` of each change: a flush for every ``size`` pending paths of a tick, and one at its end.

    Changes of a path within a tick coalesce to the last; a tick is ``seconds`` of the ``ts``
    column, by which ``order`` begins.  A tick is numbered in ``slices`` of its time, whose
    counts add up before, so no task orders a whole tick.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = changes.withColumn("tick", F.floor(micros / (seconds * 1_000_000)))
    rows = latest(rows, ["tick", "path"], order)
    rows = rows.withColumn("_slice", F.floor(F.pmod(micros, F.lit(seconds * 1_000_000)) * slices / (seconds * 1_000_000)))
    before = Window.partitionBy("tick").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # at most ``slices`` rows
    counts = rows.groupBy("tick", "_slice").agg(F.count("*").alias("_n")).select(F.col("tick").alias("_t"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("tick", "_slice").orderBy(*order)))
    rows = rows.join(counts, F.col("tick").eqNullSafe(F.col("_t")) & F.col("_slice").eqNullSafe(F.col("_s")))
    return rows.withColumn("flush", F.floor((F.col("_place") + F.col("_before") - 1) / size)).drop("_slice", "_place", "_t", "_s", "_before")


def retry_or_drop(failed: DataFrame, pending: DataFrame) -> DataFrame:
    """Failed changes (path, ts, retries) go back with one retry more, the third failure drops; newer pending changes stay.

    ``outcome`` is requeued, dropped or superseded.
    """
    newer = pending.groupBy("path").agg(F.max("ts").alias("_newest"))
    rows = failed.join(newer, "path", "left").withColumn("retries", F.col("retries") + 1)
    outcome = F.when(F.col("retries") >= MOST_RETRIES, "dropped").when(F.col("_newest") > F.col("ts"), "superseded").otherwise("requeued")
    return rows.withColumn("outcome", outcome).drop("_newest")


def batch_metrics(log: DataFrame) -> DataFrame:
    """One row over a batch log (size, millis, failed)."""
    return log.agg(
        F.count("*").alias("total_batches"), F.sum("size").alias("total_changes"), (F.sum("size") / F.count("*")).alias("average_batch_size"),
        F.sum("millis").alias("processing_time"), F.sum(F.col("failed").cast("bigint")).alias("errors"),
    )


def metrics_snapshot(processed: DataFrame, files: DataFrame) -> DataFrame:
    """files_monitored, files_processed, changes_detected, errors, last_change and the mean duration of the last 1000.

    ``processed``: (seq, at, millis, changed, failed).  The last 1000 are a top-k, not a sort of all.
    """
    totals = processed.agg(F.count("*").alias("files_processed"), F.sum(F.col("changed").cast("bigint")).alias("changes_detected"), F.sum(F.col("failed").cast("bigint")).alias("errors"), F.max(F.when(F.col("changed"), F.col("at"))).alias("last_change"))
    recent = processed.orderBy(F.desc("seq")).limit(1000).agg(F.floor(F.sum("millis") / F.count("*")).alias("average_processing_time"))
    monitored = files.agg(F.count("*").alias("files_monitored"))
    return monitored.crossJoin(totals).crossJoin(recent)  # one row each


def git_status(lines: DataFrame, extended: bool = False) -> DataFrame:
    """(path, status) from ``git status --porcelain`` lines: A before M before D; others go.

    ``extended`` also takes untracked files as A, and a rename as D of the old and A of the new path.
    """
    mark, path = F.substring("line", 1, 2), F.trim(F.substring("line", 4, 1 << 20))
    status = F.when(mark.contains("A"), "A").when(mark.contains("M"), "M").when(mark.contains("D"), "D")
    if not extended:
        return lines.select(path.alias("path"), status.alias("status")).where(F.col("status").isNotNull())
    ends = F.split(path, " -> ", -1)
    renamed = F.array(F.struct(ends[0].alias("path"), F.lit("D").alias("status")), F.struct(F.get(ends, F.lit(1)).alias("path"), F.lit("A").alias("status")))
    plain = F.array(F.struct(path.alias("path"), F.when(mark == "??", "A").otherwise(status).alias("status")))
    rows = lines.select(F.explode(F.when(mark.contains("R"), renamed).otherwise(plain)).alias("x")).select("x.*")
    return rows.where(F.col("status").isNotNull())


def git_diff(lines: DataFrame, extended: bool = False) -> DataFrame:
    """(path, status) from ``git diff --name-status`` lines; ``extended`` splits by tab and turns renames into D and A."""
    if not extended:
        parts = F.split(F.trim("line"), r"\s+")
        return lines.where(F.size(parts) >= 2).select(parts[1].alias("path"), parts[0].alias("status"))
    parts = F.split("line", "\t", -1)
    renamed = F.array(F.struct(F.get(parts, F.lit(1)).alias("path"), F.lit("D").alias("status")), F.struct(F.get(parts, F.lit(2)).alias("path"), F.lit("A").alias("status")))
    plain = F.array(F.struct(F.get(parts, F.lit(1)).alias("path"), F.substring(parts[0], 1, 1).alias("status")))
    return lines.where(F.size(parts) >= 2).select(F.explode(F.when(parts[0].startswith("R"), renamed).otherwise(plain)).alias("x")).select("x.*")


class Pending:
    """Changed paths of the driver that wait for a flush: the newest change of a path counts.

    A flush is due at ``size`` paths or ``seconds`` after the last one; a failed path comes
    back unless a newer change waits, and goes at its third failure.
    """

    def __init__(self, size: int = 1000, seconds: float = 5.0):
        self.size, self.seconds, self.flushed = size, seconds, float("-inf")
        self.paths: dict[str, int] = {}

    def add(self, path: str) -> None:
        self.paths[path] = 0

    def due(self, now: float) -> bool:
        return len(self.paths) >= self.size or bool(self.paths) and now - self.flushed >= self.seconds

    def take(self, now: float) -> dict[str, int]:
        taken, self.paths, self.flushed = self.paths, {}, now
        return taken

    def failed(self, taken: dict[str, int]) -> list[str]:
        """Puts the paths back; those that are dropped instead."""
        dropped = [p for p, n in taken.items() if n + 1 >= MOST_RETRIES]
        for path, n in taken.items():
            if n + 1 < MOST_RETRIES:
                self.paths.setdefault(path, n + 1)
        return dropped


class Gate:
    """Pause drops create and modify changes; removals and what is queued go on."""

    def __init__(self):
        self.paused = False

    def admit(self, changes: DataFrame) -> DataFrame:
        return changes.where("change_type = 'remove'") if self.paused else changes


def follow(stream: DataFrame, target: VersionedTable, key: list[str], order: list[str], checkpoint: str, gate: Gate | None = None) -> StreamingQuery:
    """Coalesces each micro-batch and merges it into a versioned table; a batch that is repeated writes nothing new."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = gate.admit(batch) if gate else batch
        newest = latest(rows, key, order)
        # A change of an earlier batch may be newer than this one's: the order decides over both.
        both = target.read().join(newest.select(*key), key, "left_semi").unionByName(newest.select(*target.schema.names))
        target.merge(latest(both, key, order), key, version=batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detect(stream: DataFrame, state: VersionedTable, out: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Files (path, hash, modified) of a stream against the kept state: changes go to ``out``, the state follows."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        now = latest(batch, ["path"], ["modified", "hash"])
        known = state.read(max((v for v in state.versions() if v <= batch_id), default=None))
        out.write(out.read(max((v for v in out.versions() if v < batch_id), default=None)).unionByName(changed_files(now, known)), batch_id)
        state.merge(now, ["path"], version=batch_id + 1)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Change, diff, batch and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skarn.operators import diff as D, merge as M
from skarn.sources.store import VersionedTable
from skarn.streaming import monitor

from .base import query

STATE_SQL = """state AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE md5(text) END AS hash, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE n_chars END AS modified FROM documents WHERE doc_id % 3 <> 0),
now AS (SELECT 'd' || doc_id AS path, md5(text) AS hash, n_chars AS modified FROM documents)"""


def _files(t):
    rows = t.documents.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"), F.col("n_chars").alias("modified"))
    return rows.select("path", "hash", "modified"), rows.where("doc_id % 3 <> 0").select(
        "path", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("hash")).alias("hash"), F.when(F.col("doc_id") % 7 == 0, 1).otherwise(F.col("modified")).alias("modified")
    )


@query(f"WITH {STATE_SQL} SELECT now.path, now.hash, now.modified FROM now LEFT JOIN state USING (path) WHERE state.hash IS NULL OR state.hash <> now.hash OR state.modified <> now.modified")
def changed_files(t):
    return monitor.changed_files(*_files(t))


@query(f"WITH {STATE_SQL} SELECT path, coalesce(now.hash, state.hash) AS hash, coalesce(now.modified, state.modified) AS modified FROM state FULL JOIN now USING (path)")
def state_update(t):
    now, state = _files(t)
    return monitor.update_state(state, now)


@query(f"WITH {STATE_SQL} SELECT * FROM state WHERE hash <> 'stale'")
def state_remove(t):
    _, state = _files(t)
    return monitor.remove_state(state, state.where("hash = 'stale'").select("path"))


PART_SQL = """old AS (SELECT p_brand AS file, p_name || p_partkey AS name, p_size AS start_line, p_size + 5 AS end_line, p_type AS signature, p_partkey AS k FROM part WHERE p_partkey % 4 <> 0),
new AS (SELECT p_brand AS file, p_name || p_partkey AS name, p_size + (p_partkey % 3 = 0)::INT AS start_line, p_size + 5 AS end_line, CASE WHEN p_partkey % 7 = 0 THEN 'new' ELSE p_type END AS signature, p_partkey AS k FROM part WHERE p_partkey % 5 <> 0)"""


def _versions(t):
    k = F.col("p_partkey")
    rows = t.part.select(F.col("p_brand").alias("file"), F.concat("p_name", k.cast("string")).alias("name"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"), F.col("p_type").alias("signature"), k.alias("k"))
    new = rows.where("k % 5 <> 0").withColumn("start_line", F.col("start_line") + (F.col("k") % 3 == 0).cast("int")).withColumn("signature", F.when(F.col("k") % 7 == 0, "new").otherwise(F.col("signature")))
    return rows.where("k % 4 <> 0").drop("k"), new.drop("k")


@query(f"""WITH {PART_SQL} SELECT coalesce(n.file, o.file) AS file, coalesce(n.name, o.name) AS name, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'modified' END AS change,
o.start_line AS old_start, n.start_line AS new_start FROM old o FULL JOIN new n ON o.file = n.file AND o.name = n.name
WHERE o.k IS NULL OR n.k IS NULL OR o.start_line <> n.start_line OR o.signature <> n.signature""")
def entity_diff_functions(t):
    found = D.diff(*_versions(t), ["file", "name"], ["start_line", "end_line", "signature"])
    return found.select("file", "name", "change", F.col("old.start_line").alias("old_start"), F.col("new.start_line").alias("new_start"))


@query("""WITH old AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS m FROM lineitem WHERE l_quantity < 40 GROUP BY 1),
new AS (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS m FROM lineitem WHERE l_quantity > 5 GROUP BY 1)
SELECT coalesce(n.l_orderkey, o.l_orderkey) AS name, CASE WHEN o.m IS NULL THEN 'added' WHEN n.m IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM old o FULL JOIN new n ON o.l_orderkey = n.l_orderkey WHERE o.m IS DISTINCT FROM n.m""")
def entity_diff_classes(t):
    def methods(condition):
        rows = t.lineitem.where(condition).groupBy(F.col("l_orderkey").alias("name")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
        return rows.select("name", F.transform("x", lambda s: s["l_partkey"]).alias("methods"))

    return D.diff(methods("l_quantity < 40"), methods("l_quantity > 5"), ["name"], ["methods"]).select("name", "change")


@query("SELECT p_brand AS file, count(*) AS n, 'added' AS change FROM part GROUP BY 1")
def entity_diff_first_seen(t):
    rows = t.part.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("name"), "p_size")
    found = D.diff(rows.limit(0), rows, ["file", "name"], ["p_size"])
    return found.groupBy("file", "change").agg(F.count("*").alias("n"))


@query(f"WITH {PART_SQL} SELECT file, name, start_line, end_line, signature FROM new")
def diff_apply(t):
    old, new = _versions(t)
    key = ["file", "name"]
    return D.apply_diff(old, D.diff(old, new, key, ["start_line", "end_line", "signature"]), key)


def _changes(t):
    return t.events.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("change_type"), "ts", "event_id")


@query("SELECT path, change_type, event_id FROM (SELECT 'f' || user_id AS path, event_type AS change_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def coalesce_changes(t):
    return monitor.coalesce_changes(_changes(t), ["ts", "event_id"]).select("path", "change_type", "event_id")


@query("""WITH r AS (SELECT 'f' || user_id AS path, event_id, floor(floor(epoch(ts)) / 3600)::BIGINT AS tick, ts FROM events),
l AS (SELECT path, tick, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY tick, path ORDER BY ts DESC, event_id DESC) AS n FROM r) WHERE n = 1)
SELECT path, tick, event_id, floor((row_number() OVER (PARTITION BY tick ORDER BY ts, event_id) - 1) / 5)::BIGINT AS flush FROM l""")
def flush_assignment(t):
    return monitor.flush_assignment(_changes(t), 5, 3600, ["ts", "event_id"]).select("path", "tick", "event_id", "flush")


@query("""WITH f AS (SELECT 'f' || user_id AS path, ts, (event_id % 4)::INT AS retries, event_id FROM events WHERE event_type = 'error'),
p AS (SELECT 'f' || user_id AS path, max(ts) AS newest FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT event_id, path, retries + 1 AS retries, CASE WHEN retries + 1 >= 3 THEN 'dropped' WHEN newest > ts THEN 'superseded' ELSE 'requeued' END AS outcome FROM f LEFT JOIN p USING (path)""")
def retry_or_drop(t):
    rows = _changes(t).withColumn("retries", (F.col("event_id") % 4).cast("int"))
    found = monitor.retry_or_drop(rows.where("change_type = 'error'"), rows.where("change_type = 'click'"))
    return found.select("event_id", "path", "retries", "outcome")


@query("""SELECT count(*) AS total_batches, sum(n)::BIGINT AS total_changes, sum(n)::DOUBLE / count(*) AS average_batch_size, sum(millis)::BIGINT AS processing_time, sum((failed)::INT)::BIGINT AS errors
FROM (SELECT user_id, count(*) AS n, sum((value * 100)::BIGINT)::BIGINT AS millis, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1)""")
def batch_metrics(t):
    millis = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    log = t.events.groupBy("user_id").agg(F.count("*").alias("size"), millis.alias("millis"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    return monitor.batch_metrics(log)


@query("""SELECT (SELECT count(DISTINCT user_id) FROM events) AS files_monitored, count(*) AS files_processed, sum((event_type <> 'view')::INT)::BIGINT AS changes_detected, sum((event_type = 'error')::INT)::BIGINT AS errors,
max(event_id) FILTER (event_type <> 'view') AS last_change, (SELECT floor(sum(m) / count(*))::BIGINT FROM (SELECT (value * 100)::BIGINT AS m FROM events ORDER BY event_id DESC LIMIT 1000)) AS average_processing_time FROM events""")
def metrics_snapshot(t):
    rows = t.events.select(F.col("event_id").alias("seq"), F.col("event_id").alias("at"), F.round(F.col("value") * 100).cast("bigint").alias("millis"), (F.col("event_type") != "view").alias("changed"), (F.col("event_type") == "error").alias("failed"))
    return monitor.metrics_snapshot(rows, t.events.select("user_id").distinct())


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'create_dir' WHEN 'purchase' THEN 'create' WHEN 'click' THEN 'modify' WHEN 'error' THEN 'remove' ELSE CASE WHEN value > 5 THEN 'modify' ELSE 'rename' END END AS kind FROM events""")
def event_classify(t):
    names = {"signup": "CREATE_DIR", "purchase": "CREATE", "click": "WRITE", "error": "REMOVE", "view": "RENAME"}
    code = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    return t.events.select("event_id", monitor.raw_event(code, F.col("value") > 5).alias("kind"))


@query("""WITH a AS (SELECT 'd' || doc_id AS path, doc_id % 10 = 0 AS is_dir, md5(text) AS hash FROM documents WHERE doc_id % 4 <> 0),
b AS (SELECT 'd' || doc_id AS path, doc_id % 10 = 0 AS is_dir, CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE md5(text) END AS hash FROM documents WHERE doc_id % 9 <> 0)
SELECT * FROM (SELECT path, CASE WHEN b.hash IS NULL THEN 'remove' WHEN a.hash IS NULL AND b.is_dir THEN 'create_dir' WHEN a.hash IS NULL THEN 'create' WHEN NOT b.is_dir AND a.hash <> b.hash THEN 'modify' END AS event
FROM a FULL JOIN b USING (path)) WHERE event IS NOT NULL""")
def snapshot_events(t):
    rows = t.documents.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 10 == 0).alias("is_dir"), F.md5(F.col("text").cast("binary")).alias("hash"))
    after = rows.where("doc_id % 9 <> 0").withColumn("hash", F.when(F.col("doc_id") % 6 == 0, "x").otherwise(F.col("hash")))
    return monitor.classify(rows.where("doc_id % 4 <> 0").drop("doc_id"), after.drop("doc_id"))


MARKS = ["A ", " M", " D", "AM", "MD", "??", "R "]


@query("""SELECT 'src/f' || event_id || '.ts' AS path, CASE event_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' WHEN 3 THEN 'A' WHEN 4 THEN 'M' END AS status FROM events WHERE event_id % 7 < 5""")
def git_status_parse(t):
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]), (F.col("event_id") % 7 + 1).cast("int"))
    return monitor.git_status(t.events.select(F.concat(mark, F.lit(" src/f"), F.col("event_id").cast("string"), F.lit(".ts")).alias("line")))


@query("""SELECT 'a' || event_id || '.ts' AS path, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' ELSE 'D' END AS status FROM events UNION ALL SELECT 'b' || event_id || '.ts', 'A' FROM events WHERE event_id % 4 = 3""")
def git_diff_parse(t):
    name = F.concat(F.col("event_id").cast("string"), F.lit(".ts"))
    k = F.col("event_id") % 4
    line = F.when(k == 3, F.concat(F.lit("R100\ta"), name, F.lit("\tb"), name)).otherwise(F.concat(F.when(k == 0, "A").when(k == 1, "M").otherwise("D"), F.lit("\ta"), name))
    return monitor.git_diff(t.events.select(line.alias("line")), extended=True)


def _scratch(t, name: str) -> str:
    base = t.spark.conf.get("spark.checkpoint.dir", None) or "/tmp/skarn-shared"
    return f"{base}/streams/{name}-{uuid.uuid4().hex}"


def _event_stream(t):
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")


@query("SELECT path, change_type, event_id FROM (SELECT 'f' || user_id AS path, event_type AS change_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_coalesce(t):
    place = _scratch(t, "coalesce")
    rows = _event_stream(t).select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("change_type"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    target = VersionedTable(t.spark, f"{place}/pending", "path string, change_type string, ts timestamp, event_id bigint")
    monitor.follow(rows, target, ["path"], ["ts", "event_id"], f"{place}/checkpoint").awaitTermination()
    return target.read().select("path", "change_type", "event_id")


@query("""WITH state AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE md5(text) END AS hash, n_chars AS modified FROM documents WHERE doc_id % 3 <> 0)
SELECT n.path FROM (SELECT 'd' || doc_id AS path, md5(text) AS hash, n_chars AS modified FROM documents) n LEFT JOIN state s USING (path) WHERE s.hash IS NULL OR s.hash <> n.hash OR s.modified <> n.modified""")
def stream_change_detect(t):
    place = _scratch(t, "detect")
    path, hash_ = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.md5(F.col("text").cast("binary"))
    state, out = (VersionedTable(t.spark, f"{place}/{n}", monitor.STATE) for n in ("state", "changes"))
    state.write(t.documents.where("doc_id % 3 <> 0").select(path, F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(hash_).alias("hash"), F.col("n_chars").alias("modified")), 0)
    stream = t.spark.readStream.schema(t.documents.schema).parquet(f"{t.folder}/document[s].parquet").select(path, hash_.alias("hash"), F.col("n_chars").alias("modified"))
    monitor.detect(stream, state, out, f"{place}/checkpoint").awaitTermination()
    return out.read().select("path")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def store_merge_versions(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    store = VersionedTable(t.spark, f"{_scratch(t, 'store')}/orders", "o_custkey bigint, o_orderkey bigint, o_totalprice double")
    middle = rows.agg(F.max("o_orderkey")).first()[0] // 2
    store.merge(rows.where(F.col("o_orderkey") <= middle), ["o_custkey"], ["o_orderkey"])
    store.merge(rows.where(F.col("o_orderkey") > middle), ["o_custkey"], ["o_orderkey"])
    return store.read()


@query("SELECT user_id, sum(n)::BIGINT AS n FROM (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def merge_idempotent(t):
    counts = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    once = M.merge(counts.limit(0), counts, ["user_id"]).drop("change")
    return M.merge(once, counts, ["user_id"]).drop("change")

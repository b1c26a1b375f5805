"""Scans, stores, parsing details, ingestion and the monitor on temporary trees."""

import os
import subprocess

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from skarn.operators.parse import parse_source
from skarn.plans.corpus import FILES


def tree(folder):
    for path, text in FILES.items():
        target = folder / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    for extra in ("node_modules/skip.ts", "src/dist/skip.ts", "src/_hidden.ts", "notes.md"):
        target = folder / extra
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("const a = 1;")
    return folder


def test_scan_prunes_and_keeps_hidden_names(spark, tmp_path):
    from skarn.sources.files import binary_files, scan

    rows = {r.path: r for r in scan(spark, str(tree(tmp_path))).collect()}
    assert set(rows) == set(FILES) | {"src/_hidden.ts"}
    assert rows["src/models.ts"].content == FILES["src/models.ts"] and rows["src/models.ts"].language == "ts"
    assert {r.path for r in binary_files(spark, str(tmp_path)).select("path").collect()} == set(FILES) - {"src/empty.ts"}


def test_a_folder_that_cannot_be_listed_is_an_error(tmp_path):
    from skarn.sources.files import list_files

    assert list_files(str(tmp_path)) == []
    with pytest.raises(FileNotFoundError):
        list_files(str(tmp_path / "gone"))


def test_ingest_is_incremental(spark, tmp_path):
    from skarn.plans.ingest import CodeBase

    code = CodeBase(spark, str(tree(tmp_path / "tree")), str(tmp_path / "store"))
    first = code.ingest()
    assert (first.parsed, first.removed, first.errors) == (len(FILES) + 1, 0, 1)
    counts = {r.kind: r.n for r in code.report().collect()}
    assert counts["functions"] == 15 and counts["classes"] == 4 and counts["files"] == len(FILES) + 1
    assert code.ingest().parsed == 0
    (tmp_path / "tree/src/util.js").write_text("function helper(n) { return n; }\nfunction fresh() {}\n")
    os.remove(tmp_path / "tree/src/Legacy.jsx")
    again = code.ingest()
    assert (again.parsed, again.removed) == (1, 1)
    changes = {(r.entity_kind, r.change, r.key) for r in code.changes.read().collect()}
    assert {("functions", "added", "fresh"), ("functions", "modified", "helper"), ("functions", "removed", "twice"), ("functions", "removed", "Old"), ("classes", "removed", "Counter")} <= changes
    names = {(r.file, r.name) for r in code.tables()["functions"].collect()}
    assert ("src/util.js", "fresh") in names and ("src/Legacy.jsx", "Old") not in names and ("src/models.ts", "load") in names
    best = code.search("class Counter add helper", 3).collect()
    assert len(best) == 3 and best[0].distance <= best[1].distance
    exact = code.search("function fresh", 1, keyword="fresh").first()
    assert exact.name == "fresh" and exact.combined_score > exact.similarity_score
    assert code.chunks.read().where("file_path = 'src/Legacy.jsx'").count() == 0


def test_monitor_api(spark, tmp_path):
    from skarn.plans.ingest import CodeBase
    from skarn.streaming.api import Monitor

    folder = tree(tmp_path / "tree")
    monitor = Monitor(CodeBase(spark, str(folder), str(tmp_path / "store")))
    events = monitor.events.subscribe()
    monitor.poll()
    assert monitor.status()["running"] and not monitor.status()["paused"]
    assert monitor.stats()["files_monitored"] == len(FILES) + 1 and monitor.stats()["batch_metrics"]["total_batches"] == 1
    monitor.pause()
    (folder / "src/empty.ts").write_text("let q = 1;")
    assert monitor.poll() is None
    monitor.resume()
    assert monitor.poll().parsed == 1
    assert monitor.file("src/empty.ts")["monitored"] and not monitor.file("nope.ts")["monitored"]
    assert monitor.files()["total"] == len(FILES) + 1 and monitor.changes()["changes_detected"] == len(FILES) + 2
    assert monitor.rescan()["status"] == "rescanned"
    assert [e["type"] for e in events][:2] == ["connected", "batch"]
    for _ in range(200):
        monitor.events.publish("x", "y")
    assert len(events) == 100


def test_git_changes(spark, tmp_path):
    from skarn.sources.files import GitRange

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.ts").write_text("let a = 1;\nlet b = 2;\nlet c = 3;\n")
    (tmp_path / "b.ts").write_text("x")
    run("add", "-A")
    run("commit", "-qm", "one")
    git = GitRange(str(tmp_path))
    assert git.changes(spark).count() == 0
    (tmp_path / "new file.ts").write_text("y")
    assert [tuple(r) for r in git.changes(spark).collect()] == [('"new file.ts"', "A")]
    os.rename(tmp_path / "a.ts", tmp_path / "c.ts")
    os.remove(tmp_path / "b.ts")
    run("add", "-A")
    run("commit", "-qm", "two")
    assert {tuple(r) for r in git.changes(spark).collect()} == {("a.ts", "D"), ("c.ts", "A"), ("b.ts", "D"), ("new file.ts", "A")}


def test_state_file_and_config(spark, tmp_path, monkeypatch):
    from skarn.sources.files import Config, read_state, write_state

    path = str(tmp_path / "state.json")
    assert read_state(spark, path).count() == 0
    rows = [("a.ts", "h1", 5), ("b.ts", "h2", 6)]
    write_state(spark.createDataFrame(rows, "path string, hash string, modified bigint"), path)
    assert [tuple(r) for r in read_state(spark, path).orderBy("path").collect()] == rows
    monkeypatch.delenv("EMBEDDING_MODEL", raising=False)
    (tmp_path / ".env").write_text("# c\nEMBEDDING_MODEL='text-embedding-3-large'\n")
    assert Config.load(str(tmp_path / ".env")).model == "text-embedding-3-large"
    monkeypatch.delenv("EMBEDDING_MODEL", raising=False)


def test_versioned_table(spark, tmp_path):
    from skarn.sources.store import VersionedTable

    t = VersionedTable(spark, str(tmp_path / "t"), "k int, v string")
    assert t.read().count() == 0
    t.merge(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    t.merge(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    os.makedirs(tmp_path / "t/v-9")  # an unfinished version is never read
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    t.merge(spark.createDataFrame([(1, "z")], "k int, v string"), ["k"], version=1)
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert t.vacuum(1) == [0] and t.versions() == [1]


def test_embedding_providers(spark):
    from skarn.functions.embed import HashingProvider, HttpProvider, checked_dimension, embedded

    assert checked_dimension("text-embedding-3-small") == 512 and checked_dimension("text-embedding-3-large", 3072) == 3072
    for bad in (("nope", 0), ("text-embedding-ada-002", 7)):
        with pytest.raises(ValueError):
            checked_dimension(*bad)
    http = HttpProvider("http://127.0.0.1:1/", "k", timeout=0.5)
    assert http.payload(["a"]) == {"input": ["a"], "model": "text-embedding-3-small", "dimensions": 512}
    with pytest.raises(OSError):
        http.embed(["a"])
    seen = []

    class Counting(HashingProvider):
        def embed(self, texts):
            seen.append(len(texts))
            assert len(texts) <= 100
            return super().embed(texts)

    rows = [(f"f{i}", "function", f"n{i}", "p", f"text {i}", "ts", "{}") for i in range(250)]
    chunks = spark.createDataFrame(rows, "id string, chunk_type string, name string, file_path string, content string, language string, metadata string")
    got = embedded(chunks, Counting(64)).collect()
    assert len(got) == 250 and all(len(r.embedding) == 64 and abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got)


def test_approximate_index_recall(spark):
    import numpy as np

    from skarn.operators.search import SignIndex, similar

    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 32))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(np.repeat(base, 25, axis=0) + 0.3 * rng.normal(size=(1000, 32)))]
    frame = spark.createDataFrame(rows, "id bigint, embedding array<float>").cache()
    index = SignIndex(32)
    built = index.build(frame).cache()
    hits = 0
    for q in range(0, 1000, 100):
        exact = {r.id for r in similar(frame, rows[q][1], 10).collect()}
        hits += len(exact & {r.id for r in index.search(built, rows[q][1], 10).collect()})
    assert hits >= 90


def test_index_search_of_many_queries_makes_no_pairs(spark):
    """The buckets' rule against a plain evaluation; no bucket, flip or candidate is a row of the plan."""
    from itertools import combinations

    import numpy as np

    from skarn.operators.search import SignIndex

    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(np.repeat(rng.normal(size=(30, 16)), 20, axis=0) + 0.4 * rng.normal(size=(600, 16)))]
    rows += [(600, rows[7][1]), (601, rows[7][1]), (602, [0.0] * 16), (603, None)]
    index = SignIndex(16, tables=3)
    frame = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(3)
    found = index.search_many(index.build(frame), frame.where("id % 20 = 0 or id > 600").selectExpr("id as query_id", "embedding"), 11, block=9)
    assert "Generate" not in found._jdf.queryExecution().toString()
    told = {i: np.asarray(np.float32(v), np.float64) for i, v in rows if v and any(v)}
    codes = dict(zip(told, index.codes(list(told.values())).tolist(), strict=True))
    flips = {sum(1 << b for b in flip) for n in range(3) for flip in combinations(range(10), n)}
    want = set()
    for q in [i for i in told if i % 20 == 0 or i > 600]:
        near = [i for i in told if any(a ^ b in flips for a, b in zip(codes[q], codes[i], strict=True))]
        best = sorted((round(1 - told[i] @ told[q] / np.linalg.norm(told[i]) / np.linalg.norm(told[q]), 12), i) for i in near)[:11]
        want |= {(q, i) for _, i in best}
    assert {(r.query_id, r.id) for r in found.collect()} == want


def test_parser_details():
    crlf, error = parse_source("a.ts", "export async function f(a: Foo,\r\n  b = `x${g(1)}`): Promise<Bar> {\r\n}\r\n")
    assert error is None and crlf["functions"][0]["start_line"] == 1 and crlf["functions"][0]["end_line"] == 3
    assert crlf["functions"][0]["is_async"] and crlf["functions"][0]["is_export"]
    assert [(u["used_type"], u["usage_context"]) for u in crlf["type_usages"]] == [("Foo", "parameter"), ("Promise", "return_type"), ("Bar", "type_argument")]
    assert [c["called_func"] for c in crlf["function_calls"]] == ["g"]
    wide, error = parse_source("é.ts", "const é = () => 'ü';\n// ü\nclass Ä { ö(): void { this.ö(); } }")
    assert error is None and [f["name"] for f in wide["functions"]] == ["ö", "é"] and wide["classes"][0]["name"] == "Ä"
    for bad in ("function f( {", "const s = 'x", "a }", "/* never", "`${"):
        assert parse_source("b.ts", bad)[1]
    js, _ = parse_source("c.js", "var re = a / b / c; var ok = /y)/.test(z); new Foo().run(); a?.b(1); require(name);")
    assert [c["called_func"] for c in js["function_calls"]] == ["require", "test", "run", "a.b"] and not js["imports"]
    assert parse_source("d.tsx", "const f = <T,>(x: T) => x; const g = () => <></>;")[1] is None
    assert parse_source("x.py", "")[1].startswith("unsupported")


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(alphabet="abc(){}[]<>=;:,.'\"`/*$\n +-?!&|@#é0 function class const return import", max_size=120), st.sampled_from(["ts", "tsx", "js", "jsx", "css", "scss"]))
def test_parser_never_breaks(text, language):
    records, error = parse_source(f"f.{language}", text)
    assert error is None or isinstance(error, str)
    lines = text.count("\n") + 1
    assert all(1 <= f["start_line"] <= f["end_line"] <= lines for f in records["functions"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 99)), max_size=12), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 99)), max_size=12))
def test_merge_and_diff_laws(spark, old, new):
    from skarn.operators import diff as D, merge as M

    schema = "k int, v int, seq int"
    a, b = (M.latest(spark.createDataFrame(r, schema), ["k"], ["seq", "v"]) for r in (old, new))
    once = M.merge(a, b, ["k"]).drop("change")
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "v", "seq").collect())
    assert rows(M.merge(once, b, ["k"]).drop("change")) == rows(once)
    assert rows(D.apply_diff(a, D.diff(a, b, ["k"], ["v", "seq"]), ["k"])) == rows(b)
    assert D.diff(b, b, ["k"], ["v", "seq"]).count() == 0


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    import random

    from skarn.operators.merge import latest
    from skarn.sources.store import VersionedTable
    from skarn.streaming.monitor import follow

    rng = random.Random(1)
    rows = [(f"p{rng.randrange(9)}", rng.choice("ab"), i) for i in range(60)]
    rng.shuffle(rows)
    schema = "path string, change_type string, event_id bigint"
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i : i + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target = VersionedTable(spark, str(tmp_path / "out"), schema)
    follow(stream, target, ["path"], ["event_id"], str(tmp_path / "check")).awaitTermination()
    assert len(target.versions()) == 3
    want = latest(spark.createDataFrame(rows, schema), ["path"], ["event_id"])
    assert sorted(map(tuple, target.read().collect())) == sorted(map(tuple, want.collect()))


def test_file_stream_reports_new_files(spark, tmp_path):
    from skarn.operators.extract import entity_tables, parsed
    from skarn.sources.files import file_stream

    folder = tree(tmp_path / "tree")
    (folder / "vendor").mkdir()
    (folder / "vendor/skip.ts").write_text("function no() {}")
    seen = []

    def take(batch, _):
        seen.extend(r.name for r in entity_tables(parsed(batch))["functions"].select("name").collect())

    def run():
        file_stream(spark, str(folder)).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert sorted(seen) == sorted(["format", "describe", "constructor", "load", "describe", "format", "promote", "audit", "plain", "helper", "add", "twice", "App", "Footer", "Old"])
    seen.clear()
    (folder / "src/late.ts").write_text("export function late() {}")
    run()
    assert seen == ["late"]


def test_innermost_keeps_repeats(spark):
    import random

    from skarn.operators.relate import innermost

    rng = random.Random(6)
    spans = [(f"s{i}", f"f{i % 3}", a, a + rng.randint(0, 4000)) for i in range(60) for a in [rng.randint(0, 9000)]]
    points = [(f"f{rng.randrange(4)}", rng.randint(-5, 13000)) for _ in range(300)] * 2 + [("f1", None), (None, 5)]
    frame = spark.createDataFrame(points, "file string, line int")
    rows = spark.createDataFrame(spans, "name string, file string, start_line int, end_line int")

    def best(file, line, grouped):
        inside = [] if line is None else [s for s in spans if (s[1] == file or not grouped) and s[2] <= line <= s[3]]
        return min((-s[2], s[3]) for s in inside) if inside else None

    for group, spans_of in ((["file"], rows), ([], rows.drop("file"))):
        got = innermost(frame, spans_of, group, "line").collect()
        mine = sorted((str(r.file), str(r.line), str(None if r.start_line is None else (-r.start_line, r.end_line))) for r in got)
        assert mine == sorted((str(f), str(x), str(best(f, x, bool(group)))) for f, x in points)
    assert innermost(frame, rows.where("false"), ["file"], "line").where("name is null").count() == len(points)


def test_many_queries_equal_one_at_a_time(spark):
    import random

    from skarn.operators.search import similar, similar_many

    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [(100, None), (101, [0.0] * 6)]
    chunks = spark.createDataFrame(data + [(200, data[3][1])], "id bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in data if i % 20 == 0], "query_id bigint, embedding array<double>")
    for block in (4096, 2):
        found = similar_many(chunks, queries, 4, block=block).collect()
        for i, v in data:
            if i % 20 == 0 and v:
                want = [r.id for r in similar(chunks, v, 4).collect()]
                assert [r.id for r in sorted((r for r in found if r.query_id == i), key=lambda r: (round(r.distance, 9), r.id))] == want
    assert similar_many(chunks, queries.where("false"), 4).count() == 0
    assert similar_many(chunks.where("false"), queries, 4).count() == 0


def test_nested_scopes_and_many_rules_stay_fast():
    import time

    from skarn.operators.parse.script import Script  # noqa: F401
    from skarn.operators.parse.style import parse_style

    began = time.perf_counter()
    rules = parse_style("\n".join(f".a{i} {{ color: red; }}" for i in range(30000)), False)
    assert len(rules) == 30000 and rules[-1]["line"] == 30000 and time.perf_counter() - began < 5


def test_rolling_mean_over_ranges(spark):
    import random

    from skarn.operators.stats import rolling_mean

    rng = random.Random(3)
    data = [(i * 3, rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-50, 50)])) for i in range(400)]
    rows = spark.createDataFrame(data, "at bigint, kind string, v bigint")
    for groups, ranges in ((["kind"], 7), ([], 5), (["kind"], 1)):
        got = {r["at"]: r["mean"] for r in rolling_mean(rows, "at", "v", 20, groups, ranges).collect()}
        assert len(got) == 400
        for i, (at, kind, _) in enumerate(data):
            last = [v for _, k, v in data[: i + 1] if k == kind or not groups][-20:]
            known = [v for v in last if v is not None]
            assert got[at] == (sum(known) // len(known) if known else None)
    assert rolling_mean(rows.where("false"), "at", "v", 20, ["kind"], 4).count() == 0


def test_unreadable_files_are_tried_again(spark, tmp_path, monkeypatch):
    from skarn.plans import ingest

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.ts").write_text("export function one() { return 1 }")
    (root / "b.ts").write_text("export function two() { return one() }")
    code = ingest.CodeBase(spark, str(root), str(tmp_path / "store"))
    plain = ingest.scan
    hidden = lambda *a, **k: plain(*a, **k).selectExpr("path", "language", "modified", "if(path = 'b.ts', null, hash) hash", "if(path = 'b.ts', null, content) content", "if(path = 'b.ts', 'denied', error) error")
    monkeypatch.setattr(ingest, "scan", hidden)
    names = lambda: sorted(r["name"] for r in code.tables()["functions"].collect())
    code.ingest()
    assert names() == ["one"]
    monkeypatch.setattr(ingest, "scan", plain)
    code.ingest()
    assert names() == ["one", "two"]
    (root / "b.ts").write_text("export function three() { return 3 }")
    monkeypatch.setattr(ingest, "scan", hidden)
    code.ingest()
    assert names() == ["one", "two"]


def test_loop_git_queue_and_server(spark, tmp_path):
    import json
    import socket
    import threading
    import urllib.error
    import urllib.request

    from skarn.plans.ingest import CodeBase, Report
    from skarn.sources.files import GitRange
    from skarn.streaming.api import Monitor
    from skarn.streaming.monitor import Pending
    from skarn.streaming.server import server

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.ts").write_text("export function one() { return 1 }")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    code = CodeBase(spark, str(root), str(tmp_path / "store"))
    monitor = Monitor(code, GitRange(str(root)), pending=Pending(seconds=0))
    names = lambda: sorted(r["name"] for r in code.tables()["functions"].collect())
    monitor.step(0.0)
    assert names() == ["one"]
    (root / "b c.ts").write_text("export function two() { return 2 }")
    monitor.step(1.0)  # neither is due
    assert names() == ["one"]
    monitor.next_poll = 1000.0
    monitor.step(31.0)  # git names the file
    assert names() == ["one", "two"]
    monitor.pause()
    (root / "c.ts").write_text("export function three() { return 3 }")
    os.remove(root / "a.ts")
    assert monitor.poll().removed == 1 and names() == ["two"]
    monitor.resume()

    asked = []
    real, code.ingest = code.ingest, lambda force=False, only=None, removals_only=False: asked.append(sorted(r[0] for r in only.collect())) or 1 / 0
    monitor.pending.add("c.ts")
    assert [monitor.flush(float(i)) for i in range(4)] == [[], [], ["c.ts"], []] and asked == [["c.ts"]] * 3
    assert monitor.errors == 3 and "ZeroDivisionError" in monitor.last_error
    code.ingest = real

    web = server(monitor, port=0)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_port}"
    get = lambda path, data=None: json.load(urllib.request.urlopen(base + path, data, timeout=60))
    code.ingest = lambda force=False, only=None, removals_only=False: Report(1, 0, 0)
    try:
        assert get("/api/v1/status")["running"] and get("/api/v1/files") == {"total": 1, "files": ["b c.ts"]}
        assert get("/api/v1/file/b%20c.ts")["monitored"] and get("/api/v1/stats")["batch_metrics"]["errors"] == 3
        assert get("/api/v1/pause", b"")["status"] == "paused" and get("/api/v1/status")["paused"] and get("/api/v1/resume", b"")["status"] == "resumed"
        for path, data, wrong in (("/api/v1/pause", None, 405), ("/nothing", None, 404), ("/ws/events", None, 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(path, data)
            assert e.value.code == wrong
        with socket.create_connection(("127.0.0.1", web.server_port), timeout=30) as client:
            client.sendall(b"GET /ws/events HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Version: 13\r\nSec-WebSocket-Key: dGhlIHNhbXBsZSBub25jZQ==\r\n\r\n")
            data = b""
            while b"connected" not in data:
                data += client.recv(4096)
            assert b"101" in data and b"s3pPLMBiTxaQ9kYGzzhZRbK+xOo=" in data
            assert get("/api/v1/rescan", b"")["status"] == "rescanned"
            while b'"batch"' not in data:
                data += client.recv(4096)
    finally:
        web.shutdown()
        web.server_close()

    stop = threading.Event()
    loop = threading.Thread(target=monitor.run, args=(stop, 0.01))
    loop.start()
    stop.set()
    loop.join(60)
    assert not monitor.running


def test_buckets_are_replaced_alone(spark, tmp_path):
    import random

    from skarn.sources.store import VersionedTable

    rng = random.Random(5)
    schema = "path string, n bigint"
    table = VersionedTable(spark, str(tmp_path / "t"), schema, ["path"], 8)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert table.read().count() == 0 and table.written() is None
    want = {f"p{i}": [i, i] for i in range(40)}
    table.write(frame([(p, n) for p, ns in want.items() for n in ns]))
    for turn in range(4):
        gone = [f"p{rng.randrange(50)}" for _ in range(2)]
        new = {p: [100 + turn] for p in gone[:1]}
        table.replace_for(frame([(p, n) for p, ns in new.items() for n in ns]), ["path"], frame([(p, 0) for p in gone]).select("path"))
        want = {p: ns for p, ns in want.items() if p not in gone} | new
        assert sorted(map(tuple, table.read().collect())) == sorted((p, n) for p, ns in want.items() for n in ns)
    written = [p for p in os.listdir(tmp_path / "t" / "v-4") if p.startswith("bucket=")]
    assert len(written) <= 2 and table.versions() == [0, 1, 2, 3, 4]
    table.vacuum(1)
    assert table.versions() == [4] and sorted(map(tuple, table.read().collect())) == sorted((p, n) for p, ns in want.items() for n in ns)
    table.replace_for(frame([]), ["path"], table.read().select("path"))
    assert table.read().count() == 0 and table.written() > 0


class Recorder:
    """A runner that appends its statements to a file of its own."""

    def __init__(self, folder):
        import uuid

        self.path, self.lines = f"{folder}/{uuid.uuid4()}", []

    def run(self, statement, parameters):
        self.lines.append((statement, parameters))

    def commit(self):
        import json

        with open(self.path, "a") as f:
            f.writelines(json.dumps(x) + "\n" for x in self.lines)
        self.lines = []

    def close(self):
        assert not self.lines


def test_graph_sinks(spark, tmp_path):
    import json
    from functools import partial

    import duckdb
    from pyspark import cloudpickle

    import tests.test_engine as here
    from skarn.operators import extract
    from skarn.operators.graph import CodeGraph
    from skarn.sources.sinks import Cypher, DatabaseSink, InlineCypher, ParquetSink, Sql, literal, write_graph

    cloudpickle.register_pickle_by_value(here)
    files = spark.createDataFrame([(p, t, p.rsplit(".", 1)[1]) for p, t in FILES.items()], "path string, content string, language string").cache()
    tables = extract.entity_tables(extract.parsed(files).cache())
    graph = CodeGraph(tables, files)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        sink = ParquetSink(spark, str(tmp_path / "parquet"))
        write_graph(graph, sink)
        read = lambda name: spark.read.parquet(f"{tmp_path}/parquet/{name}/v-0")
        assert read("Function").count() == graph.vertices["functions"].count() and read("CALLS/Function-Function").count() == graph.calls().count() > 0
        sink.write_vertices("File", ["path"], graph.files)
        assert sink.table("File", graph.files, ["path"]).read().count() == len(FILES)

        logs = {}
        for name, dialect in (("cypher", Cypher()), ("inline", InlineCypher("g")), ("sql", Sql(lambda n: "?", ""))):
            folder = tmp_path / name
            folder.mkdir()
            write_graph(graph, DatabaseSink(dialect, partial(here.Recorder, str(folder)), batch=5))
            logs[name] = [json.loads(x) for p in sorted(folder.iterdir(), key=os.path.getmtime) for x in p.read_text().splitlines()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    vertex = [x for x in logs["cypher"] if "MERGE (n:Function {file: row.file, name: row.name}) SET n += row" in x[0]]
    assert sum(len(p["rows"]) for _, p in vertex) == graph.vertices["functions"].count() and max(len(p["rows"]) for _, p in vertex) == 5
    edge = [x for x in logs["cypher"] if "MERGE (a)-[e:CALLS]->(b) SET e += row.properties" in x[0]]
    assert "MATCH (a:Function {file: row.ends.caller_file, name: row.ends.caller_func})" in edge[0][0] and set(edge[0][1]["rows"][0]["properties"]) == {"call_location", "call_context"}
    assert any(x[0].startswith("SELECT * FROM cypher('g', $$ MERGE (n:File {path: 'src/models.ts'}) SET n.language = 'ts' RETURN n $$)") for x in logs["inline"])
    assert literal("it's\n$$\\") == "'it\\'s\\n\\u0024\\u0024\\\\'" and literal([True, None, 1.5]) == "[true, null, 1.5]"

    db = duckdb.connect()
    db.execute("create table Function (file text, name text, start_line int, end_line int, signature text, is_async bool, is_export bool, primary key (file, name))")
    db.execute("create table CALLS_Function_Function (caller_file text, caller_func text, target_file text, resolved_target text, call_location int, call_context text)")
    for _ in range(2):  # a second run changes nothing
        for statement, values in logs["sql"]:
            if statement.startswith(("MERGE INTO Function ", "MERGE INTO CALLS_Function_Function ")):
                db.execute(statement, values)
    want = sorted(map(tuple, graph.vertices["functions"].drop("seq").select("file", "name", "start_line", "end_line", "signature", "is_async", "is_export").collect()))
    assert sorted(db.execute("from Function").fetchall()) == want
    assert sorted(db.execute("from CALLS_Function_Function").fetchall()) == sorted(map(tuple, graph.calls().collect()))

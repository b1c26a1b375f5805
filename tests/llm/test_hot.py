"""Hot keys, columns of any name and the shared folder."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from .fixtures import docs, rows


def test_join_hot_equals_a_join(spark):
    from skarn.llm.common import join_hot, written

    data = [(None if i % 5 == 0 else i, "hot" if i % 3 else f"k{i % 40}") for i in range(3000)]
    left = written(spark.createDataFrame(data, "doc_id bigint, k string"), "hot-test")
    right = [("hot", 1), ("k3", 2), ("k9", 3), ("unused", 4)]
    one = spark.createDataFrame(right, "k string, v int")
    known = dict(right)
    for how in ("inner", "left"):
        want = Counter((i, k, known.get(k)) for i, k in data if how == "left" or k in known)
        got = join_hot(left, one, "k", how)
        assert Counter((r.doc_id, r.k, r.v) for r in got.collect()) == want and set(got.columns) == {"doc_id", "k", "v"}
    assert join_hot(left.where("false"), one, "k", "left").count() == 0


def test_history_scans_a_blob_once(spark):
    from skarn.llm.secrets import RULES, digest, scan, scan_history, unseen, address

    data = rows() * 2 + [(5000 + i, rows()[2][1], None, None, None, None, None) for i in range(700)]
    frame = docs(spark, data)
    ledger, found = scan_history(frame, batches=3)
    blobs = {t or "" for _, t, *_ in data}
    assert ledger.count() == len(RULES) * len(blobs) == ledger.select("blob", "kind", "version").distinct().count()
    key = lambda r: (r.doc_id, r.spans)
    assert Counter(map(key, digest(found).collect())) == Counter(map(key, digest(scan(frame)[1]).collect()))
    assert unseen(address(frame), ledger).count() == 0
    newer = [RULES[0], RULES[1].__class__(**{**RULES[1].__dict__, "version": 2}), RULES[2]]
    assert {tuple(r.todo) for r in unseen(address(frame), ledger, newer).collect()} == {("access",)}


def test_forest_spans_the_links():
    import numpy as np

    from skarn.llm.simhash import _forest

    rng = random.Random(4)
    fps = np.array([rng.getrandbits(10) for _ in range(120)], np.uint64)
    for split in (0, 50):
        x, y = _forest(fps[:split], fps[split:], 1) if split else _forest(fps, None, 1)
        assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 1 for a, b in zip(x, y, strict=True))
        assert not split or all(a < split <= b for a, b in zip(x, y, strict=True))

        def roots(pairs):
            root = list(range(len(fps)))
            for a, b in pairs:
                root = [root[a] if r == root[b] else r for r in root] if root[a] != root[b] else root
            return [root.index(r) for r in root]

        every = [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 1 and (not split or a < split <= b)]
        assert roots(zip(x.tolist(), y.tolist(), strict=True)) == roots(every)


def test_stages_keep_columns_of_any_name(spark):
    from skarn.llm.mixing import fit, mix
    from skarn.llm.simhash import kept_rows

    names = ["place", "_place", "_rate", "rate", "copies", "_copies", "_copy", "copy", "n", "count", "fp"]
    frame = docs(spark).drop("fp", "count").select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    keep = spark.createDataFrame([(10,), (15,), (12,)], "doc_id bigint")
    got = kept_rows(frame, keep)
    assert got.columns == frame.columns and sorted(r.doc_id for r in got.collect()) == [10, 12, 15]
    assert {tuple(r[c] for c in names) for r in got.collect()} == {tuple(range(len(names)))}
    labelled = frame.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("domain"))
    mixed = mix(frame, fit(frame, labelled, {"a": 0.7, "b": 0.3})[0])
    assert mixed.columns == frame.columns and {tuple(r[c] for c in names) for r in mixed.collect()} == {tuple(range(len(names)))}


def test_rare_domain_reaches_its_target(spark):
    from skarn.llm.mixing import fit

    from .test_mixing import SCHEMA, corpus

    data = [r for r in corpus(900) if r[2] == "a" or r[0] % 9 == 0]
    docs = spark.createDataFrame(data, SCHEMA)
    _, report = fit(docs, docs, {"a": 0.1, "b": 0.6, "c": 0.3})
    assert report["met"] and all(abs(r["after"] - r["target"]) < 1e-3 for r in report["domains"].values()), report


def test_a_cluster_without_a_shared_folder_is_refused():
    from skarn.llm.common import LOCAL_SHARED, shared_dir

    class Session:
        def __init__(self, master, folder=None):
            self.conf = {"spark.checkpoint.dir": folder}
            self.sparkContext = type("Context", (), {"master": master})

    assert shared_dir(Session("local[4]")) == LOCAL_SHARED
    assert shared_dir(Session("spark://host:7077", "hdfs:///x")) == "hdfs:///x"
    with pytest.raises(ValueError):
        shared_dir(Session("spark://host:7077"))

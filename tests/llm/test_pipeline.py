"""The pipeline's stages against brute force on the smallest tables, and classifiers on held-out rows."""

import os
from collections import Counter

import pytest

from .test_nearcopies import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_follow_their_decisions(spark):
    from corpus_pipeline import STAGES, decontaminate, mixing, near_dedup, quality, run

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum((i in ids) == (q == 1) for i, q in labels.items()) > 0.95 * len(labels)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in near_dedup(spark, docs, SF).collect()} == brute(rows)  # five words, a similarity of 0.8
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id: r.text for r in decontaminate(spark, docs, SF).select("doc_id", "text").collect()}
    assert not [i for i, t in clean.items() if any(x in t for x in items)]
    assert len(clean) >= docs.count() - sum(any(x.lower()[:60] in r.text.lower() for x in items) for r in docs.collect())
    mixed = Counter(r.doc_id for r in mixing(spark, docs, SF).select("doc_id").collect())
    assert set(mixed) == {r[0] for r in rows}
    out = run(spark, SF)
    assert len(STAGES) == 5 and {"doc_id", "shard", "slot"} <= set(out.columns)
    assert {r.doc_id for r in out.collect()} <= ids


def test_odd_documents_go_through(spark):
    from corpus_pipeline import STAGES
    from skarn.llm.common import written

    from .fixtures import docs as odd

    now = odd(spark).union(odd(spark, [(None, None, None, None, None, None, None)] * 2))
    for name, stage in STAGES:
        now = written(stage(spark, now, SF), f"odd-{name}")
    assert now.count() > 0
    none = odd(spark, [])
    for _, stage in STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


@pytest.mark.parametrize("at", range(5))
def test_stages_take_columns_of_any_name(spark, at):
    from pyspark.sql import functions as F

    from corpus_pipeline import STAGES

    names = ["items", "share", "contaminated", "_items", "_share", "_rate", "_copies", "_copy", "_place", "held", "place", "rate", "shard", "count", "fp"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    more = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    name, stage = STAGES[at]
    got = stage(spark, more, SF)
    if name != "sharding":
        assert got.columns == more.columns
        assert {tuple(r[c] for c in names) for r in got.collect()} == {tuple(range(len(names)))}
    key = lambda df: sorted((r.doc_id, r.asDict().get("shard") if name == "sharding" else r.text) for r in df.collect())
    assert key(got) == key(stage(spark, docs, SF))


def test_held_out_accuracy(spark):
    from skarn.llm.queries import QUERIES

    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    quality = QUERIES["op3_quality"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in quality) > 0.95 * len(quality)
    toxic = QUERIES["op1_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    hits, misses = [r.score for r in toxic if r.toxic], [r.score for r in toxic if not r.toxic]
    assert sum((h > m) + 0.5 * (h == m) for h in hits for m in misses) > 0.6 * len(hits) * len(misses)


def test_classifiers_take_odd_rows(spark):
    from pyspark.sql import functions as F
    from skarn.llm import quality, toxicity

    from .fixtures import docs, rows

    labelled = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i, *_ in rows() if i is not None], "doc_id bigint, quality int, toxic int")
    for labels in (labelled, labelled.limit(0)):
        for module in (quality, toxicity):
            found = module.score(docs(spark), module.fit(docs(spark), labels, F.lit(True))).collect()
            assert len(found) == len(rows()) and all(0 <= r.score <= 1 for r in found)
            assert module.score(docs(spark, []), module.fit(docs(spark, []), labels, F.lit(True))).count() == 0
    assert {r.score for r in found} == {0.5}


def test_trees_equal_a_plain_walk():
    import numpy as np

    from skarn.llm.quality import grow

    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = grow(x, y, np.ones(500), trees=20)
    assert ((model.scores(x) > 0.5) == (y == 1)).mean() > 0.97
    for row in x[:20]:
        margin = model.base
        for f, c, v in zip(model.feature, model.cut, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            margin += v[node - len(f)]
        assert np.isclose(margin, model.margin(row[None])[0])

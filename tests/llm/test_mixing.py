"""Mixing against a dense projected-gradient solution and its targets."""

import random

import numpy as np

SCHEMA = "doc_id bigint, text string, domain string, rate double"


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    words = {d: [d + "".join(rng.choice("aeiourst") for _ in range(5)) for _ in range(120)] for d in "abc"}
    rows = []
    for i in range(n):
        d = "a" if i % 3 else rng.choice("bc")
        other = rng.choice("abc")
        text = [rng.choice(words[other if rng.random() < 0.2 else d]) for _ in range(rng.choice([5, 30, 100]))]
        rows.append((i, " ".join(text), d, 0.0))
    return rows


def test_reaches_the_targets(spark):
    from skarn.llm.mixing import fit, mix, rated

    rows = corpus()
    docs = spark.createDataFrame(rows + [(None, None, None, None), (9000, "", None, None), (3, rows[3][1], None, None)], SCHEMA)
    labelled = spark.createDataFrame([r for r in rows if r[0] % 2], SCHEMA)
    targets = {"a": 0.3, "b": 0.45, "c": 0.25}
    model, report = fit(docs, labelled, targets)
    for d, r in report["domains"].items():
        assert abs(r["after"] - targets[d]) < 1e-3, report
    found = rated(docs, model).collect()
    assert len(found) == len(rows) + 3 and all(0 <= r.rate <= 4 for r in found)
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([r.domain == truth[r.doc_id] for r in found if r.doc_id in truth]) > 0.9
    mixed = mix(docs, model)
    assert mixed.columns == docs.columns
    expected = sum(r.rate for r in found)
    assert abs(mixed.count() - expected) < 5 * np.sqrt(expected)
    assert mixed.count() == sum(r.copies for r in found)


def test_as_good_as_dense_descent(spark):
    """Plain projected descent over all documents, run until nothing changes, finds no better rates."""
    from skarn.llm.mixing import fit, rated
    from skarn.llm.textops import text_buffers
    import pyarrow as pa

    rows = corpus(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    for targets, low, high, met in (((0.1, 0.8, 0.1), 0.5, 2.0, False), ((0.1, 0.6, 0.3), 0.0, float("inf"), True)):
        model, report = fit(docs, docs, dict(zip("abc", targets, strict=True)), low=low, high=high)
        n, p = model.posteriors(*text_buffers(pa.array([r[1] for r in rows])))
        total, share = report["total"], (n @ p) / report["total"]
        miss = lambda rate: (((rate * n) @ p / total - targets) ** 2 / share).sum()
        rate = np.ones(len(rows))
        for _ in range(20000):
            rate = np.clip(rate - p @ (((rate * n) @ p / total - targets) / share), low, high)
        got = {r.doc_id: r.rate for r in rated(docs, model).collect()}
        got = np.array([got[r[0]] for r in rows])
        assert report["met"] == met and (got >= low).all() and (got <= high).all()
        assert miss(got) <= miss(rate) * 1.01 + 1e-6


def test_nothing_to_learn_from(spark):
    from skarn.llm.mixing import fit, mix, rated

    docs = spark.createDataFrame(corpus(5), SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    model, report = fit(docs, none)
    assert model is None and report == {} and {r.rate for r in rated(docs, model).collect()} == {1.0} and mix(docs, model).count() == 5
    model, _ = fit(none, none)
    assert rated(none, model).count() == 0

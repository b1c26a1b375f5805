"""The pipeline's near-copy classes against brute-force Jaccard similarity over five-word shingles."""

import random
from collections import defaultdict

from .fixtures import docs, rows


def brute(data):
    """The least id of every class of texts with a similarity of at least 0.8."""
    def grams(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [(i, grams(t)) for i, t in data if i is not None]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if root[a] != root[b] and len(x & y) >= 0.8 * len(x | y):
                root = [root[b] if r == root[a] else r for r in root]
    least = defaultdict(list)
    for (i, _), r in zip(sets, root, strict=True):
        least[r].append(i)
    return {min(ids) for ids in least.values()}


def edited(seed=4):
    """Texts of 200 words with copies that differ at one to four places, and copies of those."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    out = []
    for base in range(40):
        text = [rng.choice(words) for _ in range(200)]
        out.append((base, " ".join(text)))
        for copy in range(4):
            text = list(text)
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(200)] = rng.choice(words)
            out.append((1000 + 10 * base + copy, " ".join(text)))
    return out


def test_classes_equal_brute_force(spark):
    from skarn.llm.nearcopies import classes, representatives

    data = edited() + [(i, t) for i, t in edited(5) if i < 3]
    frame = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], docs(spark, []).schema)
    want = brute(data)
    for tile in (1 << 17, 500):
        assert {r.component_id for r in classes(frame, tile=tile).collect()} == want
    odd = docs(spark)
    got = representatives(odd).collect()
    assert {r.doc_id for r in got if r.doc_id is not None} == brute([r[:2] for r in rows()])
    assert sum(r.doc_id is None for r in got) == sum(r[0] is None for r in rows())


def test_stage_drops_copies_beyond_four_bits(spark):
    from corpus_pipeline import near_dedup

    data = edited()
    frame = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], docs(spark, []).schema)
    assert {r.doc_id for r in near_dedup(spark, frame, "").collect()} == brute(data)


def test_fingerprints_link_what_the_bands_miss(spark, monkeypatch):
    """The stage's links come from the pigeonhole blocks of fingerprints too: pairs within their bits are found without any band."""
    import numpy as np
    import pyarrow as pa

    from skarn.llm import nearcopies as n
    from skarn.llm.textops import text_buffers

    data = [(i, t) for i, t in edited(6) if i < 1000]
    data += [(5000 + i, f"{t} and one more") for i, t in data]
    values, at, _ = n.shingles(*text_buffers(pa.array([t for _, t in data])))
    fps = n.fingerprints(values, at)
    for i in range(0, len(data), 7):
        part = values[at[i] : at[i + 1]]
        assert int(fps[i]) == sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in part) > len(part))
    near = np.bitwise_count(fps[:40] ^ fps[40:]) <= n.MAX_BITS
    assert near.any()
    monkeypatch.setattr(n, "bands", lambda values, at: np.zeros((len(at) - 1, n.BANDS), np.uint64) + mixed(values, at)[:, None])
    mixed = lambda values, at: np.bitwise_xor.reduceat(n.mix(values), at[:-1])  # noqa: E731  # a key of its own for every text
    frame = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], docs(spark, []).schema)
    found = {r.doc_id: r.component_id for r in n.classes(frame).collect()}
    for i in range(40):
        assert not near[i] or found[5000 + i] == i


def test_rounds_and_stage_clear_up(spark):
    """Tables that nothing reads any more go at once, not when the driver ends."""
    from pathlib import Path

    from skarn.llm.nearcopies import classes
    from skarn.llm.simhash import components

    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "skarn"
    tables = lambda: {p.name for p in shared.glob("*")}
    seen = tables()
    edges = spark.createDataFrame([(i * 7 % 300, (i + 1) * 7 % 300) for i in range(299)], "u bigint, v bigint")
    assert {r.root for r in components(edges).collect()} == {0}
    assert len(tables() - seen) == 1
    seen = tables()
    data = edited()
    frame = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], docs(spark, []).schema)
    assert {r.component_id for r in classes(frame).collect()} == brute(data)
    assert sorted(n.rsplit("-", 1)[0] for n in tables() - seen) == ["cc", "cc", "copies-classes", "hot-keys", "simhash-keys"]

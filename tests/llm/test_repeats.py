"""Removed bytes against every 50-byte string in a dictionary."""

import hashlib
import random
from collections import Counter

from .fixtures import docs, rows


def brute(data, length=50):
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, t, *_ in data:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            least[s] = min(least.get(s, float("inf")), key(i))
    out = []
    for i, t, *_ in data:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def more_rows():
    rng = random.Random(9)
    letters = "abcdefgh "
    pieces = ["".join(rng.choice(letters) for _ in range(rng.choice([30, 49, 50, 51, 70, 200]))) for _ in range(12)]
    texts = ["".join(rng.choice(pieces) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    texts += ["z" * 49, "z" * 50, "z" * 51, "z" * 500, "ab" * 300, "ba" * 100]
    return [(i, t, None, None, None, None, None) for i, t in enumerate(texts, 1000)] + [(None, texts[2], None, None, None, None, None), (None, texts[3], None, None, None, None, None)]


def test_removed_bytes(spark):
    from skarn.llm.repeats import digest, repeated

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for data in (rows(), more_rows() + rows(40, seed=4), []):
            got = Counter(tuple(r) for r in digest(repeated(docs(spark, data), shard_bytes=4000, group_bytes=3000)).collect())
            assert got == brute(data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sorting_in_pieces_and_on_disk(monkeypatch):
    """Runs that go over block ends, and queues that all go to disk, change nothing."""
    import numpy as np

    from skarn.llm import induced, repeats

    rng = random.Random(6)
    base = bytes(rng.choice(b"abcd") for _ in range(400))
    contexts, sizes, ids = [], [], []
    for i in range(300):
        at, n = rng.randrange(320), rng.choice([80, 80, 60, 50, 49, 20])
        piece = bytearray(base[at : at + n])
        if rng.random() < 0.3:
            piece[rng.randrange(n)] ^= 1
        contexts.append(bytes(piece).ljust(repeats.CONTEXT, b"\0"))
        sizes.append(n)
        ids.append(i // 2)
    table = np.frombuffer(b"".join(contexts), np.uint8).reshape(-1, repeats.CONTEXT)
    least = {}
    windows = [(i, s, contexts[i][s : s + 50]) for i in range(300) for s in range(sizes[i] - 49)]
    for i, _, w in windows:
        least[w] = min(least.get(w, 10**9), ids[i])
    want = [0] * 300
    for i, s, w in windows:
        want[i] |= (ids[i] > least[w]) << s
    for block, memory in ((1 << 16, 1 << 20), (64, 0)):
        monkeypatch.setattr(induced, "BLOCK", block)
        assert repeats.shared_strings(table, np.array(sizes), np.array(ids), memory).tolist() == want

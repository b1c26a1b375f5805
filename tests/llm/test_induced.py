"""Induced sorting against plain sorting of all suffixes."""

import random

import numpy as np
import pytest

from skarn.llm.induced import BLOCK, DEPTH, Scratch, sort_suffixes


def check(raw: bytes, memory: int = 1 << 20) -> None:
    got = list(sort_suffixes(np.frombuffer(raw, np.uint8), memory=memory))
    order = np.concatenate([p for p, _ in got]).tolist() if got else []
    common = np.concatenate([c for _, c in got]).tolist() if got else []
    assert sorted(order) == list(range(len(raw)))
    for i, j, c in zip(order, order[1:], common[1:], strict=False):
        a, b = raw[i : i + DEPTH], raw[j : j + DEPTH]
        assert a <= b, (raw, i, j)
        want = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert c == want, (raw, i, j, c, want)


def test_small_alphabets():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 5, 9, 17, 40, 200, 900]:
        for letters in (b"a", b"ab", b"abc", bytes(range(256))):
            for _ in range(12):
                check(bytes(rng.choice(letters) for _ in range(n)))


def test_repeats_and_runs():
    rng = random.Random(2)
    piece = bytes(rng.choice(b"abcd") for _ in range(150))
    for raw in (b"\0" + b"ab" * 300 + b"\0", b"z" * 500, piece * 5, b"\0".join([piece, piece[10:], piece[:90], b"", piece]) + b"\0", b"mississippi" * 30):
        check(raw)


def test_queues_on_disk():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    raw = b"\0".join(rng.choice(words) for _ in range(1200))
    check(raw, memory=0)
    check(raw, memory=5000)


def test_blocks_come_back_in_order():
    scratch = Scratch(1000)
    queue = scratch.queue()
    for i in range(50):
        queue.push(np.arange(i * 40, i * 40 + 40, dtype=np.int32), np.full(40, i, np.uint8))
    assert scratch.spilled and scratch.held <= 1000
    seen = []
    while queue:
        seen.append(queue.pop()[0])
    assert np.concatenate(seen).tolist() == list(range(2000)) and scratch.held == 0
    assert BLOCK > 2000


@pytest.mark.parametrize("seed", range(3))
def test_random_structure(seed):
    rng = random.Random(seed)
    for _ in range(60):
        base = bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 30)))
        check(b"".join(base[rng.randrange(len(base)) :] for _ in range(rng.randint(1, 20))))

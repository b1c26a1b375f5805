"""Role repair against exhaustive search, and long conversations over many ranges."""

import itertools
import random
from collections import defaultdict

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, place bigint"


def cheapest(roles):
    """Least cost over all role sequences, merges and insertions, by plain search over legal outputs."""
    from skarn.llm.chat import END, MOVES, GUESS, RELABEL, canonical

    best = float("inf")
    for given in itertools.product((1, 2, 3), repeat=len(roles)):
        cost, states = 0.0, {0: 0.0}
        for name, role in zip(roles, given, strict=True):
            seen = canonical(name)
            change = GUESS if seen is None else 0.0 if seen == role else RELABEL
            states = {role: min((c + change + m[0] for s, c in states.items() for m in MOVES[s, role]), default=float("inf"))}
        cost = min(c + END[s][0] for s, c in states.items())
        best = min(best, cost)
    return best


def price(rows):
    from skarn.llm.chat import GUESS, INSERT, MERGE, RELABEL, canonical

    total = 0.0
    for r in rows:
        total += INSERT * (r.action == "insert") + MERGE * ("merge" in r.action)
        if "relabel" in r.action:
            total += GUESS if canonical(r.given) is None else RELABEL
    return total


def legal(rendered):
    roles = [p.split("\n")[0] for p in rendered.split("<|im_start|>")[1:]]
    assert rendered.count("<|im_end|>") == len(roles)
    body = roles[1:] if roles[:1] == ["system"] else roles
    assert body == ["user", "assistant"] * (len(body) // 2) and body


def test_repair_is_cheapest_and_legal(spark):
    from skarn.llm.chat import repair

    rng = random.Random(2)
    names = ["user", "assistant", "system", "human", "GPT", None, "", "tool"]
    convs = {c: [rng.choice(names) for _ in range(rng.randint(1, 6))] for c in range(60)}
    data = [(c, t, role, None if t == 2 else f"text {c}.{t}", 1, 1) for c, roles in convs.items() for t, role in enumerate(roles)]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, SCHEMA)
    results = []
    for ranges, fan in ((1, 2048), (9, 2048), (9, 2)):
        got = defaultdict(list)
        for r in sorted(repair(frame, ranges=ranges, fan=fan).collect(), key=lambda r: (r.conv_id, r.turn, r.piece)):
            got[r.conv_id].append(r)
        assert set(got) == set(convs)
        for c, rows in got.items():
            assert price(rows) == cheapest(convs[c]), (convs[c], rows)
            text = "".join(r.rendered for r in rows)
            legal(text)
            assert all(f"text {c}.{t}" in text for t in range(len(convs[c])) if t != 2)
        results.append({c: "".join(r.rendered for r in rows) for c, rows in got.items()})
    assert results[0] == results[1] == results[2]


def test_one_long_conversation_and_odd_rows(spark):
    from skarn.llm.chat import repair, trace, canonical, START

    rng = random.Random(4)
    roles = [rng.choice(["user", "assistant", "system", None]) for _ in range(500)]
    data = [(7, t, r, "x", 0, 0) for t, r in enumerate(roles)] + [(8, 0, "assistant", "hi", 0, 0)] * 2 + [(None, None, None, None, None, None)]
    got = repair(spark.createDataFrame(data, SCHEMA), ranges=8).collect()
    folded = repair(spark.createDataFrame(data, SCHEMA), ranges=20, fan=3).collect()
    again = sorted((r for r in folded if r.conv_id == 7), key=lambda r: (r.turn, r.piece))
    legal("".join(r.rendered for r in again))
    mine = sorted((r for r in got if r.conv_id == 7), key=lambda r: (r.turn, r.piece))
    legal("".join(r.rendered for r in mine))
    want = trace([canonical(r) for r in roles], START, None)
    from skarn.llm.chat import CHOICE, END, MERGE, _BY_ROLE  # noqa: F401

    cost, state = 0.0, START
    for r, w in zip(roles, want, strict=True):
        cost, state = cost + _BY_ROLE[canonical(r)][state, w], w
    assert price(mine) == price(again) == cost + END[state][0]
    assert sum(r.given is not None or r.action in ("keep", "relabel") for r in got if r.conv_id == 8) == 2
    assert any(r.conv_id is None for r in got)
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0

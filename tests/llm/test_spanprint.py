"""Fingerprints against plain string work."""

import hashlib
import random
from collections import Counter

from .fixtures import docs, rows


def brute(data):
    ordered = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode("utf-32-be")))
    out = []
    for i, (doc_id, text, *_) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
    return out


def test_edited_texts_and_likeness(spark):
    from skarn.llm.spanprint import fingerprinted

    for per_range in (2000, 7):
        got = fingerprinted(docs(spark), rows_per_range=per_range).collect()
        want = brute(rows())
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(w[:3] for w in want)
    by_text = {}
    for r in got:
        text = next(w for w in want if w[0] == r.doc_id and w[1] == r.n_chars and w[2] == r.edited_sha256)
        assert by_text.setdefault(text[3], r.fingerprint) == r.fingerprint
        assert by_text.setdefault(text[4], r.edited_fingerprint) == r.edited_fingerprint
        assert (r.near_edited == 1.0) == (text[3] == text[4])
        assert (r.near_next == 1.0) == (text[3] == text[5])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(text[3]) > 100 and text[3] != text[4]:
            assert 0.5 < r.near_edited < 1
    assert len(set(by_text.values())) == len(by_text)
    assert fingerprinted(docs(spark, [])).count() == 0
    one = fingerprinted(docs(spark, [(None, "abcdef", None, None, None, None, None)])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_spans_and_extensions():
    from skarn.llm.spanprint import Fingerprint, Prefixes, code_points, likeness, parse

    rng = random.Random(5)
    a = "".join(rng.choice("abé\U0001f600") for _ in range(300))
    b = a[40:200] + "x" + a[:90]
    pa_, pb = Prefixes(code_points(a)), Prefixes(code_points(b))
    for _ in range(400):
        i, j, n = rng.randrange(290), rng.randrange(240), rng.randrange(1, 10)
        assert pa_.equal(i, j, n, pb) == (a[i : i + n] == b[j : j + n])
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert pa_.common_extension(i, j, pb) == want
    one, two = Fingerprint(code_points(a)), Fingerprint(code_points(b))
    assert likeness(parse(str(one)), parse(str(two))) == likeness(one, two) > 0.5
    assert likeness(one, Fingerprint(code_points("".join(rng.choice("mnop") for _ in range(300))))) == 0.0

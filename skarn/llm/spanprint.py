"""Document fingerprints from prefix polynomial hashes.

A text of ``n`` code points has two prefix arrays, modulo two 31-bit primes; entry
``i`` is the sum of ``c[j] * base**j`` for ``j < i``.  From them any span's value is
two look-ups, so spans of one or of two texts compare in constant time
(``Prefixes.equal``) and the longest common extension of two positions is a binary
search (``common_extension``).

A fingerprint is text of fixed form: length and whole value, the values of prefixes
and of suffixes at fixed lengths growing by a quarter, and the ``SKETCH`` smallest
mixed values of all distinct spans of ``SPAN`` code points.  The likeness of two
fingerprints is 1 for equal texts, else the larger of the share that common prefix and
suffix cover (each found by binary search over the stated lengths, so up to a fifth
short) and the Dice likeness that the two sketches estimate.

Defined results: a null text is the empty text; two empty texts are equal (1), an empty
one and another have 0; a text shorter than ``SPAN`` has its whole as its only span;
null ids sort last, repeated rows by text; the only row of a table is followed by
itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import above, columns_of, quantiles
from .textops import mix

PRIMES = (2147483647, 2147483629)
BASES = (1103515249, 1566083941)
SPAN = 24
SKETCH = 48
ROWS_PER_RANGE = 2000
MOST_RANGES = 8192
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Lengths of the stated prefixes and suffixes.
LENGTHS = [8]
while LENGTHS[-1] < 1 << 40:
    LENGTHS.append(max(LENGTHS[-1] + 1, LENGTHS[-1] * 5 // 4))
LENGTHS_ARRAY = np.array(LENGTHS, np.int64)


def _powers(n: int) -> list[np.ndarray]:
    """``base**j`` modulo each prime for ``j <= n``, doubled as needed."""
    for k, (base, prime) in enumerate(zip(BASES, PRIMES, strict=True)):
        have = _POWERS[k]
        while len(have) <= n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)])
        _POWERS[k] = have
    return _POWERS


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """The modular prefix arrays of a sequence of code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        values = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for power, prime in zip(_powers(self.n), PRIMES, strict=True):
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values * power[: self.n] % np.uint64(prime), out=total[1:])
            total %= np.uint64(prime)
            self.sums.append(total)

    def values(self, starts: np.ndarray, ends: np.ndarray, limit: int | None = None) -> np.ndarray:
        """Comparable 62-bit values of spans, each moved up to the power ``limit`` (the longest text's length)."""
        limit = self.n if limit is None else limit
        out = np.zeros(len(starts), np.uint64)
        for total, power, prime in zip(self.sums, _powers(limit), PRIMES, strict=True):
            p = np.uint64(prime)
            out = out << np.uint64(31) | (total[ends] + p - total[starts]) % p * power[limit - starts] % p
        return out

    def equal(self, a: int, b: int, size: int, other: Prefixes | None = None) -> bool:
        """Whether the span of ``size`` at ``a`` equals that at ``b`` (of ``other``)."""
        other = other or self
        limit = max(self.n, other.n)
        one = self.values(np.array([a]), np.array([a + size]), limit)
        return bool(one[0] == other.values(np.array([b]), np.array([b + size]), limit)[0])

    def common_extension(self, a: int, b: int, other: Prefixes | None = None) -> int:
        """The longest size for which the spans at ``a`` and ``b`` are equal, by binary search."""
        other = other or self
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            half = (low + high + 1) // 2
            low, high = (half, high) if self.equal(a, b, half, other) else (low, half - 1)
        return low


class Fingerprint:
    """The parts of a fingerprint; ``str`` gives its text form."""

    def __init__(self, points: np.ndarray):
        prefixes = Prefixes(points)
        n = self.n = prefixes.n
        known = LENGTHS_ARRAY[: np.searchsorted(LENGTHS_ARRAY, n, side="right")]
        width = min(SPAN, n)
        spans = n - width + 1 if n else 0
        starts = np.concatenate([[0], np.zeros(len(known), np.int64), n - known, np.arange(spans)])
        ends = np.concatenate([[n], known, np.full(len(known), n), np.arange(spans) + width])
        # A value at its own offset: undo the start by inverse powers so that it doesn't depend on n.
        values = _at_zero(prefixes, starts, ends)
        k = len(known)
        self.whole = int(values[0])
        self.heads, self.tails = _short(values[1 : 1 + k]), _short(values[1 + k : 1 + 2 * k])
        mixed = mix(values[1 + 2 * k :]) >> np.uint64(32)
        if len(mixed) > 4 * SKETCH:
            # The smallest distinct values lie among the smallest few: widen until enough are distinct.
            take = 4 * SKETCH
            while True:
                few = np.unique(np.partition(mixed, take - 1)[:take])
                if len(few) >= SKETCH or take == len(mixed):
                    break
                take = min(len(mixed), take * 8)
            mixed = few
        self.sketch = np.unique(mixed)[:SKETCH].astype(np.uint32)

    def __str__(self) -> str:
        return f"{self.n:x}.{self.whole:016x}.{_hex(self.heads)}.{_hex(self.tails)}.{_hex(self.sketch)}"


_INVERSE: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _at_zero(prefixes: Prefixes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for k, (base, prime) in enumerate(zip(BASES, PRIMES, strict=True)):
        have, p, inverse = _INVERSE[k], np.uint64(prime), pow(base, -1, prime)
        while len(have) <= prefixes.n:
            have = np.concatenate([have, have * np.uint64(pow(inverse, len(have), prime)) % p])
        _INVERSE[k] = have
        total = prefixes.sums[k]
        out = out << np.uint64(31) | (total[ends] + p - total[starts]) % p * have[starts] % p
    return out


def _short(values: np.ndarray) -> np.ndarray:
    return (mix(values) >> np.uint64(32)).astype(np.uint32)


def _hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def parse(text: str) -> Fingerprint:
    """A fingerprint from its text form."""
    n, whole, *rest = text.split(".")
    out = Fingerprint.__new__(Fingerprint)
    out.n, out.whole = int(n, 16), int(whole, 16)
    out.heads, out.tails, out.sketch = (np.frombuffer(bytes.fromhex(x), ">u4").astype(np.uint32) for x in rest)
    return out


def _matched(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest stated prefix (or suffix) that agrees, by binary search."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[half - 1] == b[half - 1] else (low, half - 1)
    return LENGTHS[low - 1] if low else 0


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    ends = min(_matched(a.heads, b.heads) + _matched(a.tails, b.tails), min(a.n, b.n)) / max(a.n, b.n)
    joined = np.union1d(a.sketch, b.sketch)
    if len(a.sketch) == SKETCH or len(b.sketch) == SKETCH:
        joined = joined[:SKETCH]
    both = np.intersect1d(np.intersect1d(joined, a.sketch, True), b.sketch, True)
    j = len(both) / max(1, len(joined))
    return float(min(0.999, max(ends, 2 * j / (1 + j))))


def _order() -> list[Column]:
    return [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]


def ranged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, list]:
    """The rows, and quantiles of the ids as range bounds.

    There are as many ranges as the table has multiples of ``rows_per_range``, up to
    ``MOST_RANGES`` (beyond that ranges get longer, and are sorted on disk); only ids
    are read to find them.  A repeated id lies in one range.
    """
    rows = columns_of(docs, {id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    ranges = min(MOST_RANGES, max(1, -(-rows.select("doc_id").count() // rows_per_range)))
    return rows, quantiles(rows, "doc_id", ranges)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    rows, bounds = ranged(docs, id_col, text_col, rows_per_range)
    # Range 0 has the largest ids; a null id comes after all.
    count = len(bounds) + 1
    number = lambda c: F.when(c.isNull(), F.lit(count)).otherwise(F.lit(count - 1) - above(c, bounds))
    rows = rows.withColumn("part", number(F.col("doc_id")).cast("int"))
    tops = {r["part"]: r["top"] for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    full = sorted(tops)
    before = dict(zip(full, [full[-1], *full[:-1]], strict=True)) if full else {}
    # The first rows of a range are also sent to the range before it (the first range's to the last).
    heads = [(p, tops[p], before[p]) for p in full]
    # ``top`` is null for the rows without an id; the smallest text leads them.
    table = docs.sparkSession.createDataFrame(heads, "part int, top bigint, target int")
    tops_of = rows.join(F.broadcast(table), "part").where(F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = tops_of.groupBy("target", "doc_id").agg(F.min(F.struct(F.col("text").isNotNull(), "text")).alias("x"))
    ahead = firsts.select("doc_id", F.col("x.text").alias("text"), F.col("target").alias("part"), F.lit(1).alias("ahead"))
    rows = rows.select("doc_id", "text", "part", F.lit(0).alias("ahead")).union(ahead)
    dealt = rows.repartition("part").sortWithinPartitions("part", "ahead", *_order())

    def run(batches):
        out: list[tuple] = []
        held = None  # the row before, waiting for its next
        for batch in batches:
            ids, texts, parts, flags = (batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "ahead"))
            for doc_id, text, part, ahead in zip(ids, texts, parts, flags, strict=True):
                points = code_points(text)
                current = (doc_id, points, part, Fingerprint(points))
                if held is not None and held[2] == part:
                    out.append(_row(held, current))
                held = None if ahead else current
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _row(held: tuple, following: tuple) -> tuple:
    doc_id, points, _, print_ = held
    n = len(points)
    third = n // 3
    edited = np.concatenate([points[: n - third], following[1][:third]])
    changed = Fingerprint(edited)
    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, digest, str(print_), str(changed), likeness(print_, changed), likeness(print_, following[3])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

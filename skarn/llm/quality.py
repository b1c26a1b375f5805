"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the UTF-8 bytes of whole texts, block by block.  Trees
are grown on the driver from the statistics (not the texts) of a bounded sample of
labelled rows: columns are cut into at most 64 quantile bins, gradient and curvature
histograms per node pick the split, and every tree is a complete tree of fixed depth
kept in flat arrays, so that prediction is ``depth`` vectorised numpy steps for all
rows at once.

Labels come from at most ``1.5 * per_class`` rows a class (hash-chosen).  Defined
results: a null text is the empty text and gets the score of its statistics; null ids
are scored too; repeated rows repeat; with no labels of either class all scores are
0.5; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, crc_bucket, labelled_sample
from .textops import prefix_hashes, row_sums, span_hashes, text_blocks, tokens

PER_CLASS = 12_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.15, 1.0

#: Fixed byte classes of the statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r",
    "line": b"\n",
    "stop": b".,;:",
    "loud": b"!?",
    "symbol": b"#$%&*@~^|+=",
    "bracket": b"()[]{}<>/\\",
    "quote": b"\"'`-_",
    "wide": bytes(range(128, 256)),
}
NAMES = ["log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "repeated_lines", "line_bytes", "long_words", "byte_entropy", "top_byte", "repeated_triples", *CLASSES]
_MEMBERS = np.zeros((256, len(CLASSES)))
for _i, _members in enumerate(CLASSES.values()):
    _MEMBERS[list(_members), _i] = 1.0


def _distinct(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the count of the most frequent one, per row."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(start, len(k)))
    most = np.zeros(rows)
    np.maximum.at(most, r[start], sizes)
    return np.bincount(r[start], minlength=rows).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics (``NAMES``) for each text of a block."""
    rows, size = len(offsets) - 1, np.diff(offsets).astype(float)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    histogram = np.bincount(row * 256 + data, minlength=rows * 256).reshape(rows, 256).astype(float)
    some = np.maximum(size, 1)
    share = histogram / some[:, None]
    hashes, starts, at = tokens(data, offsets, words=False)
    n = np.diff(at).astype(float)
    words = np.maximum(n, 1)
    distinct, top = _distinct(hashes, at)
    stretch = np.zeros(len(starts))
    if len(starts):
        stretch[:-1] = np.diff(starts)
        stretch[-1] = len(data) - starts[-1]
        last = at[1:][np.diff(at) > 0] - 1
        stretch[last] = offsets[1:][np.diff(at) > 0] - starts[last]
    # Lines: cut after every newline and at the ends of texts.
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    lines_at = np.searchsorted(cuts[:-1], offsets)
    line_hash = span_hashes(prefix_hashes(data), cuts[:-1], cuts[1:]) if len(data) else np.zeros(0, np.uint64)
    lines = np.maximum(np.diff(lines_at), 1)
    triple = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] if len(hashes) > 2 else np.zeros(0, np.uint64)
    ends = np.maximum(at[1:] - 2, at[:-1])
    inner = np.zeros(len(triple), bool)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[:-1], 1)
    np.add.at(edge, ends, -1)
    inner = np.cumsum(edge)[: len(triple)] > 0
    kept = np.concatenate([[0], np.cumsum(inner)]).astype(np.int64)
    triple_at = kept[np.minimum(at, len(triple))]
    triples = np.maximum(np.diff(triple_at), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log(share), 0.0).sum(axis=1)
    columns = [
        np.log1p(size), np.log1p(n), size / words, distinct / words, top / words,
        1.0 - np.where(np.diff(lines_at) > 0, _distinct(line_hash, lines_at)[0], 1) / lines, np.log1p(size / lines),
        row_sums((stretch > 16).astype(float), at) / words, entropy, share.max(axis=1) if rows else size,
        1.0 - np.where(np.diff(triple_at) > 0, _distinct(triple[inner], triple_at)[0], 1) / triples,
    ]
    return np.concatenate([np.stack(columns, axis=1), share @ _MEMBERS], axis=1)


class Trees:
    """Boosted complete trees in flat arrays: ``feature`` and ``cut`` by node, ``value`` by leaf."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature: np.ndarray = np.zeros((0, 2**depth - 1), np.int64)
        self.cut: np.ndarray = np.zeros((0, 2**depth - 1))
        self.value: np.ndarray = np.zeros((0, 2**depth))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost logistic loss with histogram splits."""
    mean = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
    if not 0 < mean < 1:
        return Trees(0.0, depth)
    model = Trees(float(np.log(mean / (1 - mean))), depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    features, width = x.shape[1], bins
    flat = binned + np.arange(features) * width
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, curve = (p - y) * weight, p * (1 - p) * weight
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (features * width) + flat).ravel()
            hist = [np.bincount(slot, np.repeat(v, features), minlength=nodes * features * width).reshape(nodes, features, width) for v in (grad, curve)]
            g, h = (np.cumsum(v, axis=2) for v in hist)
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
            gain = np.where((h > 1.0) & (ht - h > 1.0), gain, 0.0)
            for k in range(nodes):
                best = int(gain[k].argmax())
                f, b = divmod(best, width)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, grad, minlength=2**depth) / (np.bincount(leaf, curve, minlength=2**depth) + RIDGE)
        margin += value[leaf]
        model.feature, model.cut, model.value = np.vstack([model.feature, feature]), np.vstack([model.cut, cut]), np.vstack([model.value, value])
    return model


def fit(docs: DataFrame, labels: DataFrame, fold, per_class: int = PER_CLASS, class_col: str = "quality") -> Trees:
    sample = labelled_sample(docs, labels, class_col, fold, per_class, "quality-sample")

    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    found = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, label string, x array<double>").toArrow().sort_by("doc_id")
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if found.num_rows else np.zeros((0, len(NAMES)))
    y = (np.array(found.column("label").to_pylist()) == "1").astype(float)
    share = {r[0]: r[1] for r in columns_of(labels, {"doc_id": "bigint", class_col: "string"}).where(fold).groupBy(class_col).count().collect()}
    # Rows count as their class does among all labelled rows.
    real = share.get("1", 0) / max(1, share.get("1", 0) + share.get("0", 0))
    weight = np.where(y == 1, real / max(y.mean(), 1e-9), (1 - real) / max(1 - y.mean(), 1e-9)) if len(y) else y
    return grow(x, y, weight)


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.scores(statistics(data, offsets)))], names=["doc_id", "score"])

    return columns_of(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, "doc_id bigint, score double")


def accepted(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text scores at least one half."""

    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            yield rows.filter(pa.array(model.scores(statistics(data, offsets)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id"):
    return F.coalesce(crc_bucket(column, 3) == 1, F.lit(False))

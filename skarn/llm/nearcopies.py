"""Near copies: texts whose word shingles have a Jaccard similarity of at least ``SIMILAR``.

1. The SimHash of the shingles, repeats included, is a text's fingerprint.  Fingerprints
   within ``MAX_BITS`` bits meet in pigeonhole blocks and are linked (``simhash.links``):
   no such pair is lost.
2. A similarity of 0.8 often means more bits than blocks of useful length can differ in.
   Texts that share one of ``BANDS`` keys of ``ROWS`` MinHash values each are linked to
   the key's least text as well.  A pair at the bound shares no key with a probability of
   ``(1 - SIMILAR ** ROWS) ** BANDS`` (6e-5), a more similar one with less.
3. Loose components of both kinds of links hold every such pair.  The texts of a component meet
   in cells of two tiles of at most about ``TILE`` shingles, where whole shingle sets are
   compared exactly; a cell gives a spanning forest of its links only.
4. Components of the verified links, by star contraction, are the classes.

Texts of equal words collapse first.  Words are runs of non-blank bytes, ASCII case
folded.  A text of fewer words than a shingle is one shingle, so is a text without
words; a null text is the empty text.  Rows without an id are in no class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, discard, join_hot, written
from .simhash import MAX_BITS, components, kept_rows, links
from .textops import mix, text_blocks, tokens

SHINGLE_WORDS = 5
SIMILAR = 0.8
ROWS, BANDS = 6, 32
TILE = 1 << 17
_RNG = np.random.default_rng(5)
_TIMES = _RNG.integers(0, 1 << 31, ROWS * BANDS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, ROWS * BANDS, np.uint32)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the shingles, row offsets into them, keys of the rows' words)."""
    hashes, _, at = tokens(data, offsets, words=False)
    size = np.maximum(np.diff(at) - SHINGLE_WORDS + 1, 1)
    out_at = np.concatenate([[0], np.cumsum(size)])
    first = np.repeat(at[:-1], size) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], size)
    stop = np.repeat(at[1:], size)
    padded = np.append(hashes, np.zeros(SHINGLE_WORDS, np.uint64))
    out = np.zeros(len(first), np.uint64)
    for i in range(SHINGLE_WORDS):
        out = out * _FOLD + np.where(first + i < stop, padded[first + i], np.uint64(0))
    raw, ends = hashes.tobytes(), (at * 8).tolist()
    keys = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)), np.uint64, len(ends) - 1)
    return mix(out), out_at, keys


def fingerprints(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SimHash of every row of shingles, repeats included: a bit is 1 if set in over half of them."""
    size, out = np.diff(at), np.zeros(len(at) - 1, np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((values >> np.uint64(bit)) & np.uint64(1), at[:-1])
        out |= (ones.astype(np.int64) * 2 > size).astype(np.uint64) << np.uint64(bit)
    return out


def bands(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The band keys (row by band) of rows of shingles."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at) - 1, b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key * _FOLD + np.minimum.reduceat(short * _TIMES[k] + _PLUS[k], at[:-1]))
        out[:, b] = key
    return out


def _forest(sets: list[np.ndarray], split: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links of similar sets: those across ``split``, or all if it is 0."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    mark = np.zeros(int(flat.max()) + 1, bool)
    root, out = np.arange(n), []
    for i in range(split or n):
        rest = np.arange(n) > (split - 1 if split else i)
        # Sets as large as the bound allows that are not in the class yet.
        rest &= (root != root[i]) & (np.minimum(size, size[i]) >= SIMILAR * np.maximum(size, size[i]))
        if not rest.any():
            continue
        own = flat[at[i] : at[i + 1]]
        mark[own] = True
        use = rest[owner]
        both = np.bincount(owner[use], mark[flat[use]], minlength=n)
        mark[own] = False
        for j in np.flatnonzero(rest & (both >= SIMILAR * (size + size[i] - both) - 1e-9)).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _links(cells: pa.Table):
    """The links of the cells, which are whole and sorted."""
    root, a, b, own = (cells.column(c).to_numpy() for c in ("root", "a", "b", "own"))
    key = cells.column("key").to_numpy()
    cuts = np.flatnonzero((root[1:] != root[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    us, vs = [], []
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(root)], strict=True):
        split = int(np.searchsorted(own[x:y], b[x])) if a[x] != b[x] else 0
        if a[x] != b[x] and split in (0, y - x):
            continue
        sets = [np.frombuffer(s, np.uint64) for s in cells.column("grams").slice(x, y - x).to_pylist()]
        for i, j in _forest(sets, split):
            us.append(key[x + i])
            vs.append(key[x + j])
    yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def verified(batches):
    """Links of the cells of a partition, a cell held at a time."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if not held.num_rows:
            continue
        last = np.ones(held.num_rows, bool)
        for c in ("root", "a", "b"):
            column = held.column(c).to_numpy()
            last &= column == column[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield from _links(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from _links(held)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, component_id): the least id of every distinct text, and the least id of its class."""
    rows = columns_of(docs, {id_col: "bigint", text_col: "string"}).toDF("doc_id", "text").where("doc_id is not null")

    def sign(batches):
        for part, data, offsets in text_blocks(batches):
            values, at, keys = shingles(data, offsets)
            marks = bands(values, at).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * BANDS), pa.array(marks.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys.view(np.int64)), pa.array(np.diff(at)), pa.array(fingerprints(values, at).view(np.int64)), lists], names=["doc_id", "key", "size", "fp", "bands"])

    signed = written(rows.mapInArrow(sign, "doc_id bigint, key bigint, size bigint, fp bigint, bands array<bigint>"), "copies-signed")
    nodes = written(signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.max("fp").alias("fp"), F.max("bands").alias("bands")), "copies-nodes", drop_shuffles=True)
    discard(signed)
    # Texts of one fingerprint are linked to the least of them, which stands for it in the pigeonhole blocks.
    marked = written(nodes.groupBy("fp").agg(F.min("key").alias("node"), F.count("*").alias("n")), "copies-marked", drop_shuffles=True)
    alike = join_hot(nodes.select("fp", F.col("key").alias("u")), marked.where("n > 1").drop("n"), "fp", total=nodes.count()).where("u <> node").select("u", F.col("node").alias("v"))
    alike = written(alike.union(links(marked.select("fp", "node"), max_bits)), "copies-alike", drop_shuffles=True)
    keyed = nodes.select(F.explode("bands").alias("band"), "key")
    heads = keyed.groupBy("band").agg(F.min("key").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    loose = components(alike.union(keyed.join(heads, "band").where("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v"))))
    loose = loose.union(loose.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "key")
    held = written(loose.join(nodes.select("key", "doc_id", "size"), "key"), "copies-loose", drop_shuffles=True)
    discard(marked, alike)
    tiles = held.groupBy("root").agg(F.ceil(F.sum("size") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = held.join(tiles, "root").select("doc_id", F.col("key").alias("wanted"), "root", "tiles")

    def grams(batches):
        for part, data, offsets in text_blocks(batches):
            values, at, keys = shingles(data, offsets)
            same = np.flatnonzero(keys.view(np.int64) == part.column("wanted").to_numpy())
            sets = [np.unique(values[at[i] : at[i + 1]]).tobytes() for i in same.tolist()]
            part = part.take(pa.array(same))
            yield pa.RecordBatch.from_arrays([part.column("root"), part.column("tiles"), part.column("wanted"), pa.array(sets, pa.binary())], names=["root", "tiles", "key", "grams"])

    full = rows.join(dealt, "doc_id").select("text", "wanted", "root", "tiles").mapInArrow(grams, "root bigint, tiles int, key bigint, grams binary")
    # A component of k tiles: a text of tile t meets tiles 0..k-1 in the cells (min, max).
    full = full.withColumn("own", F.pmod(F.xxhash64(F.lit("tile"), "key"), F.col("tiles")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cell = full.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "key", "grams")
    cell = cell.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "own", "key")
    roots = components(cell.mapInArrow(verified, "u bigint, v bigint"))
    found = nodes.select("key", "doc_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    found = written(found.select("doc_id", "root"), "copies-classes", drop_shuffles=True)
    discard(nodes, held)
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose id is the smallest of their class; rows without an id stay."""
    found = classes(docs, id_col, text_col)
    return kept_rows(docs, found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct(), id_col)

"""SimHash near-duplicate classes by pigeonhole blocks.

Fingerprints within ``max_bits`` differing bits that are cut into ``blocks`` blocks
agree on at least ``blocks - max_bits`` of them; every choice of that many blocks is
a join key, and fingerprints that meet on a key are verified.  More blocks mean more
keys, each of more bits, so the number of blocks follows the number of distinct
fingerprints and the candidates per fingerprint stay bounded as a table grows.

Equal fingerprints collapse before the join.  A key that many distinct fingerprints
share is cut into tiles; a tile is compared as one numpy block and gives only a
spanning forest of its links, so no group's pairs are ever emitted, and no group is
held whole by one task.  Components come from rounds of star contraction with a
written table between them.

Defined results: texts without words have fingerprint zero and link like any other;
a null text is the empty text; a null id keeps its fingerprint and takes the
component of that fingerprint's rows, null if they have no id; repeated rows repeat
in the result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import HOT_KEYS, columns_of, discard, free_names, join_hot, written
from .textops import text_blocks

SHINGLE_WORDS = 4
MAX_BITS = 4
TILE = 2048
SEED = 42


def fingerprint(raw: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's bytes over word shingles, repeats included."""
    words = raw.lower().split()  # ASCII case and ASCII blanks only
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle_words + 1].tolist()
    spans = map(joined.__getitem__, map(slice, starts, ends[shingle_words - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed bigint."""

    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            raw, at = data.tobytes(), offsets.tolist()
            fps = np.fromiter((fingerprint(raw[a:b]) for a, b in zip(at, at[1:], strict=False)), np.uint64, len(at) - 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return columns_of(docs, {id_col: "bigint", text_col: "string"}).toDF("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def key_blocks(distinct: int, max_bits: int = MAX_BITS) -> int:
    """The fewest blocks whose keys keep the expected candidates of a fingerprint under about one."""
    for blocks in range(max_bits + 2, 17):
        keys = len(list(combinations(range(blocks), blocks - max_bits)))
        if distinct * keys <= 2 ** (64 * (blocks - max_bits) // blocks):
            return blocks
    return 16


def _bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _forest(fps: np.ndarray, other: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the links within a tile or between two."""
    n = len(fps)
    rows = fps if other is None else np.concatenate([fps, other])
    root = np.arange(len(rows))
    us, vs = [], []
    for i in range(n):
        first = i + 1 if other is None else n
        near = first + np.flatnonzero((root[first:] != root[i]) & (np.bitwise_count(rows[first:] ^ rows[i]) <= max_bits))
        if len(near):
            # One link to each tree that is near.
            trees, at = np.unique(root[near], return_index=True)
            us += [i] * len(at)
            vs += near[at].tolist()
            root[np.isin(root, trees)] = root[i]
    return np.array(us, np.int64), np.array(vs, np.int64)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints that span the same classes as all links do.

    ``nodes``: (fp, node), one row per fingerprint.  Every link within ``max_bits`` joins
    two nodes that the result connects.
    """
    blocks = blocks or key_blocks(nodes.count(), max_bits)
    bounds = _bounds(blocks)
    chosen = list(combinations(range(blocks), blocks - max_bits))

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, node = batch.column("fp").to_numpy().view(np.uint64), batch.column("node")
            for number, choice in enumerate(chosen):
                key = np.zeros(len(fp), np.uint64)
                for b in choice:
                    low, width = bounds[b]
                    key = (key << np.uint64(width)) | ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), number, np.int16)), pa.array(key.view(np.int64)), batch.column("fp"), node], names=["choice", "bits", "fp", "node"])

    rows = nodes.select("fp", "node").mapInArrow(keyed, "choice smallint, bits bigint, fp bigint, node bigint")
    rows = _sized(rows, tile)
    # A key of k tiles: a row of tile t meets tiles 0..k-1 in the cells (min, max).
    tiles = F.ceil(F.col("count") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64(F.lit("tile"), "fp"), F.col("tiles")).cast("int")
    rows = rows.withColumn("tiles", tiles).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))))
    cell = rows.select("choice", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp", "node")
    cell = cell.repartition("choice", "bits", "a", "b").sortWithinPartitions("choice", "bits", "a", "b", "own", "fp")

    def pairs(batches):
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            cut = _last_group(held)
            if cut:
                yield from _compare(held.slice(0, cut), max_bits)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from _compare(held, max_bits)

    return cell.mapInArrow(pairs, "u bigint, v bigint").where("u <> v").distinct()


def _sized(rows: DataFrame, tile: int) -> DataFrame:
    """The rows whose key others share, with the ``count`` of rows of their key.

    Counts combine before the shuffle.  Keys of more than ``tile`` rows, or of more than
    one in ``HOT_KEYS``, get their count by a broadcast (fewer than ``HOT_KEYS`` keys are
    that crowded), so that no task gathers them before they are cut into tiles.
    """
    keys = ["choice", "bits"]
    sizes = written(rows.groupBy(*keys).count().where("count > 1"), "simhash-keys", drop_shuffles=True)
    least = max(tile, (sizes.agg(F.sum("count")).first()[0] or 0) // HOT_KEYS)
    crowded = F.broadcast(sizes.where(F.col("count") > least))
    return rows.join(crowded, keys).unionByName(rows.join(crowded, keys, "left_anti").join(sizes.where(F.col("count") <= least), keys))


def _group_columns(rows: pa.Table) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in ("choice", "bits", "a", "b")]


def _last_group(rows: pa.Table) -> int:
    """Where the last, perhaps unfinished group starts."""
    same = np.ones(rows.num_rows, bool)
    for c in _group_columns(rows):
        same &= c == c[-1]
    apart = np.flatnonzero(~same)
    return int(apart[-1]) + 1 if len(apart) else 0


def _compare(rows: pa.Table, max_bits: int):
    columns = _group_columns(rows)
    fp, node, own = rows.column("fp").to_numpy().view(np.uint64), rows.column("node").to_numpy(), rows.column("own").to_numpy()
    change = np.zeros(len(fp), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    change[0] = True
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, len(fp)))
    small = np.repeat(sizes <= 16, sizes)
    group = np.cumsum(change)
    us, vs = [], []
    for step in range(1, 16):
        at = np.flatnonzero(small[step:] & (group[step:] == group[:-step]))
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= max_bits]
        us.append(node[near])
        vs.append(node[near + step])
    for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        part, nodes = fp[s : s + n], node[s : s + n]
        split = int(np.searchsorted(own[s : s + n], own[s], side="right"))
        x, y = _forest(part[:split], part[split:], max_bits) if split < n and columns[2][s] != columns[3][s] else _forest(part, None, max_bits)
        us.append(nodes[x])
        vs.append(nodes[y])
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges reaches.

    Each round hangs all neighbours of a node, and the node, on the least of them
    (large-star and small-star in turn), with aggregates and joins only, and stops when
    the edges no longer change.  A table of edges goes, and the shuffles of its write, as
    soon as the next one stands.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc", drop_shuffles=True)
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "cc", drop_shuffles=True)
        discard(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "cc", drop_shuffles=True)
        discard(large)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): the fingerprint and the class of every row."""
    fps = written(fingerprints(docs, id_col, text_col), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    edges = written(links(nodes.where("node is not null"), max_bits, tile, blocks), "simhash-links")
    roots = components(edges)
    classes = nodes.join(roots, "node", "left").select(F.col("fp").alias("fp"), F.coalesce("root", "node").alias("component_id"))
    return join_hot(fps, classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose id is the smallest of their class; rows without an id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    return kept_rows(docs, found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct(), id_col)


def kept_rows(docs: DataFrame, keep: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with the ids of ``keep``, and those without an id.

    Rows that repeat such an id are one document: the least of them by content stays.
    """
    keep = written(keep, "simhash-kept", drop_shuffles=True)
    names = docs.columns
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    (place,) = free_names(docs, "place")
    kept = docs.join(keep, id_col, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in names]).union(docs.where(F.col(id_col).isNull()))


def hex_digits(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))

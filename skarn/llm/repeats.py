"""Removal of repeated byte strings across documents with sharded suffix arrays.

Every ``LENGTH``-byte string holds one anchor: the position of the least 20-byte gram
hash within it (leftmost of equals), so equal strings choose equal anchors.  The
anchored suffixes, about one in sixteen, stand for all suffixes, and an anchor's hash
says in which shard its suffixes are sorted:

1. Tuples (anchor, hash of the context, document) of a shard are sorted.  A context is
   the bytes from 30 before to 50 after the anchor, as far as the text goes: equal ones
   share all their strings, so all but those of the smallest document go.
2. Of an anchor with several contexts in several documents one representative of each
   context goes on.  The suffixes of a shard's representatives are sorted by external
   induced sorting (``induced``): queues on disk carry the suffixes and their common
   prefixes, and neighbours that share ``LENGTH`` bytes are one string; those that don't
   start in its smallest document go.

Tuples, contexts and texts move as packed binary blocks, keyed by anchor shard or by
document group; shard and group sizes are fixed numbers of bytes, so their counts
follow the input, and nothing is gathered beyond one of them.  Within eight
megabytes of the scan, copies of a context collapse to one tuple before the shuffle.

Defined results: a null text is the empty text; texts shorter than ``LENGTH`` keep all
bytes; a null id counts as larger than every id and equal to other null ids; rows with
the same id don't remove each other's bytes; an empty table gives an empty table;
other columns are ignored.  Anchors and contexts are told apart by 48 bits of their
hashes within a shard; the induced order compares bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, small_batches, written
from .induced import MEMORY, sort_suffixes
from .textops import blocks, mix, prefix_hashes, release, span_hashes, text_buffers, window_min

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM
CONTEXT = REACH + LENGTH
SHARD_BYTES = 8 << 20  # of text for each anchor shard
PART_BYTES = 8 << 20  # of text whose tuples are combined before the shuffle
GROUP_BYTES = 2 << 20  # of text for each group of documents
SORT_BYTES = 1 << 20  # of contexts for each induced sort
NO_ID = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(positions, rows, anchor hashes, context hashes, context starts and ends) of a block."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hashes(prefix, at, at + GRAM)
    bits = np.uint64((1 << max(21, len(data).bit_length())) - 1)
    least = window_min((grams & ~bits) | at.astype(np.uint64), REACH + 1)
    whole = np.ones(len(least) + 1, np.int64)
    # No string may cross the end of a text: starts within LENGTH - 1 of an end don't count.
    crossing = np.zeros(len(data) + 1, np.int64)
    ends = offsets[1:]
    np.add.at(crossing, np.maximum(ends - (LENGTH - 1), offsets[:-1]), 1)
    np.add.at(crossing, ends, -1)
    whole = np.cumsum(crossing)[: len(least)] == 0
    chosen = (least[whole] & bits).astype(np.int64)
    position = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen
    row = np.searchsorted(offsets, position, side="right") - 1
    start = np.maximum(position - REACH, offsets[row])
    end = np.minimum(position + LENGTH, offsets[row + 1])
    context = mix(span_hashes(prefix, start, end) + (position - start).astype(np.uint64)) >> np.uint64(16)
    return position, row, grams[position] >> np.uint64(16), context, start, end


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of little-endian integers, byte plane by byte plane (equal bytes lie together for the codec)."""
    return b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width]).tobytes() for c, width in columns)


def _unpack(raw: bytes, *widths: int) -> list[np.ndarray]:
    n = len(raw) // sum(widths)
    flat, at, out = np.frombuffer(raw, np.uint8), 0, []
    for width in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = flat[at : at + n * width].reshape(width, n).T
        out.append(wide.reshape(-1).view("<u8"))
        at += n * width
    return out


def _joined(blobs: list[bytes], *widths: int) -> list[np.ndarray]:
    parts = [_unpack(b, *widths) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(len(widths))]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NO_ID).to_numpy()


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) + np.uint64(77)) % np.uint64(groups)).astype(np.int64)


def _pair(ids: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + context)


def _cuts(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def _parts(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """Slices of a batch of about ``PART_BYTES`` of text: what the tuples of one take stays small."""
    _, offsets = text_buffers(batch.column("text"))
    return [batch.slice(a, b - a) for a, b in blocks(offsets, PART_BYTES)]


def _batch_tuples(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, context, id, whether it is the part's least id for the context), sorted by id."""
    ids = _ids(batch)
    data, offsets = text_buffers(batch.column("text"))
    parts = []
    for a, b in blocks(offsets):
        _, row, anchor, context, _, _ = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append((anchor, context, ids[a:b][row]))
    anchor, context, doc = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    key = mix(anchor * np.uint64(0x9E3779B97F4A7C15) + context)
    order = np.lexsort((doc, key))
    anchor, context, doc, key = anchor[order], context[order], doc[order], key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])  # a text's repeats of a context count once
    anchor, context, doc, key = anchor[fresh], context[fresh], doc[fresh], key[fresh]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    order = np.argsort(doc, kind="stable")
    return anchor[order], context[order], doc[order], first[order]


def _rows(key: np.ndarray, kind: int, *columns: tuple[np.ndarray, int]) -> list[tuple[int, int, bytes]]:
    """(key, kind, packed columns) for every run of a key, after sorting all by it once."""
    order = np.argsort(key, kind="stable")
    cuts = _cuts(key[order])
    ordered = [(c[order], width) for c, width in columns]
    keys = key[order[cuts[:-1]]].tolist() if len(key) else []
    return [(k, kind, _pack(*[(c[a:b], width) for c, width in ordered])) for k, a, b in zip(keys, cuts.tolist(), cuts[1:].tolist(), strict=False)]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    key, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["key", "kind", "blob"])


def shared_strings(contexts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """For each context (row of bytes) the starts, as bits, of strings that start in a smaller document too.

    The suffix array of all contexts, each closed by a zero byte, comes in blocks; a run
    of neighbours with common prefixes of at least ``LENGTH`` is one string.
    """
    width = CONTEXT + 1
    text = np.zeros((len(contexts), width), np.uint8)
    text[:, :CONTEXT] = contexts
    mask = np.zeros(len(contexts), np.int64)
    largest = np.iinfo(np.int64).max

    def settle(positions: np.ndarray, starts: np.ndarray) -> None:
        owner, start = np.divmod(positions, width)
        whole = start + LENGTH <= sizes[owner]
        least = np.minimum.reduceat(np.where(whole, docs[owner], largest), starts)
        gone = whole & (docs[owner] > np.repeat(least, np.diff(np.append(starts, len(positions)))))
        np.add.at(mask, owner[gone], np.int64(1) << start[gone])

    held = np.zeros(0, np.int64)  # the last run so far, which the next block may go on with
    for positions, common in sort_suffixes(text.reshape(-1), memory=memory):
        joined = np.concatenate([held, positions.astype(np.int64)])
        fresh = np.concatenate([np.zeros(len(held), bool), common < LENGTH])
        fresh[0] = True
        starts = np.flatnonzero(fresh)
        settle(joined[: starts[-1]], starts[:-1]) if len(starts) > 1 else None
        held = joined[starts[-1] :]
    if len(held):
        settle(held, np.zeros(1, np.int64))
    return mask


SCHEMA = "key bigint, kind int, blob binary"
TEXTS, GONE, FINE, MASKED, TUPLES = range(5)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (array of removed byte ranges, end exclusive) and kept (binary) of every row."""
    rows = columns_of(docs, {id_col: "bigint", text_col: "string"}).toDF("doc_id", "text")
    spark = docs.sparkSession
    small_batches(spark)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, groups = max(least, -(-total // shard_bytes)), max(least, -(-total // group_bytes))

    def tuples(batches):
        for batch in batches:
            for part in _parts(batch):
                anchor, context, doc, first = _batch_tuples(part)
                a, c, d = anchor[first], context[first], doc[first]
                yield _batch(_rows((mix(a) % np.uint64(shards)).astype(np.int64), TUPLES, (a, 6), (c, 6), (d, 8)))
                # The other tuples have a smaller owner in the same part already.
                c, d = context[~first], doc[~first]
                yield _batch(_rows(_group(d, groups), GONE, (d, 8), (c, 6)))
            release()

    def sort_shard(block: pa.Table) -> pa.Table:
        anchor, context, doc = _joined(block.column("blob").to_pylist(), 6, 6, 8)
        doc = doc.view(np.int64)
        key = mix(anchor * np.uint64(0x9E3779B97F4A7C15) + context)
        order = np.argsort(key)
        same = _cuts(key[order])
        del key
        doc, context = doc[order], context[order]
        owner = np.minimum.reduceat(doc, same[:-1]) if len(doc) else doc
        gone = doc > np.repeat(owner, np.diff(same))
        d, c = doc[gone], context[gone]
        out = _rows(_group(d, groups), GONE, (d, 8), (c, 6))
        # One representative of each context: its anchor, its smallest document.
        anchor, context = anchor[order[same[:-1]]], context[same[:-1]]
        order = np.argsort(anchor)
        by_anchor = _cuts(anchor[order])
        if len(anchor):
            owner, context = owner[order], context[order]
            low, high = np.minimum.reduceat(owner, by_anchor[:-1]), np.maximum.reduceat(owner, by_anchor[:-1])
            fine = np.repeat(low != high, np.diff(by_anchor))
            d, c = owner[fine], context[fine]
            out += _rows(_group(d, groups), FINE, (d, 8), (c, 6))
        release()
        return pa.Table.from_batches([_batch(out)])

    def packed_texts(batches):
        for batch in batches:
            ids = _ids(batch)
            data, offsets = text_buffers(batch.column("text"))
            sizes = np.diff(offsets)

            group = _group(ids, groups)
            order = np.argsort(group, kind="stable")
            cuts, out = _cuts(group[order]), []
            for a, b in zip(cuts, cuts[1:], strict=False):
                i = order[a:b]
                text = b"".join(data[offsets[j] : offsets[j + 1]].tobytes() for j in i.tolist())
                packed = pa.compress(text, codec="zstd", asbytes=True) if text else b""
                out.append((int(group[i[0]]), TEXTS, len(i).to_bytes(8, "little") + _pack((ids[i], 8), (sizes[i], 8)) + packed))
            yield _batch(out)

    def unpacked(block: pa.Table):
        """(ids, data, offsets) of the group's texts, and the blobs of the other kinds."""
        kinds, blobs = block.column("kind").to_pylist(), block.column("blob").to_pylist()
        ids, sizes, parts = [], [], []
        for blob in (b for k, b in zip(kinds, blobs, strict=True) if k == TEXTS):
            n = int.from_bytes(blob[:8], "little")
            i, s = _unpack(blob[8 : 8 + 16 * n], 8, 8)
            ids.append(i.view(np.int64))
            sizes.append(s.astype(np.int64))
            if s.sum():
                parts.append(pa.decompress(blob[8 + 16 * n :], decompressed_size=int(s.sum()), codec="zstd", asbytes=True))
        data = np.frombuffer(b"".join(parts), np.uint8)
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64) if sizes else np.zeros(1, np.int64)
        of = lambda kind: [b for k, b in zip(kinds, blobs, strict=True) if k == kind]
        return ids, data, offsets, of

    def contexts(block: pa.Table) -> pa.Table:
        ids, data, offsets, of = unpacked(block)
        doc, context = _joined(of(FINE), 8, 6)
        wanted = np.unique(_pair(doc.view(np.int64), context))
        out = []
        if len(wanted):
            for a, b in blocks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                _, row, anchor, context, start, end = anchors(part, at)
                key = _pair(ids[a:b][row], context)
                found = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
                _, once = np.unique(key[found], return_index=True)
                found = found[once]
                near = np.minimum(start[found, None] + np.arange(CONTEXT), len(part) - 1)
                text = np.where(start[found, None] + np.arange(CONTEXT) < end[found, None], part[near] if len(found) else 0, 0).astype(np.uint8)
                shard = (mix(anchor[found]) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = _cuts(shard[order])
                for x, y in zip(cuts, cuts[1:], strict=False):
                    f = found[order[x:y]]
                    head = _pack((anchor[f], 6), (context[f], 6), (ids[a:b][row[f]], 8), (end[f] - start[f], 1))
                    out.append((int(shard[order[x]]), 0, head + text[order[x:y]].tobytes()))
        release()
        return pa.Table.from_batches([_batch(out)])

    def resolve(block: pa.Table) -> pa.Table:
        heads, texts = [], []
        for blob in block.column("blob").to_pylist():
            n = len(blob) // (21 + CONTEXT)
            heads.append(blob[: 21 * n])
            texts.append(np.frombuffer(blob, np.uint8, offset=21 * n).reshape(n, CONTEXT))
        anchor, context, doc, size = _joined(heads, 6, 6, 8, 1)
        order = np.argsort(anchor, kind="stable")
        text, doc, size = np.concatenate(texts)[order], doc.view(np.int64)[order], size.astype(np.int64)[order]
        anchor, context = anchor[order], context[order]
        mask = np.zeros(len(text), np.int64)
        cuts, first = _cuts(anchor), 0
        for last in cuts[1:].tolist():
            # Whole anchors up to about SORT_BYTES of text; a larger anchor is sorted alone, its queues on disk.
            if (last - first) * (CONTEXT + 1) >= SORT_BYTES or last == len(text):
                mask[first:last] = shared_strings(text[first:last], size[first:last], doc[first:last])
                first = last
        some = np.flatnonzero(mask)
        d, c, m = doc[some], context[some], mask[some]
        release()
        return pa.Table.from_batches([_batch(_rows(_group(d, groups), MASKED, (d, 8), (c, 6), (m, 4)))])

    def remove(block: pa.Table) -> pa.Table:
        ids, data, offsets, of = unpacked(block)
        doc, context = _joined(of(GONE), 8, 6)
        gone = np.unique(_pair(doc.view(np.int64), context))
        doc, context, mask = _joined(of(MASKED), 8, 6, 4)
        masked = _pair(doc.view(np.int64), context)
        order = np.argsort(masked)
        masked, mask = masked[order], mask[order].astype(np.int64)
        columns: list[list] = [[], [], [], []]
        for a, b in blocks(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            _, row, _, context, start, end = anchors(part, at)
            key = _pair(ids[a:b][row], context)
            change = np.zeros(len(part) + 1, np.int64)
            if len(gone):
                hit = gone[np.minimum(np.searchsorted(gone, key), len(gone) - 1)] == key
                np.add.at(change, start[hit], 1)
                np.add.at(change, end[hit], -1)
            if len(masked):
                i = np.minimum(np.searchsorted(masked, key), len(masked) - 1)
                found = np.flatnonzero(masked[i] == key)
                for ahead in range(REACH + 1):
                    first = start[found[mask[i[found]] >> ahead & 1 == 1]] + ahead
                    np.add.at(change, first, 1)
                    np.add.at(change, first + LENGTH, -1)
            covered = np.cumsum(change)[:-1] > 0
            edge = np.zeros(len(part) + 1, bool)
            edge[at] = True
            begins = np.flatnonzero(covered & (~np.concatenate([[False], covered[:-1]]) | edge[:-1]))
            stops = np.flatnonzero(covered & (~np.concatenate([covered[1:], [False]]) | edge[1:])) + 1
            kept = part[~covered].tobytes()
            kept_at = np.concatenate([[0], np.cumsum(~covered)])[at].tolist()
            spans_at = np.searchsorted(begins, at)
            owner = np.repeat(at[:-1], np.diff(spans_at))
            spans = pa.StructArray.from_arrays([pa.array((begins - owner).astype(np.int64)), pa.array((stops - owner).astype(np.int64))], ["start", "end"])
            columns[0].append(pa.array([None if x == NO_ID else x for x in ids[a:b].tolist()], pa.int64()))
            columns[1].append(pa.array(np.diff(at)))
            columns[2].append(pa.ListArray.from_arrays(pa.array(spans_at.astype(np.int32)), spans))
            columns[3].append(pa.array([kept[x:y] for x, y in zip(kept_at, kept_at[1:], strict=False)], pa.binary()))
        release()
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.Table.from_arrays([pa.chunked_array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])

    scanned = written(rows.mapInArrow(tuples, SCHEMA), "repeats-tuples")
    sharded = scanned.where(F.col("kind") == TUPLES).groupBy("key").applyInArrow(sort_shard, SCHEMA)
    answers = written(sharded.union(scanned.where(F.col("kind") == GONE)), "repeats-answers")
    texts = rows.mapInArrow(packed_texts, SCHEMA)
    fine = texts.union(answers.where(F.col("kind") == FINE)).groupBy("key").applyInArrow(contexts, SCHEMA)
    masks = written(fine.groupBy("key").applyInArrow(resolve, SCHEMA), "repeats-masks")
    told = texts.union(answers.where(F.col("kind") == GONE)).union(masks)
    return told.groupBy("key").applyInArrow(remove, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

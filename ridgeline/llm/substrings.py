"""Removal of repeated byte strings across documents, by backward extension on Burrows-Wheeler transforms.

A byte goes if a string of ``least`` bytes that covers it also starts in a document with a smaller id.

1. Every window of ``least`` bytes has an anchor: its ``SEED``-byte string with the smallest hash. Equal windows have
   equal anchors, so they can be brought together by it. Blocks of documents send the hashes of their anchors, and hear
   which of them occur in more than one document.
2. Consecutive windows with the same anchor are one segment. Segments with shared anchors go, once for each block, to
   the group of their anchor, with the smallest document id that holds them.
3. There the Burrows-Wheeler transform of the segments that share an anchor is made, and the longest common prefixes of
   neighbouring suffixes are derived from it breadth first, by increasing value: a boundary of value v in the transform
   gives, one step backward, the boundaries of value v + 1. The expansion stops at ``least``: suffixes between which no
   boundary has come up by then share a string that long. Each window so gets the smallest document id that has it.
4. The blocks hear of windows that start in a smaller document than any of their own, and cut their texts.

What a group holds grows with the blocks, not with the copies of a passage, and the number of groups with the input.

Odd cases: a null text is an empty one; texts shorter than ``least`` lose nothing; equal ids are one document; a null id
counts as larger than all others; matches never cross documents; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_schema, bundled, joined_bytes, kept, mix64, record, stored_by, text_bytes, unbundled

SEED = 24
BLOCK_BYTES = 8 << 20
#: Segments are transformed in batches of about so many bytes.
BATCH_BYTES = 1 << 20
CHUNK = 2 << 20
NO_DOC = np.iinfo(np.int64).max
_PRIME = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(50).integers(1, 1 << 64, 256, dtype=np.uint64)


def _power(e: int) -> np.uint64:
    return np.uint64(pow(_PRIME, e, 1 << 64))


class Windows:
    """The segments of a chunk of texts: runs of windows with the same anchor, in one document each."""

    def __init__(self, texts: list[bytes], least: int):
        self.data, self.ends = joined_bytes(texts)
        n = len(self.data)
        hashes = {1: _BYTES[self.data]}
        for k in (2, 4, 8, 16, 32):
            h = hashes[k // 2]
            hashes[k] = h[: max(0, len(h) - k // 2)] * _power(k // 2) + h[k // 2 :]
        self.hashes = hashes
        span = least - SEED + 1
        # places near the end of a text have seeds of two texts, but no window holds these
        seed = mix64(self.everywhere(SEED))
        # hash first, then place: the smallest is the leftmost of the smallest hashes
        bits = np.uint64(max(1, n).bit_length())
        low = (seed >> bits << bits) | np.arange(len(seed), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: width - span], low[span - width :])
        last = np.repeat(self.ends[1:], np.diff(self.ends))[: len(low)]
        start = np.flatnonzero(np.arange(least, least + len(low)) <= last)
        anchor = (low[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)  # windows of two texts do not adjoin
        first = np.flatnonzero(new)
        self.start = start[first]
        self.run = np.diff(np.append(first, len(start)))
        self.doc = np.searchsorted(self.ends, self.start, "right") - 1
        self.key = (seed[anchor[first]] >> np.uint64(16)) if len(first) else np.zeros(0, np.uint64)
        both = self.of_length(self.start, least) * np.uint64(3) + mix64(self.of_length(self.start + self.run - 1, least))
        self.segment = mix64(both + self.run.astype(np.uint64) + (self.key << np.uint64(16)))
        del self.hashes

    def everywhere(self, length: int) -> np.ndarray:
        """Hashes of all strings of ``length`` bytes, in order of their places."""
        count = max(0, len(self.data) - length + 1)
        out, done = np.zeros(count, np.uint64), 0
        for k in (32, 16, 8, 4, 2, 1):
            while length - done >= k:
                out = out * _power(k) + self.hashes[k][done : done + count]
                done += k
        return out

    def of_length(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the strings of ``length`` bytes at these places."""
        out, done = np.zeros(len(at), np.uint64), 0
        for k in (32, 16, 8, 4, 2, 1):
            while length - done >= k:
                out = out * _power(k) + self.hashes[k][at + done]
                done += k
        return out


def packed(key: np.ndarray) -> bytes:
    """48-bit keys in six bytes each."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def squeezed(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def smallest(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, one place of each, its smallest doc, and for every entry the number of its key."""
    distinct, place, at = np.unique(key, return_index=True, return_inverse=True)
    low = np.full(len(distinct), NO_DOC)
    np.minimum.at(low, at, doc)
    return distinct, place, low, at


def group_of(key: np.ndarray, groups: int) -> np.ndarray:
    return (key % np.uint64(groups)).astype(np.int64)


def blocked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """block, bundle: the texts by block; and the number of groups, which grows with the bytes.

    Blocks are parts of splits of the input. Splits can move from job to job, so blocks are named and written once, in
    buckets: the answers come to the texts, which stay where they are.
    """
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_DOC))).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("split"),
    )
    sizes = source.groupBy("split").agg(F.sum(F.octet_length("text")).alias("bytes"))
    size = sizes.agg(F.max("bytes").alias("most"), F.sum("bytes").alias("all")).first()
    parts = math.ceil((size["most"] or 0) / BLOCK_BYTES) or 1
    block = F.xxhash64("split", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    groups = max(16, math.ceil((size["all"] or 0) / BLOCK_BYTES))
    return stored_by(bundled(source.withColumn("block", block).drop("split"), CHUNK), "block", groups), groups


def anchors(blocks: DataFrame, groups: int, least: int) -> DataFrame:
    """grp, block, keys, many: distinct anchors of a block, and a bit for each that is in several of its documents."""
    fields = "grp long, block long, keys binary, many binary"
    schema = arrow_schema(fields)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                key, doc = np.concatenate([k for k, _ in parts]), np.concatenate([d for _, d in parts])
                distinct, _, low, at = smallest(key, doc)
                many = np.zeros(len(distinct), bool)
                many[at[doc > low[at]]] = True
                grp = group_of(distinct, groups)
                order = np.argsort(grp, kind="stable")
                cuts = np.searchsorted(grp[order], np.arange(groups + 1))
                own = [(g, order[cuts[g] : cuts[g + 1]]) for g in range(groups) if cuts[g] < cuts[g + 1]]
                yield record(schema, grp=[g for g, _ in own], block=[block] * len(own), keys=[packed(distinct[o]) for _, o in own], many=[np.packbits(many[o]).tobytes() for _, o in own])
            held.clear()

        for chunk in (c for batch in batches for c in unbundled(batch)):
            found = Windows(text_bytes(chunk.column("text")), least)
            held.setdefault(chunk.column("block")[0].as_py(), []).append((found.key, chunk.column("doc_id").to_numpy()[found.doc]))
            size += len(found.key)
            if size > 4_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return blocks.mapInArrow(collect, fields)


def shared_anchors(sent: DataFrame) -> DataFrame:
    """block, keys: the anchors of a block that are in more than one document of the corpus."""
    fields = "block long, keys binary"

    def compare(table: pa.Table) -> pa.Table:
        keys = [unpacked(k) for k in table.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool) for m, k in zip(table.column("many").to_pylist(), keys)]
        distinct, at, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[at[np.concatenate(many)]] = True
        cuts = np.cumsum([0, *map(len, keys)])
        found = [packed(k[shared[at[a:b]]]) for k, a, b in zip(keys, cuts, cuts[1:])]
        return pa.table({"block": table.column("block"), "keys": pa.array(found, pa.binary())})

    return sent.groupBy("grp").applyInArrow(compare, fields)


def segments(blocks: DataFrame, shared: DataFrame, groups: int, least: int) -> DataFrame:
    """grp, block and, as arrays in bytes, the distinct segments of a block: key, segment, low (doc), run, content."""
    fields = "grp long, block long, keys binary, segments binary, low binary, run binary, content binary"
    schema = arrow_schema(fields)

    def collect(texts: pa.Table, heard: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpacked(k) for k in heard.column("keys").to_pylist())]))
        parts: dict[str, list] = {"key": [], "segment": [], "low": [], "run": [], "content": []}
        for chunk in unbundled(texts):
            found = Windows(text_bytes(chunk.column("text")), least)
            at = np.searchsorted(known, found.key)
            own = np.flatnonzero((at < len(known)) & (np.append(known, np.uint64(0))[at] == found.key))
            _, place, low, _ = smallest(found.segment[own], chunk.column("doc_id").to_numpy()[found.doc[own]])
            own = own[place]
            data = found.data.tobytes()
            parts["content"] += [data[s : s + r + least - 1] for s, r in zip(found.start[own].tolist(), found.run[own].tolist())]
            for name, value in (("key", found.key[own]), ("segment", found.segment[own]), ("low", low), ("run", found.run[own])):
                parts[name].append(value)
        key, segment, low, run = (np.concatenate([np.zeros(0, k), *parts[n]]) for n, k in (("key", np.uint64), ("segment", np.uint64), ("low", np.int64), ("run", np.int64)))
        _, place, low, _ = smallest(segment, low)  # once for the block
        grp = group_of(key[place], groups)
        order = np.argsort(grp, kind="stable")
        place, low, grp = place[order], low[order], grp[order]
        cuts = np.searchsorted(grp, np.arange(groups + 1))
        out: dict[str, list] = {f.name: [] for f in schema}
        if texts.num_rows:
            block = texts.column("block")[0].as_py()
            for g in np.unique(grp).tolist():
                part = slice(cuts[g], cuts[g + 1])
                own = place[part]
                values = (g, block, packed(key[own]), segment[own].tobytes(), squeezed(low[part].tobytes()), run[own].astype(np.uint16).tobytes(), squeezed(b"".join([parts["content"][i] for i in own.tolist()])))
                for name, value in zip(out, values):
                    out[name].append(value)
        return pa.Table.from_batches([record(schema, **out)])

    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(collect, fields)


def suffix_order(text: np.ndarray, least: int) -> np.ndarray:
    """Rotations of the text in the order of at least their first ``least`` bytes, by doubling."""
    n = len(text)
    around = text.astype(np.uint64)
    key, length = around.copy(), 1
    while length < 8:
        key = (key << np.uint64(8 * length)) | np.roll(key, -length)
        length *= 2
    while True:
        order = np.argsort(key)  # the order of equal ones has no effect on boundaries below ``least``
        if length >= least:
            return order
        rank = np.zeros(n, np.uint64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        key = (rank << np.uint64(32)) | np.roll(rank, -length)
        length *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each row of the transform the common prefix with the row above where it is below ``least``, else -1.

    The transform holds the byte before each rotation. Row ``step[k]`` is the rotation of row k one byte back; it
    follows that of ``before[k]``, the last row above k with the same byte. So a boundary of value v between these two
    is a boundary of value v + 1 there, if none of a smaller value lies between: values come up in increasing order.
    """
    n = len(text)
    transform = text[order - 1]
    rows = np.argsort(transform, kind="stable")
    step = np.empty(n, np.int64)
    step[rows] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = transform[rows[1:]] != transform[rows[:-1]]
    before = np.full(n, -1)
    before[rows[1:][~new[1:]]] = rows[:-1][~new[1:]]
    value = np.where(new, 0, -1).astype(np.int16)
    waiting = np.flatnonzero(value[step] < 0)
    above, to = before[waiting], step[waiting]
    for v in range(least - 1):
        bounds = np.flatnonzero(value == v)
        passed = np.cumsum(np.bincount(np.searchsorted(waiting, bounds), minlength=len(waiting) + 1)[: len(waiting)])
        hit = np.append(-1, bounds)[passed] > above  # the nearest boundary of value v
        value[to[hit]] = v + 1
        waiting, above, to = waiting[~hit], above[~hit], to[~hit]
        if not len(waiting):
            break
    return value


def window_minima(contents: list[bytes], low: np.ndarray, run: np.ndarray, least: int) -> np.ndarray:
    """For each window of each segment, in order, the smallest doc of all windows with the same bytes."""
    text = np.frombuffer(b"".join(contents), np.uint8)
    starts = np.cumsum([0, *map(len, contents)])[:-1]
    segment = np.repeat(np.arange(len(contents)), run)
    window = starts[segment] + np.arange(len(segment)) - np.repeat(np.cumsum(run) - run, run)
    doc = np.full(len(text), NO_DOC)
    doc[window] = low[segment]
    order = suffix_order(text, least)
    first = common_prefixes(text, order, least) >= 0
    minima = np.minimum.reduceat(doc[order], np.flatnonzero(first))
    out = np.empty(len(text), np.int64)
    out[order] = minima[np.cumsum(first) - 1]
    return out[window]


def earlier_windows(sent: DataFrame, least: int) -> DataFrame:
    """block, segment, start, length, low (as bytes): windows of a block that start in a smaller doc than in the block."""
    fields = "block long, segments binary, starts binary, lengths binary, low binary"

    def compare(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        per_block = read("segments", np.uint64)
        block = np.repeat(table.column("block").to_numpy(), [len(s) for s in per_block])
        runs_of = read("run", np.uint16)
        segment, run = np.concatenate(per_block), np.concatenate(runs_of).astype(np.int64)
        own_low = np.concatenate([np.frombuffer(pa.decompress(x, 8 * len(r), "zstd"), np.int64) for x, r in zip(table.column("low").to_pylist(), runs_of)])
        key = np.concatenate([unpacked(k) for k in table.column("keys").to_pylist()])
        content = b"".join(pa.decompress(x, int(r.sum(dtype=np.int64)) + (least - 1) * len(r), "zstd", asbytes=True) for x, r in zip(table.column("content").to_pylist(), runs_of))
        begins = np.cumsum(run + least - 1) - (run + least - 1)
        _, place, low, at = smallest(segment, own_low)
        order = np.argsort(key[place], kind="stable")  # anchors stay together
        place, low = place[order], low[order]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        at = number[at]
        runs, keys = run[place], key[place]
        offset = np.cumsum(runs) - runs
        minima = np.repeat(low, runs)
        alone = np.ones(len(keys), bool)
        same = keys[1:] == keys[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        todo = np.flatnonzero(~alone)
        size = np.cumsum(runs[todo] + least - 1)
        while len(todo):
            stop = max(1, int(np.searchsorted(size, size[0] + BATCH_BYTES)))
            while stop < len(todo) and keys[todo[stop]] == keys[todo[stop - 1]]:
                stop += 1
            batch = todo[:stop]
            texts = [content[b : b + r + least - 1] for b, r in zip(begins[place[batch]].tolist(), runs[batch].tolist())]
            windows = np.repeat(offset[batch] - (np.cumsum(runs[batch]) - runs[batch]), runs[batch]) + np.arange(runs[batch].sum())
            minima[windows] = window_minima(texts, low[batch], runs[batch], least)
            todo, size = todo[stop:], size[stop:]
        # runs of windows with one smaller doc, for each entry of each block
        entry = np.repeat(np.arange(len(segment)), run)
        inside = np.arange(len(entry)) - np.repeat(np.cumsum(run) - run, run)
        found = minima[offset[at][entry] + inside]
        told = found < own_low[entry]
        entry, inside, found = entry[told], inside[told], found[told]
        new = np.ones(len(entry), bool)
        new[1:] = (entry[1:] != entry[:-1]) | (inside[1:] != inside[:-1] + 1) | (found[1:] != found[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(entry)))
        entry, inside, found = entry[first], inside[first], found[first]
        out: dict[str, list] = {n: [] for n in ("block", "segments", "starts", "lengths", "low")}
        for b in np.unique(block[entry]).tolist():
            own = block[entry] == b
            values = (b, segment[entry[own]].tobytes(), inside[own].astype(np.uint16).tobytes(), length[own].astype(np.uint16).tobytes(), found[own].tobytes())
            for name, value in zip(out, values):
                out[name].append(value)
        return pa.Table.from_batches([record(arrow_schema(fields), **out)])

    return sent.groupBy("grp").applyInArrow(compare, fields)


def cut(blocks: DataFrame, heard: DataFrame, least: int) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the maximal removed runs, and the bytes that stay."""
    fields = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"
    schema = arrow_schema(fields)

    def remove(texts: pa.Table, told: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in told.column(c).to_pylist())])
        segment, low = read("segments", np.uint64), read("low", np.int64)
        begin, length = read("starts", np.uint16).astype(np.int64), read("lengths", np.uint16).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, low, begin, length = segment[order], low[order], begin[order], length[order]
        pieces = []
        for chunk in unbundled(texts):
            own = text_bytes(chunk.column("text"))
            pieces.append((chunk.column("doc_id").to_numpy(), own, Windows(own, least)))
        # the smallest doc of each segment within the block
        seen = [smallest(found.segment, ids[found.doc])[:3:2] for ids, _, found in pieces]
        names, _, lows, _ = smallest(np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in seen)]), np.concatenate([np.zeros(0, np.int64), *(d for _, d in seen)]))
        out: list[pa.RecordBatch] = []
        for ids, own, found in pieces:
            doc = ids[found.doc]
            change = np.zeros(len(found.data) + 1, np.int64)

            def mark(start: np.ndarray, windows: np.ndarray) -> None:
                np.add.at(change, start, 1)
                np.add.at(change, start + windows - 1 + least, -1)

            later = doc > lows[np.searchsorted(names, found.segment)]
            mark(found.start[later], found.run[later])
            a, b = np.searchsorted(segment, found.segment, "left"), np.searchsorted(segment, found.segment, "right")
            entry = np.repeat(np.arange(len(a)), b - a)
            at = np.arange(len(entry)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[entry]
            smaller = doc[entry] > low[at]
            mark(found.start[entry[smaller]] + begin[at[smaller]], length[at[smaller]])
            gone = np.cumsum(change)[:-1] > 0
            spans, stays = [], []
            for k, text in enumerate(own):
                own_gone = gone[found.ends[k] : found.ends[k + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own_gone, [False]]).astype(np.int8)))
                spans.append((edges[::2], edges[1::2]))
                stays.append(found.data[found.ends[k] : found.ends[k + 1]][~own_gone].tobytes() if len(edges) else text)
            out.append(record(schema, doc_id=ids, n_bytes=[len(t) for t in own], starts=[s for s, _ in spans], ends=[e for _, e in spans], kept=stays))
        return pa.Table.from_batches(out, schema)

    return blocks.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(remove, fields)


def deduplicate(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, starts, ends, kept: every text without the bytes that strings of smaller documents cover."""
    assert SEED < least <= 2 * SEED + 64, "windows must be longer than their seeds"
    blocks, groups = blocked(docs, id_col, text_col)
    shared = kept(shared_anchors(anchors(blocks, groups, least)))
    told = kept(earlier_windows(segments(blocks, shared, groups, least), least))
    out = cut(blocks, told, least)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != int(NO_DOC), F.col("doc_id")))

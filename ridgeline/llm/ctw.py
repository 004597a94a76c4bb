"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with its own context tree over the ``DEPTH`` bytes before it (zero bytes before
the start of a text). Every node holds a Krichevsky-Trofimov estimate of its decisions; a node's weighted probability is
half its own estimate and half the product of its children's, and a decision is predicted by the mixture of the estimates
of all depths along its context that these weights give. Counts come from all training documents; a text is scored with
the counts as they are at the end of training. The size of the tree follows the corpus: no context is hashed or dropped.

How it runs: blocks of documents send their distinct strings of DEPTH + 1 bytes and their distinct words, as packed arrays
for each group of hashes; groups add the counts up. The trees below each pair of nearest bytes are mixed in one group of
distinct strings, the two upper levels on the driver (at most 256 x 255 nodes). The log probability of each string (in
single precision) and the count of each word then go back to the blocks that hold it, in the order of the block's keys,
where they meet the texts. The base score is the add-one unigram score of the words.

Odd cases: a null text is an empty one: no byte, log probability 0, and one token, the end; without training documents
all decisions have probability one half; repeated rows are each scored and learned; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_schema, bundled, joined_bytes, kept, mix64, record, stored_by, text_bytes, unbundled
from ridgeline.llm.minhash import WordHashes

DEPTH = 5
#: Text of a block of documents.
BLOCK_BYTES = 32 << 20
CHUNK = 2 << 20
PAIR_GROUPS = 256
END = 0  # the key of the end of a text among words; no word hashes are zero in practice, and one would only share it

_hashes = WordHashes()


def strings(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte of each text the byte and the five before it as one number, the earliest first."""
    x = data.astype(np.uint64)
    out = x.copy()
    for k in range(1, DEPTH + 1):
        before = np.zeros(len(x), np.uint64)
        before[k:] = x[:-k] if len(x) > k else 0
        for at in range(k):  # bytes of the text before do not count
            starts = ends[:-1] + at
            before[starts[starts < ends[1:]]] = 0
        out |= before << np.uint64(8 * k)
    return out


def word_keys(text: bytes) -> np.ndarray:
    """Keys of the words, A-Z lowered, and of the end."""
    words = text.lower().split()
    keys = np.empty(len(words) + 1, np.uint64)
    keys[:-1] = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    keys[-1] = END
    return keys


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, brought back by the recurrence; x > 0."""
    back = np.zeros_like(x)
    for k in range(8):
        back += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - back


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def log_half(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, below) - math.log(2)


def own_share(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The weight of a node's own estimate against the product of its children."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def one_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def decisions(byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The node (1 to 255) and the outcome of each of the eight decisions of bytes."""
    for k in range(8):
        yield (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


class PairTree:
    """The nodes at depths 2 to ``DEPTH`` over the strings that share their two nearest context bytes.

    ``keys[k]`` are the nodes at depth k (context, then decision node), with counts of both outcomes; ``up[k]`` is the
    place at depth k - 1 of each, and ``at`` the place at the last depth of each decision of each string.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        gram = gram.view(np.uint64)
        byte, context = (gram & np.uint64(255)).astype(np.int64), gram >> np.uint64(8)
        steps = list(decisions(byte))
        node = np.concatenate([s for s, _ in steps]).astype(np.uint64)
        self.one = np.concatenate([o for _, o in steps]) == 1
        times = np.tile(n.astype(float), 8)
        key, self.at = np.unique((np.tile(context, 8) << np.uint64(8)) | node, return_inverse=True)
        zeros, ones = np.bincount(self.at, times * ~self.one, len(key)), np.bincount(self.at, times * self.one, len(key))
        self.zeros, self.ones, self.own, self.below, self.up = {}, {}, {}, {}, {}
        log = None
        for k in range(DEPTH, 1, -1):
            self.zeros[k], self.ones[k], self.own[k] = zeros, ones, log_estimate(zeros, ones)
            self.below[k] = log  # None at the last depth
            log = self.own[k] if log is None else log_half(self.own[k], log)
            if k == 2:
                break
            shorter = np.uint64((1 << 8 * (k - 1)) - 1)
            key, self.up[k] = np.unique((((key >> np.uint64(8)) & shorter) << np.uint64(8)) | (key & np.uint64(255)), return_inverse=True)
            zeros, ones = np.bincount(self.up[k], zeros, len(key)), np.bincount(self.up[k], ones, len(key))
            log = np.bincount(self.up[k], log, len(key))
        self.node, self.log = (key & np.uint64(255)).astype(np.int64), log

    def log10(self, mixed: np.ndarray, rest: np.ndarray, strings_: int) -> np.ndarray:
        """Log10 probability of the last byte of each string, from what depths 0 and 1 give and leave by node."""
        one, left = mixed[self.node], rest[self.node]
        for k in range(2, DEPTH + 1):
            if k > 2:
                one, left = one[self.up[k]], left[self.up[k]]
            share = 1.0 if self.below[k] is None else own_share(self.own[k], self.below[k])
            one = one + left * share * one_probability(self.zeros[k], self.ones[k])
            left = left * (1 - share)
        p = one[self.at]
        return np.log10(np.where(self.one, p, 1 - p)).reshape(8, strings_).sum(axis=0)


def blocked(docs: DataFrame, train: Column, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """block, bundle: doc_id, text, train by block; and the number of groups, which grows with the bytes.

    A block is a part of one split of the input, so that no shuffle is needed to count it. Splits can move from job to
    job, so blocks are named and written once, in buckets: the answers come to the texts, which stay where they are.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), train.alias("train"),
        F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("split"),
    )
    sizes = source.groupBy("split").agg(F.sum(F.octet_length("text")).alias("bytes"))
    size = sizes.agg(F.max("bytes").alias("most"), F.sum("bytes").alias("all")).first()
    parts = math.ceil((size["most"] or 0) / BLOCK_BYTES) or 1
    block = F.xxhash64("split", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    groups = max(16, math.ceil((size["all"] or 0) / (8 << 20)))
    return stored_by(bundled(source.withColumn("block", block).drop("split"), CHUNK), "block", groups), groups


class Counts:
    """Distinct keys with their counts, gathered in pieces."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.least = 0

    def add(self, keys: np.ndarray, learned: bool) -> None:
        key, n = np.unique(keys, return_counts=True)
        self.parts.append((key, n if learned else np.zeros(len(n), np.int64)))
        self.size += len(key)
        if self.size > 2_000_000 + 2 * self.least:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            key, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in self.parts)]), return_inverse=True)
            n = np.bincount(at, np.concatenate([np.zeros(0), *(c for _, c in self.parts)]), len(key)).astype(np.int64)
            self.parts = [(key, n)]
        self.size = self.least = len(self.parts[0][0])
        return self.parts[0]


class Places:
    """Keys in pieces, each sorted once: its distinct keys, and for every entry the place of its key among them."""

    def __init__(self):
        self.pieces: list[list[tuple[np.ndarray, np.ndarray]]] = []

    def add(self, keys: np.ndarray) -> None:
        parts = [np.unique(keys[k : k + CHUNK], return_inverse=True) for k in range(0, len(keys), CHUNK)]
        self.pieces.append([(key, at.astype(np.uint32)) for key, at in parts])

    def told(self, heard: list[np.ndarray], groups: int, width: type) -> Iterator[np.ndarray]:
        """The value of every entry, piece by piece, from the values of all distinct keys by group and key."""
        key = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for parts in self.pieces for k, _ in parts)]))
        value = np.empty(len(key), width)
        value[by_group(key, groups)[0]] = np.concatenate([np.zeros(0, width), *heard])
        for parts in self.pieces:  # sorted keys are looked up, each once a piece
            yield np.concatenate([np.zeros(0, width), *(value[np.searchsorted(key, k)][at] for k, at in parts)])


def by_group(key: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys by group and key, and where each group starts in it."""
    grp = (mix64(key) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(grp.astype(np.uint16) if groups <= 1 << 16 else grp, kind="stable")  # two bytes are sorted by radix
    return order, np.cumsum(np.append(0, np.bincount(grp, minlength=groups)))


def counted(blocks: DataFrame, groups: int, kinds: tuple[bool, ...]) -> DataFrame:
    """word (or string?), grp, block, keys, few (counts below 255 as bytes), many (the others): of each block."""
    fields = "word boolean, grp long, block long, keys binary, few binary, many binary"
    schema = arrow_schema(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], Counts] = {}
        for chunk in (c for batch in batches for c in unbundled(batch)):
            block, train = chunk.column("block")[0].as_py(), chunk.column("train").to_numpy(zero_copy_only=False)
            texts = text_bytes(chunk.column("text"))
            for learned in (True, False):
                own = [texts[i] for i in np.flatnonzero(train == learned)]
                for word in kinds if own else ():
                    held.setdefault((block, word), Counts()).add(block_keys(own, word), learned)
        for (block, word), counts in held.items():
            key, n = counts.merge()
            order, cuts = by_group(key, groups)
            for g in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[g] : cuts[g + 1]]
                few = np.minimum(n[own], 255).astype(np.uint8)
                yield record(schema, word=[word], grp=[g], block=[block], keys=[packed(key[own], word)], few=[few.tobytes()], many=[n[own][few == 255].tobytes()])

    return blocks.mapInArrow(count, fields)


def block_keys(texts: list[bytes], word: bool) -> np.ndarray:
    return np.concatenate([word_keys(t) for t in texts]) if word else strings(*joined_bytes(texts))


def packed(key: np.ndarray, word: bool) -> bytes:
    """Words in eight bytes each, strings in as many as they have."""
    wide = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8))
    return wide.tobytes() if word else np.ascontiguousarray(wide[:, : DEPTH + 1]).tobytes()


def unpacked(data: bytes, word: bool) -> np.ndarray:
    width = 8 if word else DEPTH + 1
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def sent_counts(table: pa.Table, word: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of one group: keys, counts and blocks of all entries."""
    keys, counts, blocks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for block, k, few, many in zip(*(table.column(c).to_pylist() for c in ("block", "keys", "few", "many"))):
        n = np.frombuffer(few, np.uint8).astype(np.int64)
        n[n == 255] = np.frombuffer(many, np.int64)
        keys.append(unpacked(k, word))
        counts.append(n)
        blocks.append(np.full(len(n), block))
    return np.concatenate(keys), np.concatenate(counts), np.concatenate(blocks)


def answers(key: np.ndarray, value: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each block the values of its distinct keys in their order."""
    for b in np.unique(block).tolist():
        own = np.flatnonzero(block == b)
        yield b, value[own[np.unique(key[own], return_index=True)[1]]]


def totals(sent: DataFrame) -> DataFrame:
    """Of each group of words: block, values (counts for its words), and a row of tokens and different words.
    Of each group of strings: keys and values (counts) of the whole corpus."""
    fields = "word boolean, grp long, block long, keys binary, values binary, tokens long, different long"
    schema = arrow_schema(fields)

    def add(table: pa.Table) -> pa.Table:
        word, grp = table.column("word")[0].as_py(), table.column("grp")[0].as_py()
        keys, counts, blocks = sent_counts(table, word)
        distinct, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, counts, len(distinct))
        row = lambda block, k, v, t, d: record(schema, word=[word], grp=[grp], block=[block], keys=[k], values=[v], tokens=[t], different=[d])
        if not word:
            return pa.Table.from_batches([row(None, packed(distinct, False), n.tobytes(), None, None)])
        out = [row(b, None, v.tobytes(), None, None) for b, v in answers(keys, n[at], blocks)]
        return pa.Table.from_batches([*out, row(None, None, None, int(n.sum()), int((n > 0).sum()))], schema)

    return sent.groupBy("word", "grp").applyInArrow(add, fields)


def string_logs(totals_: DataFrame) -> DataFrame:
    """grp, keys, logs (single precision): log10 of the probability of the last byte of each string after the others."""
    fields = "pairs long, grp long, keys binary, n binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, k, v in zip(*(batch.column(c).to_pylist() for c in ("grp", "keys", "values"))):
                key, n = unpacked(k, False), np.frombuffer(v)
                order, cuts = by_group((key >> np.uint64(8)) & np.uint64(65535), PAIR_GROUPS)
                own = [(g, order[cuts[g] : cuts[g + 1]]) for g in np.flatnonzero(np.diff(cuts)).tolist()]
                yield record(arrow_schema(fields), pairs=[g for g, _ in own], grp=[grp] * len(own), keys=[packed(key[o], False) for _, o in own], n=[n[o].tobytes() for _, o in own])

    dealt = kept(totals_.select("grp", "keys", "values").mapInArrow(deal, fields))

    def trees(table: pa.Table) -> Iterator[tuple[int, np.ndarray, PairTree]]:
        """Nearest byte, places among the strings of the table, tree: of each pair."""
        key = np.concatenate([unpacked(k, False) for k in table.column("keys").to_pylist()])
        n = np.concatenate([np.frombuffer(v) for v in table.column("n").to_pylist()])
        pair = (key >> np.uint64(8)) & np.uint64(65535)
        order = np.argsort(pair, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
            yield int(pair[own[0]]) & 255, own, PairTree(key[own], n[own])

    def up(table: pa.Table) -> pa.Table:
        found = [(np.full(len(t.node), near), t.node, t.zeros[2], t.ones[2], t.log) for near, _, t in trees(table)]
        return pa.table(dict(zip(("near", "node", "zeros", "ones", "log"), map(np.concatenate, zip(*found)))))

    rows = dealt.groupBy("pairs").applyInArrow(up, "near long, node long, zeros double, ones double, log double")
    top = rows.groupBy("near", "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log").alias("log")).collect()  # 256 x 255 rows
    counts, below = np.zeros((2, 256, 256)), np.zeros((256, 256))
    for r in top:
        counts[0, r["near"], r["node"]], counts[1, r["near"], r["node"]], below[r["near"], r["node"]] = r["zeros"], r["ones"], r["log"]
    own = log_estimate(counts[0], counts[1])
    share = own_share(own, below)
    root = counts.sum(axis=1)
    root_share = own_share(log_estimate(root[0], root[1]), log_half(own, below).sum(axis=0))
    mixed = root_share * one_probability(root[0], root[1]) + (1 - root_share) * share * one_probability(counts[0], counts[1])
    rest = (1 - root_share) * (1 - share)

    def down(table: pa.Table) -> pa.Table:
        sizes = [len(k) // (DEPTH + 1) for k in table.column("keys").to_pylist()]
        logs = np.zeros(sum(sizes))
        for near, own, tree in trees(table):
            logs[own] = tree.log10(mixed[near], rest[near], len(own))
        parts = np.split(logs.astype(np.float32), np.cumsum(sizes)[:-1])
        return pa.table({"grp": table.column("grp"), "keys": table.column("keys"), "logs": pa.array([p.tobytes() for p in parts], pa.binary())})

    return dealt.groupBy("pairs").applyInArrow(down, "grp long, keys binary, logs binary")


def string_answers(sent: DataFrame, logs: DataFrame) -> DataFrame:
    """word, grp, block, values: the logs of a block's strings of one group, in the order of the strings."""
    fields = "word boolean, grp long, block long, values binary"

    def look(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, _, blocks = sent_counts(asked, False)
        name = np.concatenate([np.zeros(0, np.uint64), *(unpacked(k, False) for k in known.column("keys").to_pylist())])
        log = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(v, np.float32) for v in known.column("logs").to_pylist())])
        order = np.argsort(name, kind="stable")
        value = log[order[np.searchsorted(name[order], keys)]] if len(keys) else log[:0]
        out = list(answers(keys, value, blocks))
        grp = asked.column("grp")[0].as_py() if out else None
        return pa.Table.from_batches([record(arrow_schema(fields), word=[False] * len(out), grp=[grp] * len(out), block=[b for b, _ in out], values=[v.tobytes() for _, v in out])])

    return sent.groupBy("grp").cogroup(logs.groupBy("grp")).applyInArrow(look, fields)


def scored(blocks: DataFrame, told: DataFrame, groups: int) -> DataFrame:
    """Sums for each document over the values of its strings and words."""
    fields = "doc_id long, train boolean, n_tokens long, n_known long, log_words double, score double"
    schema = arrow_schema(fields)

    def score(texts: pa.Table, values: pa.Table) -> pa.Table:
        pieces = []
        grams, words = Places(), Places()
        for chunk in unbundled(texts):
            own = text_bytes(chunk.column("text"))
            data, ends = joined_bytes(own)
            grams.add(strings(data, ends))
            keys = [word_keys(t) for t in own]
            words.add(np.concatenate(keys))
            pieces.append((chunk.select(["doc_id", "train"]), ends, np.array([len(k) for k in keys])))
        heard: dict[bool, list[tuple[int, bytes]]] = {False: [], True: []}
        for word, grp, value in zip(*(values.column(c).to_pylist() for c in ("word", "grp", "values"))):
            heard[word].append((grp, value))
        logs = grams.told([np.frombuffer(v, np.float32) for _, v in sorted(heard[False])], groups, np.float32)
        counts = words.told([np.frombuffer(v, np.float64) for _, v in sorted(heard[True])], groups, np.float64)
        out: list[pa.RecordBatch] = []
        for (chunk, ends, tokens), log, count in zip(pieces, logs, counts):
            total = np.add.reduceat(np.append(log.astype(float), 0.0), ends[:-1])
            total[ends[1:] == ends[:-1]] = 0.0
            first = np.cumsum(tokens) - tokens  # every text has its end
            out.append(record(
                schema, doc_id=chunk.column("doc_id"), train=chunk.column("train"), n_tokens=tokens,
                n_known=np.add.reduceat((count > 0).astype(np.int64), first), log_words=np.add.reduceat(np.log10(count + 1), first), score=total,
            ))
        return pa.Table.from_batches(out, schema)

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, fields)


def evaluate(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score (both log10) of every document."""
    blocks, groups = blocked(docs, train, id_col, text_col)
    sent = kept(counted(blocks, groups, (False,)))  # strings are counted, and then ask
    found = kept(totals(sent.unionByName(counted(blocks, groups, (True,)))))
    size = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("different"), F.lit(0)).alias("different")).first()
    logs = kept(string_logs(found.where(~F.col("word"))))
    told = string_answers(sent, logs)
    told = told.unionByName(found.where(F.col("word") & F.col("block").isNotNull()).select("word", "grp", "block", "values"))
    base = F.col("log_words") - F.col("n_tokens") * F.lit(math.log10(size["tokens"] + size["different"] + 1))
    return scored(blocks, told, groups).select("doc_id", "train", "n_tokens", "n_known", F.lit(size["tokens"]).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method: best-two-fit. A bin is filled greedily, each time with the longest piece that fits; then its smallest piece is
replaced by the two unpacked pieces that fill the widened gap most tightly, as long as that makes it fuller. Only
lengths matter to it, so bins are planned on the histogram of lengths (at most ``capacity`` counts, whatever the size
of the corpus): a planned pattern stands for as many equal bins as the counts allow. Pieces then find their place by
their rank among the pieces of the same length, which Spark computes without gathering a length in one task.

Nulls and odd cases: a null text is an empty one and gives one piece, the end id alone; a null id is kept as it is;
repeated rows are packed as often as they occur; an empty table gives an empty result. Only ``id_col`` and ``text_col``
are read, so other columns may have any name.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_schema, chunks, kept, record, text_bytes

#: Words whose ids a Python worker remembers.
CACHED_WORDS = 500_000
#: ASCII punctuation without the apostrophe, which can start an ending.
ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit values. The tokenizer drops white space, so words stand alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.path = path
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabets show these bytes as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def learn(self, words: set[bytes]) -> None:
        """Small Latin letters go straight to the merges; the punctuation that ends a word is a run of its own."""
        missing = words - self.keys()
        if len(self) + len(missing) > CACHED_WORDS:
            self.clear()
            missing = words
        merge, latin, other, ended = self.tokenizer.model.tokenize, self.shown, set(), []
        for word in missing:
            text = word.decode()
            core = text.rstrip(ENDS)
            # "\u0130" lowers to an i and a combining dot, which joins the punctuation after it
            if core and core.lower()[-1].isalnum() and "<|" not in text:
                key = core.encode()
                if core is not text and core != text:
                    run = text[len(core) :]
                    ended.append((word, key, run.encode()))
                    if run.encode() not in self:
                        other.add(run)
                if key not in self:
                    if core.isalpha() and max(core) < "\u0250" and core == core.lower():
                        ids = [t.id for t in merge(core if core.isascii() else "".join(map(latin.__getitem__, key)))]
                        self[key] = array("I", ids).tobytes()
                    else:
                        other.add(core)
            else:
                other.add(text)
        listed = list(other)
        self.update(zip((w.encode() for w in listed), self.encode(listed)))
        for word, core, run in ended:
            self[word] = self[core] + self[run]


_words: WordIds | None = None


def _word_ids(path: str) -> WordIds:
    global _words
    if _words is None or _words.path != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _words = WordIds(path)
    return _words


def lowered(text: bytes) -> bytes:
    """A-Z lowered, as the tokenizer will do, so that fewer words differ; not before combining marks, with which it composes first."""
    return text if b"\xcc" in text or b"\xcd" in text else text.lower()


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids: each document's ids and the end id, cut at ``capacity``.

    Only for tokenizers that lower case, drop white space and never join words across it; words are encoded once and looked up.
    """
    fields = PIECES + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(fields)
    step = 4 * capacity
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _word_ids(tokenizer_path)
        for chunk in chunks(batches, "text", 2 << 20):
            texts = [lowered(t).split() for t in text_bytes(chunk.column("text"))]
            words_of.learn(set().union(*texts))
            find = words_of.__getitem__
            out: dict[str, list] = {f.name: [] for f in schema}
            for key, words in zip(chunk.column("doc_id").to_pylist(), texts):
                ids = b"".join(map(find, words)) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out["doc_id"].append(key)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            yield record(schema, **out)

    assert sys.byteorder == "little"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, fields)


def _longest(left: np.ndarray) -> np.ndarray:
    """For each room, the longest length of which a piece is left, 0 if none fits."""
    return np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))


def _better_pair(left: np.ndarray, longest: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two lengths left, a >= b, with the largest sum in (least, room]."""
    a = np.flatnonzero(left[:room] > 0)
    a = a[a > 0]
    if not len(a):
        return None
    b = longest[np.minimum(room - a, a)]
    b = np.where((b == a) & (left[a] < 2), longest[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    best = int(np.argmax(total))
    return (int(a[best]), int(b[best])) if total[best] > least else None


def plan_bins(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Best-two-fit on ``counts[length]``. Rows: length, first rank, pieces per bin, bins, first bin, offset in the bin.

    Each round plans one bin and repeats it as often as its lengths last, so a length runs out in almost every round.
    """
    left = np.zeros(capacity + 1, np.int64)
    left[: len(counts)] = counts
    rank = np.zeros(capacity + 1, np.int64)
    rows, first_bin = [], 0
    while left.any():
        own: dict[int, int] = {}
        room = capacity
        while room:
            size = int(_longest(left[: room + 1])[-1])
            if not size:
                break
            times = int(min(left[size], room // size))
            own[size] = own.get(size, 0) + times
            left[size] -= times
            room -= times * size
        while room and own:
            smallest = min(own)
            pair = _better_pair(left, _longest(left), room + smallest, smallest)
            if pair is None:
                break
            own[smallest] -= 1
            left[smallest] += 1
            if not own[smallest]:
                del own[smallest]
            for size in pair:
                own[size] = own.get(size, 0) + 1
                left[size] -= 1
            room += smallest - sum(pair)
        bins = 1 + int(min(left[s] // n for s, n in own.items()))
        offset = 0
        for size, n in sorted(own.items(), reverse=True):
            left[size] -= n * (bins - 1)
            rows.append((size, rank[size], n, bins, first_bin, offset))
            rank[size] += n * bins
            offset += n * size
        first_bin += bins
    return np.asarray(sorted(rows), np.int64).reshape(-1, 6)


def rank_in_length(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length. A length is dealt over salts that grow with the table."""
    salts = max(64, total // 200_000)
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = salted.withColumn("rank", F.row_number().over(own).cast("long") - 1)
    return ranked.join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first")).drop("salt", "first")


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, length``; lengths are 1 to ``capacity``.

    The plan sent to the tasks has at most a few thousand rows: its size follows ``capacity``, not the corpus.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    plan = plan_bins(counts, capacity)
    columns = [(f.name, f.dataType.simpleString()) for f in pieces.schema]
    fields = ", ".join(f"`{n}` {k}" for n, k in columns) + ", sequence_id long, offset long"
    starts = (plan[:, 0] << 50) + plan[:, 1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = plan[np.searchsorted(starts, (length << 50) + rank, "right") - 1]
            nth = rank - row[:, 1]
            out = batch.select([n for n, _ in columns])
            sequence = pa.array(row[:, 4] + nth // np.maximum(row[:, 2], 1), pa.int64())
            offset = pa.array(row[:, 5] + nth % np.maximum(row[:, 2], 1) * length, pa.int64())
            yield pa.RecordBatch.from_arrays([*out.columns, sequence, offset], names=[*out.schema.names, "sequence_id", "offset"])

    ranked = rank_in_length(pieces, int(counts.sum()))
    return ranked.select(*[n for n, _ in columns], "rank").mapInArrow(find, fields)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pieces of all documents with their place: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return place(kept(tokenise(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col)), capacity)

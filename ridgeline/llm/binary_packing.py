"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document's ids, with the end id, are cut into pieces whose lengths are the binary digits of their number, longest
first, with as many pieces of ``longest`` as it holds. Each piece is a sequence of its own; pieces of equal length form a
bucket, from which training draws batches of one shape. ``sequence_id`` carries the bucket in its upper bits, so buckets
need no exchange to be told apart, and ``write`` lays them out as one folder for each.

Words are encoded once and looked up: a text falls into segments that a byte-level tokenizer never joins, as the last
white-space character before another one goes with what follows or stands alone. Special tokens cut the text first.

Odd cases: a null text is an empty one and gives one piece, the end id alone; a null id stays null; repeated rows are
packed as often as they occur; a text of any length is encoded in parts; an empty table gives an empty result; only
``id_col`` and ``text_col`` are read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_schema, chunks, record, text_bytes

#: Segments that a Python worker remembers, and the longest that it does.
CACHED = 1_000_000
CACHED_BYTES = 64
#: Row numbers of one run take fewer bits than this; the bucket stands above them.
ROW_BITS = 58
#: Before white space that a visible ASCII character follows, or one whose first byte no other white space has.
SEGMENT = re.compile(rb"(?=[\x20\x09-\x0D][\x21-\x7E\xC3-\xE0\xE4-\xF4])")
#: A segment of three tokens' runs at most: a line end or tab, letters of ASCII or Latin-1 after a space or none, punctuation.
PLAIN = re.compile(rb"([\x09-\x0D]?)( ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+)([!-&(-/:-@\[-`{-~]*)")
#: A long text is encoded in parts of about so many bytes, cut between two words.
PART_BYTES = 4 << 20
BETWEEN = re.compile(rb"(?<=[\x21-\x7E])(?=[\x20\x09-\x0D][A-Za-z0-9])")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


class SegmentIds(dict):
    """Segment -> its ids as little-endian 32-bit values."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.path = path
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabets show these bytes as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.shown = "".join(map(chr, (b if b in set(shown) else 256 + hidden.index(b) for b in range(256))))
        self.special = re.compile(b"(" + b"|".join(special) + b")") if special else None

    def __missing__(self, segment: bytes) -> bytes:
        """Plain words go straight to the merges, run by run; all else goes through the whole tokenizer."""
        plain = PLAIN.fullmatch(segment)
        if plain is not None:
            ids = b"".join([self.get(run) or self.run(run) for run in plain.groups() if run])
        else:
            ids = np.asarray(self.tokenizer.encode(segment.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > CACHED:
            self.clear()
        if len(segment) <= CACHED_BYTES:
            self[segment] = ids
        return ids

    def run(self, run: bytes) -> bytes:
        ids = self[run] = array("I", [t.id for t in self.merge(run.decode("latin-1").translate(self.shown))]).tobytes()
        return ids

    def split(self, text: bytes) -> list[bytes]:
        if self.special is None or not self.special.search(text):
            return SEGMENT.split(text)
        own = self.special.split(text)
        return [s for k, part in enumerate(own) for s in ([part] if k % 2 else SEGMENT.split(part))]

    def of(self, text: bytes) -> bytes:
        """The ids of a text."""
        return b"".join([ids for part in parts(text) for ids in map(self.__getitem__, self.split(part))])


def parts(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > 2 * PART_BYTES and (cut := BETWEEN.search(text, at + PART_BYTES)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_segments: SegmentIds | None = None


def _segment_ids(path: str) -> SegmentIds:
    global _segments
    if _segments is None or _segments.path != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _segments = SegmentIds(path)
    return _segments


def binary_lengths(n: int, longest: int) -> list[int]:
    """The lengths of the pieces of ``n`` ids, falling: pieces of ``longest`` and the binary digits of what is left."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def decompose(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, bucket (binary logarithm of the length) and, if wanted, ids of each piece."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    fields = PIECES + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(fields)
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _segment_ids(tokenizer_path)
        for chunk in chunks(batches, "text", 2 << 20):
            out: dict[str, list] = {f.name: [] for f in schema}
            for key, ids in zip(chunk.column("doc_id").to_pylist(), map(known.of, text_bytes(chunk.column("text")))):
                ids += end
                total, at = len(ids) // 4, 0
                for size in binary_lengths(total, longest):
                    part = ids[4 * at : 4 * (at + size)]
                    out["doc_id"].append(key)
                    out["start"].append(at)
                    out["length"].append(size)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["doc_tokens"].append(total)
                    out["bucket"].append(size.bit_length() - 1)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                    at += size
            yield record(schema, **out)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(cut, fields)


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decompose`` with ``sequence_id`` and ``offset``: each piece is a sequence of its own, so the offset is 0."""
    pieces = decompose(docs, tokenizer_path, longest, end_id, with_ids, id_col, text_col)
    number = F.shiftleft(F.col("bucket").cast("long"), ROW_BITS).bitwiseOR(F.monotonically_increasing_id())
    return pieces.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")})


def write(packed: DataFrame, path: str) -> None:
    """One folder for each bucket. Every task adds a file to each, so a bucket of most pieces is no hot key."""
    packed.write.partitionBy("bucket").parquet(path)

"""Cyclic phrase counting, power-of-two packing and the vertical scan against brute force; odd cases of each."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import binary_packing, negatives, phrases
from ridgeline.llm.queries import tokenizer

CLASHES = "n int, key long, part int, length long, bucket string, rank int, row long, dim string, score double"


def brute_phrases(rows, least, longest, covered=80, most=2000):
    total, count = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            count.update((lang, tuple(words[i : i + n])) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    often = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in often.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                inside[lang, w[i : i + n]] = max(inside[lang, w[i : i + n]], a)
    out = {}
    for (lang, w), a in often.items():
        if 100 * inside[lang, w] < 80 * a:
            score, _, l, r = min((2_000_000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))  # noqa: E741
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:most]))


def some_texts(seed, docs=120):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 4))) for _ in range(40)]
    idioms = [" ".join(rng.choice(words, n)) for n in (2, 3, 3, 4, 4, 6)]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\x00 ", " \x1c"]
    rows = []
    for _ in range(docs):
        parts = [str(rng.choice(idioms)) if rng.random() < 0.3 else str(rng.choice(words)) for _ in range(rng.integers(0, 60))]
        text = "".join(p + str(rng.choice(ends)) for p in parts)
        rows.append((text.upper() if rng.random() < 0.1 else text, [None, "en", "en", "und", "fr"][rng.integers(0, 5)]))
    return rows + [("x " * 90 + "y", "en"), (None, "en"), ("", None), (" . ,", "de"), ("ab c d", "fr")]


@pytest.mark.parametrize("seed, shards, slot_bits, partitions", [(1, 4, 24, 5), (2, 2, 8, 3), (3, 3, 5, 4), (4, 1, 12, 1)])
def test_phrases_equal_brute_force(spark, seed, shards, slot_bits, partitions):
    """Whatever the shards, and with so few slots that most are shared."""
    rows = some_texts(seed)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, n int, key long, part int").repartition(partitions)
    got = phrases.mine(df, least=8, longest=4, most=25, shards=shards, slot_bits=slot_bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 8, 4, most=25)


def test_phrases_of_other_lengths_and_none(spark):
    rows = some_texts(5)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for longest in (2, 5):
        assert sorted(map(tuple, phrases.mine(df, least=6, longest=longest).collect())) == brute_phrases(rows, 6, longest)
    assert phrases.mine(df.limit(0)).count() == 0 and phrases.mine(df, least=10**6).count() == 0


def test_a_run_in_one_document_becomes_active_step_by_step(spark):
    rows = [("q " * 40, "en")] + [("a b", "en")] * 3
    got = phrases.mine(spark.createDataFrame(rows, "text string, lang string").repartition(4), least=30).collect()
    assert [(r["phrase"], r["a"], r["l"], r["r"], r["n"]) for r in got] == [("q q q q", 37, 40, 38, 46)]


def test_long_texts_are_coded_in_slices():
    data = phrases.MARK.join(b" " + b"word " * k for k in (300, 5, 4000, 0, 7)) + b" end"
    data = data.replace(phrases.MARK, b" . ")
    parts = list(phrases.slices(data, 500))
    assert b"".join(p for p, _ in parts) == data and max(len(p) for p, _ in parts) <= 503 and parts[-1][1]
    assert [t for p, _ in parts for t in p.split()] == data.split()
    assert all(p.rstrip().endswith(b".") for p, closed in parts[:-1] if closed) and not all(c for _, c in parts)
    assert list(phrases.slices(b"x" * 2000, 500)) == [(b"x" * 2000, True)]


def test_windows_of_a_long_run(monkeypatch):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 4, 3000).astype(np.int32)
    keys, table = np.append(np.uint64(0), phrases.word_keys([b"a", b"b", b"c"], "en")), np.ones(1 << 10, np.uint8)

    def found():
        out = {}
        for n, pre, suf in phrases.occurrences(codes, keys, table, 1, 4, 4):
            out.setdefault(n, Counter()).update(zip(pre.tolist(), suf.tolist()))
        return out

    whole = found()
    monkeypatch.setattr(phrases, "WINDOW", 64)
    assert found() == whole and sorted(whole) == [2, 3, 4]


# Packing

HARD = [
    "", "a", "Hello world.\nNew  line\t\ttab", "don't I'LL we've  'S", "end <|endoftext|> x  <|endoftext|>", "  lead and trail  ", "nb sp   x　y   z",
    "\u0085 a \u0085b", "日本語 テキスト です 1234", "\x1c a \x1d\x1e b", "\r\n\r\n x\x0b\x0cy", "é è ê ç “quoted” — dash", "x" * 3000, " " * 700, "\n\n\n a", "a\n b \n c", "<|endoftext|>",
]


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rng = np.random.default_rng(7)
    alphabet = list("ab1.'-") + [" "] * 4 + ["\n", "\t", " ", "é", "中", " ", "<|endoftext|>", "'s", "\x1f"]
    texts = HARD + ["".join(rng.choice(alphabet, rng.integers(1, 400))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {}
    for r in sorted(binary_packing.pack(rows, tokenizer("byte_bpe_50k.json"), longest=256, with_ids=True).collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == len(found.get(r["doc_id"], [])) and r["length"] == len(r["ids"]) == 1 << r["bucket"] <= 256
        assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) and r["offset"] == 0
        found.setdefault(r["doc_id"], []).extend(r["ids"])
    for k, t in enumerate(texts):
        assert found[k] == [*tok.encode(t, add_special_tokens=False).ids, 0], t


def test_long_texts_are_encoded_in_parts(monkeypatch):
    segments = binary_packing.SegmentIds(tokenizer("byte_bpe_50k.json"))
    text = ("Some words,  and\n\nmore — <|endoftext|> é  <|endoftext|>x " * 60).encode()
    whole = segments.of(text)
    monkeypatch.setattr(binary_packing, "PART_BYTES", 50)
    assert len(list(binary_packing.parts(text))) > 20 and segments.of(text) == whole


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 1024, 5000])
def test_binary_lengths(n):
    sizes = binary_packing.binary_lengths(n, 256)
    rest = [s for s in sizes if s < 256]
    assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and len(rest) == len(set(rest)) and all(s & (s - 1) == 0 for s in sizes)


def test_every_piece_is_a_sequence_of_its_bucket(spark, tmp_path):
    rows = [(1, "one two three"), (1, "one two three"), (None, None), (None, "x " * 700), (2, "")]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, "b", 0, 0, "d", 0.0) for r in rows], f"doc_id long, text string, {CLASHES}").repartition(3)
    packed = binary_packing.pack(df, tokenizer("byte_bpe_50k.json"), longest=64)
    got = packed.collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["sequence_id"] >> binary_packing.ROW_BITS == r["bucket"] for r in got)
    assert sorted(r["length"] for r in got if r["doc_tokens"] == 1) == [1, 1]
    totals = Counter()
    for r in got:
        totals[r["doc_id"]] += r["length"]
    assert totals[1] == 2 * 4 and sum(r["start"] == 0 for r in got) == 5
    binary_packing.write(packed, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {(r["bucket"], r["length"]) for r in back.collect()} == {(r["bucket"], r["length"]) for r in got} and back.count() == len(got)
    assert binary_packing.pack(df.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        binary_packing.pack(df, tokenizer("byte_bpe_50k.json"), longest=100)


# Hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, row long, dim string, score double, stripe int"


def brute_negatives(rows, anchor, positives=5, most=3, low=50, high=95, scale=256):
    use = []
    for k, (i, v, label, *_) in enumerate(rows):
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((k, i, [math.floor(float(np.float64(scale) * x)) for x in v], label))
    out = []
    for k, i, v, label in use:
        if i is None or not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, h, other) for h, j, w, other in use if h != k and len(w) == len(v))
        near = [s for s in scored if s[4] == label][:positives]
        for p, unnamed, j, _, _ in near:
            window = [s for s in scored if s[4] != label and low * -p <= 100 * -s[0] <= high * -p][:most]
            out += [(i, None if unnamed else j, r + 1, None if s[1] else s[2], -p, -s[0]) for r, s in enumerate(window)]
    return sorted(out, key=repr)


def mined(spark, rows, every, **options):
    df = spark.createDataFrame([(*r, 1, "d", 0.0, 2) for r in rows], VECTORS).repartition(4)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0, **options).collect()), key=repr)


@pytest.mark.parametrize("dim", [3, 8, 21])
def test_negatives_equal_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(5, dim))
    rows = []
    for k in range(400):
        label = int(rng.integers(0, 4)) if k % 3 else 0
        v = centres[rng.integers(0, 5)] + rng.normal(size=dim) * rng.choice([0.0, 0.3, 1.0])
        rows.append((k, [float(x) for x in v], label))
    rows += [(500 + k, rows[k][1], rows[k + 1][2]) for k in range(60)]  # ties
    rows += [(900, None, 1), (901, rows[0][1], None), (903, [1.0, None, 2.0], 1), (904, [math.nan] * dim, 1), (906, [math.inf] * dim, 1), (907, [], 1), (908, [0.0] * dim, 2), (910, [1.0] * (dim + 1), 1), (920, [2.0] * (dim + 1), 1), (921, [1.5] * (dim + 1), 2)]
    assert mined(spark, rows, 10) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=6) + k % 3], int(k % 3)) for k in range(300)]
    for name, size in (("BLOCK", 16), ("STRIPE", 3), ("GROUP", 7)):
        monkeypatch.setattr(negatives, name, size)
    assert mined(spark, rows, 10) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_without_ids_and_of_repeated_rows(spark):
    rows = [(10, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.7, 0.1], 2), (3, [0.7, 0.1], 2), (4, [0.7, 0.1], 2), (5, [0.7, 0.1], 2), (10, [1.0, 0.0], 1)]
    got = mined(spark, rows, 10)
    one = [(10, p, r, n, 256 * 256, 179 * 256) for p in (10, None) for r, n in ((1, 3), (2, 4), (3, 5))]
    assert got == sorted(one * 2, key=repr)
    assert mined(spark, rows[:6], 10, negatives=4)[-1][3] in (5, None) and not mined(spark, rows[:1], 10) and not mined(spark, rows, 11)
    df = spark.createDataFrame([], VECTORS)
    assert negatives.mine(df, F.lit(True)).count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.integers(-(2**20), 2**20, 5)], int(k % 2)) for k in range(80)] + [(1000, [2.0**40] * 5, 1)]
    assert mined(spark, rows, 10) == brute_negatives(rows[:80], lambda i: i % 10 == 0)


def block_of(matrix, labels):
    n = len(matrix)
    row = {"rows": np.arange(n), "ids": np.arange(n), "labels": np.asarray(labels), "columns": np.ascontiguousarray(matrix.T)}
    row = {k: np.asarray(v, np.int64).tobytes() for k, v in row.items()}
    return negatives.Block(row | {"named": np.ones(n, bool).tobytes(), "dim": matrix.shape[1], "kind": "<i8"})


def test_the_scan_reads_large_magnitudes_first_and_drops_candidates():
    rng = np.random.default_rng(3)
    matrix = rng.integers(-20, 20, (500, 64))
    anchor = np.concatenate([rng.integers(-2, 3, 56), rng.integers(200, 300, 8)])
    block, looks = block_of(matrix, np.zeros(500)), []

    def stays(least, greatest):
        exact = matrix @ anchor
        assert len(least) <= 500 and (least <= greatest).all()
        looks.append(len(least))
        return greatest >= negatives.kth(least, 5)

    places, scores = block.scan(anchor, np.arange(500), stays)
    exact = matrix @ anchor
    assert (scores == exact[places]).all() and set(np.argsort(-exact, kind="stable")[:5]) <= set(places.tolist())
    assert looks[0] == 500 and looks[1] < 100 and looks == sorted(looks, reverse=True)


def test_components_of_sliced_tables():
    table = pa.table({"v": pa.array([[1, 2], [3, 4], [5, 6]], pa.list_(pa.int64()))}).slice(1)
    assert negatives.components(table).tolist() == [[3, 4], [5, 6]]

"""The pipeline's stages against a plain chain in Python, on a small table with planted copies and odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from ridgeline.llm import mixing, packing
from ridgeline.llm.queries import OTHER_WEIGHT, WEIGHTS, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, own string, shared int, often int"


def words(k, n):
    return [f"w{k}x{i}" for i in range(n)]


BASE = words(1, 80)
ROWS = [
    (5, " ".join(BASE), "src1"),
    (3, " ".join(BASE[:-1]), "src1"),  # a near copy of 5
    (8, " ".join(BASE).upper(), "src2"),
    (1, " ".join(words(2, 30)), "src0"),
    (1, " ".join(words(2, 30)), "src0"),  # the same row again
    (1, " ".join(words(3, 30)), None),  # one id, another text
    (None, " ".join(words(4, 40)), "src3"),
    (None, " ".join(words(4, 40)), "src3"),
    (None, " ".join(words(4, 41)), "src3"),  # near copies without an id
    (None, " ".join(words(2, 30)), "src0"),  # a copy of 1
    (11, None, "src4"),
    (12, "", "other"),
    (13, " \n\t", None),
    (14, "\n".join([" ".join(words(6, 8)), " ".join(words(7, 8)), " ".join(words(6, 8)), " ".join([*words(7, 8), "x"])]), "src0"),
    (15, "\n".join([" ".join(words(7, 8)), " ".join(words(8, 8))]), "src0"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "o", 2, 3) for i, t, s in ROWS], SCHEMA).repartition(4)


def bag(df):
    return Counter(map(tuple, df.collect()))


def chain_lines(rows):
    """Lines in the order of ids, then of texts; one goes if a line before it is like it."""
    seen, kept = [], {}
    for doc in sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1]}):
        stays = []
        for line in doc[2].split("\n"):
            tokens = frozenset(line.lower().split())
            if tokens and any(100 * len(tokens & s) >= 80 * len(tokens | s) for s in seen):
                continue
            stays.append(line)
            if tokens:
                seen.append(tokens)
        kept[None if doc[0] else doc[1], doc[2]] = "\n".join(stays)
    # judged on the input: lines that go still count
    return [(r[0], kept.get((r[0], r[1]), r[1])) for r in rows]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def chain_near(rows):
    """One row of each group stays: for each group its size and the ids and texts that may stay."""
    nodes = sorted({(r[0] is None, r[0] or 0, r[1] or "", r[1] is None) for r in rows})
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(n[2]) for n in nodes]
    for a in range(len(nodes)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for k, n in enumerate(nodes):
        groups.setdefault(find(k), []).append(n)
    out = []
    for group in groups.values():
        least = min((g[0], g[1]) for g in group)
        out.append({(None if g[0] else g[1], None if g[3] else g[2]) for g in group if (g[0], g[1]) == least})
    return out


def test_line_stage_equals_a_plain_one(spark, docs):
    out = pipe.without_repeated_lines(spark, docs, "")
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] in (5, 8, 14, 15, 11, 12, 13)}
    plain = dict(r for r in chain_lines(ROWS) if r[0] in texts)
    # two ids in the table come before 5 and 8 with like lines, so those are empty in both
    assert {k: texts[k] for k in (11, 12, 13, 14, 15, 5, 8)} == {k: plain[k] for k in (11, 12, 13, 14, 15, 5, 8)}


def test_near_copies_by_row(spark, docs):
    out = pipe.without_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    groups = chain_near(ROWS)
    assert len(got) == len(groups)
    for may_stay in groups:
        assert sum(row in may_stay for row in got) == 1, may_stay
    once = docs.where("doc_id > 2")
    assert bag(pipe.without_near_copies(spark, once, "").select("doc_id")) == Counter({(k,): 1 for k in (3, 11, 12, 13, 14, 15)})
    assert pipe.without_near_copies(spark, docs.limit(0), "").count() == 0


def test_the_whole_chain(spark, docs, tmp_path):
    """Every stage in its turn: rows that stay, texts, repetitions and pieces."""
    labels = spark.createDataFrame([(1, 0), (99, None)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = pipe.run(spark, str(tmp_path))
    lined = pipe.without_repeated_lines(spark, docs, "")  # nothing is toxic: no label says so
    near = pipe.without_near_copies(spark, lined, "")
    groups = chain_near([(r["doc_id"], r["text"]) for r in lined.collect()])
    assert near.count() == len(groups)
    counts = mixing.mix(near, WEIGHTS, OTHER_WEIGHT)
    pieces = packing.tokenise(counts, tokenizer(), 2048)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert bag(out.select(*columns)) == bag(pieces.select(*columns))
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert used is None or used <= 2048


def test_empty_tables(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0

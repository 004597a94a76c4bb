"""The numbered queries against their SQL, and against brute force where SQL is no way."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from ridgeline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def values(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, con, name):
    ours = queries.QUERIES[name](spark, SF)
    theirs = con.execute(queries.ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(values, ours.select(*names).collect()), key=repr) == sorted(map(values, theirs.fetchall()), key=repr)


def documents(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_substrings_against_all_windows(spark, con):
    first, expected = {}, {}
    for key, text in documents(con):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], key) < key:
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        expected[key] = (len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    got = queries.QUERIES["op8_bwt_substrings"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == expected


def test_quality_statistics(spark, con):
    from collections import Counter

    got = {r["doc_id"]: r for r in queries.QUERIES["op3_quality_trees"](spark, SF).collect()}
    for key, text in documents(con):
        words = [w for w in text.translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ") if w]
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        r = got[key]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(inside))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and not (r["kept"] and r["base_failed"])
    good = {k for k, q in con.execute("SELECT doc_id, quality FROM labels").fetchall() if q and not got[k]["base_failed"]}
    assert np.mean([got[k]["kept"] for k in good]) > 0.95


def test_language_on_held_out_documents(spark, con):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in queries.QUERIES["op5_language_ftrl"](spark, SF).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_separates_labels(spark, con):
    toxic = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
    rows = [r for r in queries.QUERIES["op6_toxicity_ordinal"](spark, SF).collect() if r["doc_id"] in toxic]
    caught = [r["rejected"] for r in rows if toxic[r["doc_id"]]]
    assert np.mean(caught) > 0.6 and not any(r["rejected"] for r in rows if not toxic[r["doc_id"]])


def test_scores_of_words(spark, con):
    import zlib
    from collections import Counter

    train, tokens = Counter(), {}
    for key, text in documents(con):
        tokens[key] = [*text.encode().lower().split(), b""]
        if zlib.crc32(str(key).encode()) % 7 != 2:
            train.update(tokens[key])
    n, v = sum(train.values()), len(train)
    for r in queries.QUERIES["op1_context_tree"](spark, SF).collect():
        own = tokens[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own)) and r["score"] <= 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, SF)
        if k < len(pipe.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0
    again = pipe.run(spark, SF)
    assert sorted(again.select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(docs.select("doc_id", "piece", "length", "ids_crc32").collect())

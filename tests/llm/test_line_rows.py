"""Line dedup of rows without an id, and of rows that share one."""

from ridgeline.llm import lines

A, B, C, D, E = (" ".join(f"{x}{k}" for k in range(6)) for x in "abcde")


def texts(spark, rows):
    out = lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out), key=repr)


def test_null_ids_come_last_and_keep_their_lines(spark):
    rows = [(None, f"{A}\n{B}\n\n{C}"), (None, "word"), (7, f"{B}\n{D}"), (8, None)]
    assert texts(spark, rows) == sorted([(None, f"{A}\n\n{C}", 3, 1), (None, "word", 1, 0), (7, f"{B}\n{D}", 2, 0), (8, None, 0, 0)], key=repr)


def test_rows_of_one_id_keep_their_own_lines(spark):
    rows = [(1, f"{A}\n{B}"), (1, f"{C}\n{D}"), (1, f"{A} more\n{E}"), (2, f"{D}\n{E}\n{A}")]
    got = texts(spark, rows)
    whole = [(1, f"{A}\n{B}", 2, 0), (1, f"{A} more\n{E}", 2, 0)]
    first = [r for r in got if r in whole]
    assert len(first) == 1 and (1, f"{C}\n{D}", 2, 0) in got and (2, "", 3, 3) in got
    assert ((1, E, 2, 1) if first == whole[:1] else (1, B, 2, 1)) in got


def test_repeated_rows_stay_alike(spark):
    assert texts(spark, [(1, A), (1, A), (2, A), (None, B), (None, B)]) == sorted([(1, A, 1, 0)] * 2 + [(2, "", 1, 1)] + [(None, B, 1, 0)] * 2, key=repr)

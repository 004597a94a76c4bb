"""The rounds of line dedup: what they move, and that no round loses a line."""

import random

import pytest

from ridgeline.llm import lines


@pytest.mark.parametrize("after", [False, True])
def test_both_sides_of_a_round_come_from_one_exchange(spark, after):
    docs = spark.createDataFrame([(i, f"a b c d e{i % 50} f g h\nx y z {i}") for i in range(60)], "doc_id long, text string")
    split = lines.kept(lines.split_lines(docs, "doc_id", "text"))
    one, _ = lines.distinct_sets(lines.coded(split, lines.rarities(split), 80))
    found = lines.kept(spark.createDataFrame([(3,)], "b long"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else reuse only shows as it runs
    try:
        plan = lines.open_pairs(lines.token_rows(one, 80, found), 80, after)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    moved = [line for line in plan.split("\n") if "Exchange" in line and "token_n_at" in line]
    assert len(moved) == 2 and sum("ReusedExchange" in line for line in moved) == 1


@pytest.mark.parametrize("heads", [1, 3, 64])
def test_rounds_find_what_all_pairs_find(spark, monkeypatch, heads):
    monkeypatch.setattr(lines, "HEADS", heads)
    pick = random.Random(heads)
    rows = []
    for i in range(80):
        size = pick.choice([3, 5, 10, 12, 80])
        base = [f"w{size}_{k}" for k in range(size)]
        for _ in range(pick.randrange(1, 5)):
            base[pick.randrange(size)] = f"v{pick.randrange(60)}"
        rows.append((i, " ".join(base)))
    got = {r["doc_id"]: r["n_removed"] == 1 for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = [set(text.split(" ")) for _, text in rows]
    want = {i: any(100 * len(s & t) >= 80 * len(s | t) for t in sets[:i]) for i, s in enumerate(sets)}
    assert got == want and any(want.values()) and not all(want.values())


def test_rarities_tell_counts_of_one_power_of_two_apart(spark):
    table = lines.rarities(spark.createDataFrame([([1, 2],)] * 5 + [([2],)] * 2, "words array<long>"))
    assert table[1] < table[2]


def test_all_kinds_of_white_space_part_words(spark):
    rows = [(0, "a b\tc\x0bd e\x0cf g\rh i j"), (1, "j i  h g f e\t\td\r\x0b c b A"), (2, "\t\x0b\n \r\x0c\n"), (3, " \nA")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (rows[0][1], 1, 0), 1: ("", 1, 1), 2: (rows[2][1], 0, 0), 3: (rows[3][1], 1, 0)}

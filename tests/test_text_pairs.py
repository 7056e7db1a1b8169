"""Edit distances of many pairs at once, and shared tokens counted inside their rows."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import sequences
from foliospark.functions import text as t
from foliospark.operators import metrics as m


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abcdefghij xyz", "aé漢字😀b"])
def test_pairs_side_by_side_have_the_plain_distance(letters, monkeypatch):
    monkeypatch.setattr(sequences, "LEAST_LANES", 1)
    r = random.Random(len(letters))
    sizes = [0, 1, 5, 63, 64, 65, 127, 128, 129, 200, 330]
    a = ["".join(r.choice(letters) for _ in range(r.choice(sizes))) for _ in range(120)]
    changed = ["".join(r.choice(["", x + "z", "Q"]) if r.random() < 0.2 else x for x in text) for text in a]
    b = [x if r.random() < 0.6 else r.choice(a)[r.randrange(40):] for x in changed]
    assert sequences.text_distances(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]
    monkeypatch.setattr(sequences, "LANE_TEXT", 1000)
    assert sequences.text_distances(b, a).tolist() == [plain(x, y) for x, y in zip(a, b)]


def test_pairs_of_a_batch_are_not_taken_one_by_one(monkeypatch):
    def alone(a, b):
        raise AssertionError("a pair went alone")

    monkeypatch.setattr(sequences, "_distance", alone)
    a = ["ab" * (40 + i % 20) for i in range(200)]
    assert sequences.text_distances(a, [x.replace("b", "c", 3) for x in a]).tolist() == [3] * 200


def test_edit_distance_of_short_long_and_null_texts(spark):
    rows = [(0, "abc", "abd"), (1, "x" * 70, "x" * 60 + "y" * 12), (2, None, "x" * 90), (3, "é" * 300, "e" + "é" * 298), (4, "", "ab"), (5, "a" * 65, "a" * 65)]
    got = spark.createDataFrame(rows, "id int, a string, b string").select("id", t.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert {r["id"]: r["d"] for r in got} == {0: 1, 1: 12, 2: None, 3: 2, 4: 2, 5: 0}


QA = [("c", 1, "the cat sat", "the cat"), ("c", 2, "a b", "a b c"), ("c", 2, "c", "a b c"), ("d", 1, "", ""), ("d", 2, "x", ""), (None, 1, "q", "r")]


def test_tokens_of_lone_rows_are_counted_inside_the_row(spark):
    rows = spark.createDataFrame(QA, "conv string, turn int, pred string, ref string")
    sums = m.multiset_sums(rows, ["conv", "turn"], t.words(F.col("pred")), t.words(F.col("ref")))
    got = {(r["conv"], r["turn"]): (r["_rows"], r["_c"], r["_np"], r["_nr"]) for r in sums.collect()}
    assert got == {("c", 1): (1, 2, 3, 2), ("c", 2): (2, 3, 3, 6), ("d", 1): (1, None, None, None), ("d", 2): (1, 0, 1, 0), (None, 1): (1, 0, 1, 1)}


def test_rollup_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame(QA, "conv string, turn int, pred string, ref string")
    f1 = {(r["conv"], r["turn"], r["pred"]): round(r["f1"], 6) for r in m.token_f1(rows, ["conv", "turn"]).collect()}
    # rows with equal ids share their tokens; a row without an id has none
    assert f1 == {("c", 1, "the cat sat"): 0.8, ("c", 2, "a b"): 0.666667, ("c", 2, "c"): 0.666667, ("d", 1, ""): 1.0, ("d", 2, "x"): 0.0, (None, 1, "q"): 1.0}
    got = {r["conv"]: (r["qa_count"], r["qa_em"], r["qa_f1"]) for r in m.qa_rollup(rows, ["conv", "turn"], "conv").collect()}
    assert got == {"c": (2, 0.0, 0.7333), "d": (2, 0.5, 0.5), None: (1, 0.0, 1.0)}

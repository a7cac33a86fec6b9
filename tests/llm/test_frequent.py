from collections import Counter

from brindle.llm.frequent import count_values, frequent_values, top_values

ROWS = [("a", "x"), ("a", None), ("a", "x"), ("b", "y"), (None, "y"), ("c", "X"), ("d", "z"), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(*row, "clash") for row in rows], "p string, o string, field string")


def test_counts_and_ties(spark):
    counts = {(r.field, r.item): r.n for r in count_values(frame(spark, ROWS), ["p", "o"]).collect()}
    assert counts == {("p", k): v for k, v in Counter(r[0] for r in ROWS).items()} | {("o", k): v for k, v in Counter(r[1] for r in ROWS).items()}
    top = sorted((r.field, r.rank, r.item, r.n) for r in top_values(frame(spark, ROWS), ["p", "o"], 2).collect())
    assert top == [("o", 1, "x", 2), ("o", 2, "y", 2), ("p", 1, "a", 3), ("p", 2, "b", 1)]
    assert top_values(frame(spark, ROWS), ["p"], 100).count() == 4


def test_share_counts_rows_with_nulls(spark):
    assert {(r.field, r.item) for r in frequent_values(frame(spark, ROWS), ["p", "o"], 0.25).collect()} == {("p", "a"), ("o", "x"), ("o", "y")}
    assert {r.item for r in frequent_values(frame(spark, ROWS), ["p"], 0.375).collect()} == {"a"}
    assert frequent_values(frame(spark, []), ["p", "o"], 0.005).collect() == []


def test_threshold_with_as_many_items_as_can_reach_it(spark):
    rows = [(f"k{k}", "same") for k in range(200)]
    assert frequent_values(frame(spark, rows), ["p", "o"], 0.005).count() == 201


def test_numbers_and_long_values(spark):
    df = spark.range(10).selectExpr("id % 2 as p", "repeat('x', 200000) as o")
    found = {(r.field, len(r.item), r.n) for r in top_values(df, ["p", "o"], 5).collect()}
    assert found == {("p", 1, 5), ("o", 200000, 10)}

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.operators.hotkeys import frequent_keys, join_counts, join_sums, key_profile, side_rows

ROWS = [(1, 2), (1, 2), (1, 3), (1, None), (None, 2), (2, 1), (2, 2), (None, None), (5, None)] + [(1, k % 7) for k in range(200)]


def frame(spark, rows):
    return spark.createDataFrame([(*row, "clash", k) for k, row in enumerate(rows)], "a long, b long, n string, k long")


def test_states_of_each_side(spark):
    want = {}
    for side, own, other in (("s", 0, 1), ("o", 1, 0)):
        rows, partners = Counter(), defaultdict(set)
        for row in ROWS:
            rows[row[own]] += 1
            partners[row[own]].add(row[other])
        want |= {(side, k): (n, len(partners[k] - {None})) for k, n in rows.items() if k is not None}
    profile = key_profile(frame(spark, ROWS), "a", "b")
    assert {(r.side, r.k): (r.n_rows, r.n_partners) for r in side_rows(profile).collect()} == want
    paths = {r.k: int(r.paths) for r in profile.collect()}
    assert paths[1] == sum(1 for x in ROWS for y in ROWS if x[1] == y[0] == 1)


def test_share_counts_all_rows(spark):
    rows = [(1, 1)] * 10 + [(None, 2)] * 90
    assert {(r.side, r.k) for r in frequent_keys(frame(spark, rows), "a", "b", 0.1).collect()} == {("s", 1), ("o", 1), ("o", 2)}
    assert frequent_keys(frame(spark, rows), "a", "b", 0.11).count() == 1


def test_empty_table(spark):
    assert key_profile(frame(spark, []), "a", "b").collect() == []
    assert frequent_keys(frame(spark, []), "a", "b", 0.01).collect() == []


def test_joins_without_joining(spark):
    left = spark.createDataFrame([(1, "x", 2), (1, "x", 3), (1, "y", 5), (None, "x", 7), (2, "y", None)], "id long, g string, v long")
    right = spark.createDataFrame([(1, "u"), (1, "u"), (2, "w"), (None, "u"), (3, "w")], "id long, h string")
    plain = left.join(right, "id").groupBy("g", "h").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    want = {(r.g, r.h): (r.n, r.total) for r in plain.collect()}
    got = {(r.g, r.h): (int(r.n), r.total) for r in join_sums(left, right, "id", ["g"], ["h"], F.col("v")).collect()}
    assert got == want
    assert {(r.g, r.h): int(r.n) for r in join_counts(left, right, "id", ["g"], ["h"]).collect()} == {k: v[0] for k, v in want.items()}
    with pytest.raises(ValueError):
        join_counts(left, right, "id", ["g"], ["g"])

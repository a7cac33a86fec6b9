"""Joins that make far more rows than go in have the rows of a plain join, and their pairs are spread over tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.engine import sparql
from brindle.plans.compile import _blocks
from brindle.plans.order import Statistics, multiplies
from brindle.plans.syntax import Const, Pattern, Var
from brindle.sources.graph import FrameGraph


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
@pytest.mark.parametrize("sizes", [{"x": (9, 7), "y": (1, 40), "z": (25, 1), "only left": (5, 0), "only right": (0, 5), "": (2, 2)}, {"x": (4, 0)}])
def test_same_rows_as_a_plain_join(spark, sizes, block_rows):
    left = spark.createDataFrame([(n, f"l{i}") for n, (k, _) in sizes.items() for i in range(k)], "n string, c string")
    right = spark.createDataFrame([(n, f"r{i}") for n, (_, k) in sizes.items() for i in range(k)], "n string, s string")
    got = _blocks(left, right, ["n"], block_rows)
    assert got.columns == ["n", "c", "s"]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "n").collect()))


def test_same_rows_by_two_keys(spark):
    left = spark.range(60).selectExpr("id % 2 as a", "id % 3 as b", "id as c")
    right = spark.range(30).selectExpr("id % 3 as b", "id as s", "id % 2 as a")
    got = _blocks(left, right, ["a", "b"], 2).select("a", "b", "c", "s")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, ["a", "b"]).select("a", "b", "c", "s").collect()))


def test_the_pairs_of_one_key_are_made_by_many_tasks(spark):
    triples = spark.range(12_000).selectExpr("'<c/' || id || '>' as s", "'<a>' as p", "'<hub>' as o").unionByName(spark.range(300).selectExpr("'<s/' || id || '>' as s", "'<b>' as p", "'<hub>' as o"))
    graph = FrameGraph(triples, {"<a>": Statistics(12_000, 12_000, 1), "<b>": Statistics(300, 300, 1)})
    made = [r["count"] for r in sparql(graph, "SELECT ?c ?s WHERE { ?c <a> ?n . ?s <b> ?n }").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 12_000 * 300 and len(made) > 4 and max(made) < sum(made) / 2


def test_only_joins_of_few_keys_that_multiply_are_made_in_blocks():
    a, b = (Pattern(Var(s), Const(p), Var("n")) for s, p in (("x", "<a>"), ("y", "<b>")))
    assert multiplies([a], [b], {"<a>": Statistics(15e3, 15e3, 25), "<b>": Statistics(1e3, 1e3, 25)})
    assert not multiplies([a], [b], {"<a>": Statistics(1e5, 1e3, 1e3), "<b>": Statistics(1e5, 1e3, 1e3)})
    assert not multiplies([a], [b], {"<a>": Statistics(15e3, 15e3, 25), "<b>": Statistics(25, 25, 25)})
    assert not multiplies([a], [b], {})

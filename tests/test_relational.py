"""Stars over one table read it once; their rows are those of a plain triple table."""

from collections import Counter

import pytest

from brindle.engine import sparql
from brindle.sources.graph import FrameGraph
from brindle.sales import sales_graph

QUERIES = [
    'SELECT ?c ?a WHERE { ?c <c_name> ?a . ?c <c_mktsegment> "BUILDING" . ?c <c_nationkey> ?n }',
    "SELECT ?a ?n WHERE { <customer/3> <c_name> ?a . <customer/3> <c_nationkey> ?n }",
    "SELECT ?a WHERE { <customer/3> <c_name> ?a . <customer/3> <c_nationkey> <nation/999> }",
    "SELECT ?c WHERE { ?c <c_name> ?x . ?c <c_mktsegment> ?x }",
    "SELECT ?n ?m WHERE { ?c <c_nationkey> ?n . ?c <c_mktsegment> ?m . ?s <s_nationkey> ?n . ?s <s_name> ?x }",
    "SELECT ?n WHERE { ?n <n_name> ?x . <nation/3> <n_name> ?y . <nation/3> <n_regionkey> ?r . ?n <n_regionkey> ?r }",
    "SELECT ?n WHERE { ?n <n_name> ?x . <customer/x> <c_name> ?y . <customer/x> <c_mktsegment> ?z }",
    "SELECT ?n ?p WHERE { ?n ?p ?x . ?n <n_regionkey> <region/1> . ?n <n_name> ?y }",
]


@pytest.mark.parametrize("text", QUERIES)
def test_same_rows_as_over_triples(spark, data, text):
    graph = sales_graph(spark, data)
    small = ["<c_name>", "<c_mktsegment>", "<c_nationkey>", "<s_nationkey>", "<s_name>", "<n_name>", "<n_regionkey>"]
    frames = [sparql(graph, f"SELECT ?s ?o WHERE {{ ?s {p} ?o }}").selectExpr("s", f"'{p}' as p", "o") for p in small]
    triples = frames[0]
    for frame in frames[1:]:
        triples = triples.unionByName(frame)
    want = Counter(tuple(r) for r in sparql(FrameGraph(triples), text).collect())
    assert Counter(tuple(r) for r in sparql(graph, text).collect()) == want


def test_a_star_is_one_scan_and_constants_reach_it(spark, data):
    plan = sparql(sales_graph(spark, data), QUERIES[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "BUILDING)" in plan and "IsNotNull(c_mktsegment)" in plan and "Join" not in plan

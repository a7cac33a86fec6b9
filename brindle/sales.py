"""The sales and event tables as a graph, for the registered queries; the library itself knows none of these tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.plans.order import Statistics
from brindle.session import table
from brindle.sources.relational import Edge, Iri, Lit, RelationalGraph


def _followed(spark: SparkSession, root: str) -> DataFrame:
    """(a, b): the user of an event and of the next event of the same hour. The window is partitioned by the hour."""
    return table(spark, root, "events").selectExpr("user_id as a", "lead(user_id) over (partition by date_trunc('hour', ts) order by ts, event_id) as b")


_PLAIN = {
    "region": ("region", "r_regionkey", {"r_name": "text"}),
    "nation": ("nation", "n_nationkey", {"n_name": "text"}),
    "customer": ("customer", "c_custkey", {"c_name": "text", "c_acctbal": "decimal", "c_mktsegment": "text"}),
    "supplier": ("supplier", "s_suppkey", {"s_name": "text", "s_acctbal": "decimal"}),
    "part": ("part", "p_partkey", {"p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "text", "p_retailprice": "decimal"}),
    "orders": ("orders", "o_orderkey", {"o_orderstatus": "text", "o_totalprice": "decimal", "o_orderdate": "date", "o_orderpriority": "text"}),
    "events": ("event", "event_id", {"event_type": "text", "value": "decimal", "ts": "instant"}),
}

_LINKS = [
    Edge("<n_regionkey>", "nation", Iri("nation", "n_nationkey"), Iri("region", "n_regionkey")),
    Edge("<c_nationkey>", "customer", Iri("customer", "c_custkey"), Iri("nation", "c_nationkey")),
    Edge("<s_nationkey>", "supplier", Iri("supplier", "s_suppkey"), Iri("nation", "s_nationkey")),
    Edge("<o_custkey>", "orders", Iri("orders", "o_orderkey"), Iri("customer", "o_custkey")),
    Edge("<hasPart>", "lineitem", Iri("orders", "l_orderkey"), Iri("part", "l_partkey"), repeats=True),
    Edge("<hasSupplier>", "lineitem", Iri("orders", "l_orderkey"), Iri("supplier", "l_suppkey"), repeats=True),
    Edge("<byUser>", "events", Iri("event", "event_id"), Iri("user", "user_id")),
    Edge("<followedBy>", "followed", Iri("user", "a"), Iri("user", "b"), repeats=True),
]

#: What the planner assumes of these tables: their relative sizes.
_ROWS = {"region": 5, "nation": 25, "supplier": 1e3, "customer": 15e3, "part": 2e4, "orders": 15e4, "events": 1e5, "lineitem": 6e5, "followed": 1e5}
_OBJECTS = {"<n_regionkey>": 5, "<c_nationkey>": 25, "<s_nationkey>": 25, "<o_custkey>": 15e3, "<hasPart>": 2e4, "<hasSupplier>": 1e3, "<byUser>": 1e3, "<followedBy>": 1e3, "<c_mktsegment>": 5, "<o_orderstatus>": 3, "<o_orderpriority>": 5, "<event_type>": 5, "<r_name>": 5, "<n_name>": 25}


def sales_graph(spark: SparkSession, root: str) -> RelationalGraph:
    """The graph of the sales and event tables."""
    edges = {edge.predicate: edge for edge in _LINKS}
    for name, (kind, key, columns) in _PLAIN.items():
        for column, form in columns.items():
            edges[f"<{column}>"] = Edge(f"<{column}>", name, Iri(kind, key), Lit(column, form))
    known = {}
    for p, edge in edges.items():
        rows = _ROWS[edge.table]
        subjects = rows / 4 if edge.table == "lineitem" else 1e3 if edge.table == "followed" else rows
        known[p] = Statistics(rows, subjects, min(rows, _OBJECTS.get(p, rows)))
    return RelationalGraph(spark, root, edges, {"followed": _followed}, known)

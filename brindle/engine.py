"""The library's front: create databases, query them, serve them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession

from brindle.plans.compile import compile_query
from brindle.plans.syntax import Query, parse
from brindle.sources.graph import FrameGraph, Graph, StoredGraph
from brindle.sources.store import Store


def sparql(graph: Graph | DataFrame, text: str, multiway: bool | None = None) -> DataFrame:
    """The lazy answer of a query over a graph, or over a DataFrame with the columns s, p and o.

    ``multiway`` tells whether cycles are closed by multiway steps; by default the statistics decide, see ``compile_query``.
    """
    return compile_query(graph if isinstance(graph, Graph) else FrameGraph(graph), parse(text), multiway)


@dataclass
class Answer:
    """All rows of a query, as lists of strings, with the milliseconds that planning, execution and both took."""

    variables: list[str]
    rows: list[list[str | None]]
    plan_ms: float
    execute_ms: float

    @property
    def total_ms(self) -> float:
        return self.plan_ms + self.execute_ms


class Engine:
    """Databases below ``root``; opened ones are kept, as opening reads their statistics."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self._open: dict[str, StoredGraph] = {}

    def create(self, name: str, file: str) -> dict[str, int]:
        """Build a database from a file of triples, in place of one of that name."""
        self.close(name)
        return self.store.create_from_file(name, file)

    def graph(self, name: str) -> StoredGraph:
        if name not in self._open:
            self._open[name] = self.store.open(name)
        return self._open[name]

    def close(self, name: str) -> None:
        graph = self._open.pop(name, None)
        if graph:
            graph.release()

    def delete(self, name: str) -> bool:
        self.close(name)
        return self.store.delete(name)

    def query(self, name: str, text: str) -> DataFrame:
        """The lazy answer of a query over a database."""
        return sparql(self.graph(name), text)

    def stream(self, name: str, text: str) -> tuple[list[str], Iterator[list[str | None]]]:
        """The variables of a query and its rows one after another: the driver holds one partition of the answer at a time."""
        frame = self.query(name, text)
        return frame.columns, ([None if x is None else str(x) for x in row] for row in frame.toLocalIterator())

    def answer(self, name: str, text: str) -> Answer:
        """All rows of a query as a list, for answers that a user means to hold; ``stream`` gives those of any size."""
        began = perf_counter()
        query: Query = parse(text)
        frame = compile_query(self.graph(name), query)
        planned = perf_counter()
        rows = [[None if x is None else str(x) for x in row] for row in frame.toLocalIterator()]
        return Answer(frame.columns, rows, (planned - began) * 1e3, (perf_counter() - planned) * 1e3)

    def serve(self, ip: str = "127.0.0.1", port: int = 8080, name: str | None = None, origin: str = "*") -> None:
        """Serve the databases, or one of them only, over HTTP until a client disconnects."""
        from brindle.server import serve

        serve(self, ip, port, name, origin)

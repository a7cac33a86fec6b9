"""A graph over relational tables, without writing any triple.

Each predicate is a column of a table: its subjects are IRIs made of the table's key, its objects IRIs of a foreign key or
literals. A constant in a pattern is translated back to a filter on the raw column, which the Parquet scan gets pushed;
only the columns of a pattern are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.order import Statistics
from brindle.plans.syntax import Const, Pattern
from brindle.session import table
from brindle.sources.graph import Graph


@dataclass(frozen=True)
class Iri:
    """The IRI ``<kind/key>`` of a whole-number key column."""

    kind: str
    column: str

    def render(self) -> Column:
        return F.concat(F.lit(f"<{self.kind}/"), F.col(self.column).cast("string"), F.lit(">"))

    def equals(self, text: str) -> Column | None:
        """The filter on the raw key, or null if no key renders as ``text``."""
        found = re.fullmatch(rf"<{re.escape(self.kind)}/(0|-?[1-9][0-9]{{0,18}})>", text)
        return F.col(self.column) == F.lit(int(found.group(1))) if found else None


@dataclass(frozen=True)
class Lit:
    """The literal of a column: text as it is, doubles with two fraction digits, days and instants in ISO form."""

    column: str
    form: str = "text"

    def render(self) -> Column:
        value = F.col(self.column)
        shown = {
            "text": lambda: value.cast("string"),
            "decimal": lambda: value.cast("decimal(18,2)").cast("string"),
            "date": lambda: F.date_format(value, "yyyy-MM-dd"),
            "instant": lambda: F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        }[self.form]()
        return F.concat(F.lit('"'), shown, F.lit('"'))

    def equals(self, text: str) -> Column | None:
        if not (len(text) >= 2 and text[0] == text[-1] == '"'):
            return None
        return F.col(self.column).cast("string") == text[1:-1] if self.form == "text" else self.render() == text


@dataclass(frozen=True)
class Edge:
    """Where the triples of one predicate come from; ``repeats`` if a triple may come from several rows."""

    predicate: str
    table: str
    subject: Iri
    object: Iri | Lit
    repeats: bool = False


@dataclass
class RelationalGraph(Graph):
    """The graph of ``edges`` over the tables below ``root``; ``views`` makes tables that aren't stored as such."""

    session: SparkSession
    root: str
    edges: dict[str, Edge]
    views: dict[str, Callable[[SparkSession, str], DataFrame]]
    known: dict[str, Statistics]
    is_set = True

    @property
    def spark(self) -> SparkSession:
        return self.session

    def statistics(self) -> dict[str, Statistics]:
        return self.known

    def _edge(self, edge: Edge, pattern: Pattern) -> DataFrame | None:
        filters = []
        for term, place in ((pattern.s, edge.subject), (pattern.o, edge.object)):
            if isinstance(term, Const):
                test = place.equals(term.text)
                if test is None:
                    return None
                filters.append(test)
        rows = self._rows(edge.table)
        for test in filters:
            rows = rows.where(test)
        rows = rows.where(F.col(edge.subject.column).isNotNull() & F.col(edge.object.column).isNotNull())
        if edge.repeats:
            rows = rows.select(*dict.fromkeys((edge.subject.column, edge.object.column))).distinct()
        return rows.select(edge.subject.render().alias("s"), F.lit(edge.predicate).alias("p"), edge.object.render().alias("o"))

    def _rows(self, name: str) -> DataFrame:
        return self.views[name](self.session, self.root) if name in self.views else table(self.session, self.root, name)

    def same_row(self, patterns: list[Pattern]) -> tuple[list[Pattern], DataFrame] | None:
        """All patterns with the subject of the first whose predicates are columns of one table with that key."""
        if not isinstance(patterns[0].p, Const) or patterns[0].p.text not in self.edges:
            return None
        first = self.edges[patterns[0].p.text]
        taken = []
        for pattern in patterns:
            edge = self.edges.get(pattern.p.text) if isinstance(pattern.p, Const) else None
            if edge and not edge.repeats and pattern.s == patterns[0].s and (edge.table, edge.subject) == (first.table, first.subject):
                taken.append((pattern, edge))
        if len(taken) < 2:
            return None
        tests = [F.col(first.subject.column).isNotNull(), *(F.col(edge.object.column).isNotNull() for _, edge in taken)]
        tests += [edge.object.equals(pattern.o.text) for pattern, edge in taken if isinstance(pattern.o, Const)]
        if isinstance(patterns[0].s, Const):
            tests.append(first.subject.equals(patterns[0].s.text))
        rows = self._rows(first.table)
        for test in tests:
            rows = rows.where(F.lit(False) if test is None else test)
        objects = [edge.object.render().alias(f"o{k}") for k, (_, edge) in enumerate(taken)]
        return [pattern for pattern, _ in taken], rows.select(first.subject.render().alias("s"), *objects)

    def scan(self, pattern: Pattern) -> DataFrame:
        if isinstance(pattern.p, Const):
            edges = [self.edges[pattern.p.text]] if pattern.p.text in self.edges else []
        else:
            edges = list(self.edges.values())
        found = [rows for edge in edges if (rows := self._edge(edge, pattern)) is not None]
        if not found:
            return self.session.createDataFrame([], "s string, p string, o string")
        out = found[0]
        for rows in found[1:]:
            out = out.unionByName(rows)
        return out

"""Graphs: sets of (s, p, o) triples that patterns are matched against."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.order import UNKNOWN, Statistics
from brindle.plans.syntax import Const, Pattern, Var


class Graph:
    """What the compiler needs of a graph. ``is_set`` tells that ``scan`` never gives a triple twice."""

    spark: SparkSession
    is_set = True

    def scan(self, pattern: Pattern) -> DataFrame:
        """(s, p, o) of at least the triples that match the constants of ``pattern``, and of none that doesn't."""
        raise NotImplementedError

    def same_row(self, patterns: list[Pattern]) -> tuple[list[Pattern], DataFrame] | None:
        """Patterns that one row answers together, the first of ``patterns`` among them, and a frame of such rows with the
        columns s, o0, o1, ... in their order; null if the graph has no such rows. It spares a star its self joins."""
        return None

    def statistics(self) -> dict[str, Statistics]:
        return {}

    def total(self) -> Statistics:
        known = self.statistics().values()
        return Statistics(*(sum(getattr(x, f) for x in known) for f in ("rows", "subjects", "objects"))) if known else UNKNOWN


def constants(df: DataFrame, pattern: Pattern) -> DataFrame:
    """``df`` (s, p, o) with an equality filter, which Parquet gets pushed, for each constant of ``pattern``."""
    for column, term in zip("spo", pattern.terms(), strict=True):
        if isinstance(term, Const):
            df = df.where(F.col(column) == term.text)
    return df


@dataclass
class FrameGraph(Graph):
    """The triples of any DataFrame with the columns s, p and o. Rows with a null are no triples; repeated rows count once."""

    frame: DataFrame
    known: dict[str, Statistics] | None = None
    is_set = False

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession

    def scan(self, pattern: Pattern) -> DataFrame:
        held = self.frame.select("s", "p", "o")
        for column, term in zip("spo", pattern.terms(), strict=True):
            if not isinstance(term, Const):
                held = held.where(F.col(column).isNotNull())
        return constants(held, pattern)

    def statistics(self) -> dict[str, Statistics]:
        return self.known or {}

    def analyzed(self, most: int = 10_000) -> FrameGraph:
        """The same graph with statistics for the join order, from one aggregation by predicate over all rows; those of the
        ``most`` largest predicates are kept. Distinct values are estimates within a few per cent."""
        rows = self.frame.select("s", "p", "o").where("s is not null and p is not null and o is not null")
        counts = rows.groupBy("p").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))
        found = counts.orderBy(F.desc("rows"), "p").limit(most).collect()
        return FrameGraph(self.frame, {row.p: Statistics(row.rows, row.subjects, row.objects) for row in found})


def part_of(p: str, heavy: dict[str, int], tail: int) -> int:
    """The partition that holds a predicate: its own if it is a heavy one, else one of ``tail`` shared ones."""
    return heavy[p] if p in heavy else -1 - zlib.crc32(p.encode()) % tail


@dataclass
class StoredGraph(Graph):
    """A database written by ``brindle.sources.store``. Patterns with a known predicate read its partition only."""

    session: SparkSession
    path: str
    heavy: dict[str, int]
    tail: int
    known: dict[str, Statistics]
    sums: Statistics
    kept: dict[str, DataFrame] = field(default_factory=dict)
    listed: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.session

    def preload(self, predicates: list[str]) -> None:
        """Keep the triples of some predicates in memory, spilling to disk, for queries that follow."""
        for p in predicates:
            if p not in self.kept:
                self.kept[p] = self.scan(Pattern(Var("s"), Const(p), Var("o"))).persist(StorageLevel.MEMORY_AND_DISK)

    def _triples(self, order: str) -> DataFrame:
        """All triples in one of the two orders; the list of files is read once for a graph."""
        if order not in self.listed:
            self.listed[order] = self.session.read.schema("s string, p string, o string, part int").parquet(f"{self.path}/{order}")
        return self.listed[order]

    def release(self) -> None:
        for frame in self.kept.values():
            frame.unpersist()
        self.kept.clear()

    def scan(self, pattern: Pattern) -> DataFrame:
        if isinstance(pattern.p, Const) and pattern.p.text in self.kept:
            return constants(self.kept[pattern.p.text], pattern)
        by_object = isinstance(pattern.o, Const) and not isinstance(pattern.s, Const)
        held = self._triples("pos" if by_object else "pso")
        if isinstance(pattern.p, Const):
            held = held.where(F.col("part") == part_of(pattern.p.text, self.heavy, self.tail))
        return constants(held.select("s", "p", "o"), pattern)

    def statistics(self) -> dict[str, Statistics]:
        return self.known

    def total(self) -> Statistics:
        return self.sums

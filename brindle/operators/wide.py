"""Attribute-value rows into wide tables with typed columns (problem 2).

The attributes and their types are found first: from a catalogue if there is one, else from the data by one aggregation.
The pivot is then a single aggregation by entity with one conditional aggregate for each attribute, so its plan has one
shuffle whatever the number of attributes, and equal keys are combined in the map tasks before it. Duplicates are
resolved explicitly: the latest statement wins, or all distinct values are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.terms import DATATYPES, canonical_value, content, with_canonical

#: The most attributes a wide table may get; more are refused rather than cut off.
MOST_ATTRIBUTES = 2_000

#: The fewest parts of a hot entity.
LEAST_PARTS = 256


@dataclass(frozen=True)
class Attribute:
    predicate: str
    datatype: str
    column: str


def attributes_of(catalogue: DataFrame) -> list[Attribute]:
    """The attributes of a catalogue with the columns (p, datatype, col_name), by column name.

    Rows without predicate, known datatype or column name are no attributes. Repeated rows count once; two attributes with
    one column name (letter case aside, as Spark has it) are refused, as are more than ``MOST_ATTRIBUTES``: the list is
    held by the driver, so it has a bound.
    """
    known = catalogue.where(F.col("p").isNotNull() & F.col("col_name").isNotNull() & F.col("datatype").isin(*DATATYPES))
    rows = known.select("p", "datatype", "col_name").distinct().limit(MOST_ATTRIBUTES + 1).collect()
    return _checked([Attribute(*row) for row in rows])


def attribute_types(triples: DataFrame, least_share: float = 1.0) -> DataFrame:
    """(p, n, datatype) of every predicate of ``triples`` (p, o) with literal values, n being their number.

    The type is the first of boolean, integer, decimal and date that at least ``least_share`` of the literals are lexical
    forms of, else string. All rows are read, in one aggregation by predicate that combines before its shuffle.
    """
    literals = triples.where("p is not null").select("p", "o", content(F.col("o")).alias("_text"))
    forms = {t: F.count(canonical_value(F.col("o"), F.lit(t))).alias(t) for t in ("boolean", "integer", "decimal", "date")}
    counts = literals.groupBy("p").agg(F.count("_text").alias("n"), *forms.values()).where("n > 0")
    part = Fraction(str(least_share))
    fits = F.coalesce(*(F.when(F.col(t) * part.denominator >= F.col("n") * part.numerator, F.lit(t)) for t in forms), F.lit("string"))
    return counts.select("p", "n", fits.alias("datatype"))


def discover_attributes(triples: DataFrame, least_share: float = 1.0) -> list[Attribute]:
    """The attributes of ``triples`` (p, o) without a catalogue: every predicate with literal values, see ``attribute_types``.

    The column is the predicate's last path step with other signs than letters and digits as ``_``; a number is added where
    two collide.
    """
    found, used = [], set()
    for p, datatype in sorted(attribute_types(triples, least_share).select("p", "datatype").limit(MOST_ATTRIBUTES + 1).collect()):
        step = "".join(c if c.isalnum() else "_" for c in p.strip("<>").rstrip("/#").replace("#", "/").rsplit("/", 1)[-1]) or "value"
        name, k = step, 1
        while name.lower() in used:
            k += 1
            name = f"{step}_{k}"
        used.add(name.lower())
        found.append(Attribute(p, datatype, name))
    return _checked(found)


def _checked(found: list[Attribute]) -> list[Attribute]:
    if len(found) > MOST_ATTRIBUTES:
        raise ValueError(f"more than {MOST_ATTRIBUTES} attributes")
    names, predicates = {a.column.lower() for a in found}, {a.predicate for a in found}
    if len(names) < len(found) or len(predicates) < len(found):
        raise ValueError("two attributes share a column name or a predicate")
    return sorted(found, key=lambda a: a.column)


def _typed(value: Column, datatype: str) -> Column:
    return value if datatype == "string" else value.try_cast(DATATYPES[datatype])


def _cells(triples: DataFrame, attributes: list[Attribute], *more: str) -> DataFrame:
    """(s, p, v, *more): rows of the attributes, v being the canonical text of the object, null where it is no value.

    Those nulls stay: a filter on v would be pushed below its expression, which would then be worked out twice.
    """
    by_type = F.lit(None).cast("string")
    for name in DATATYPES:
        of_type = [a.predicate for a in attributes if a.datatype == name]
        if of_type:
            by_type = F.when(F.col("p").isin(of_type), F.lit(name)).otherwise(by_type)
    held = triples.where(F.col("s").isNotNull() & F.col("p").isin([a.predicate for a in attributes]) & F.col("o").isNotNull())
    return with_canonical(held, F.col("o"), by_type, "v", "s", "p", *more)


def widen(triples: DataFrame, attributes: list[Attribute], order: list[str]) -> DataFrame:
    """(s, one typed column for each attribute): one row for each entity with at least one value.

    Of several values the one of the row that is last by ``order`` counts, a null there being first; of rows equal in it
    the greatest canonical text. A missing or unfit value is null. An integer beyond 64 bits and a decimal beyond
    36 digits before the point are null in their columns, and kept as text by ``cells``. Nulls in s, p and o, other
    predicates and other columns are ignored.
    """
    _single(triples, "s", "p", "o", *order)
    cells = _cells(triples, attributes, *order)
    picks = [F.max(F.when((F.col("p") == a.predicate) & F.col("v").isNotNull(), F.struct(*order, "v"))).alias(f"c{k}") for k, a in enumerate(attributes)]
    wide = cells.groupBy("s").agg(*picks).where(F.coalesce(F.lit(None).cast("boolean"), *(F.when(F.col(f"c{k}").isNotNull(), True) for k in range(len(attributes)))))
    return wide.select("s", *(_typed(F.col(f"c{k}.v"), a.datatype).alias(a.column) for k, a in enumerate(attributes)))


def widen_all(triples: DataFrame, attributes: list[Attribute], hot_share: float = 0.001, part_rows: int = 10_000) -> DataFrame:
    """(s, part, one array column for each attribute) with every distinct canonical value of each cell.

    A usual entity has one row, with part 0. An entity with more than ``hot_share`` of all distinct cells, and more than
    ``part_rows``, is split by a hash of its values over parts of at most about ``part_rows`` cells (``LEAST_PARTS`` parts at
    least), so that no task and no row has to hold an unbounded group; at most 1/hot_share entities can be hot, which bounds the list that is broadcast. Repeated
    statements are combined before the shuffle. The table is read once: the cells of an entity are counted in the
    aggregation that makes them distinct.
    """
    _single(triples, "s", "p", "o")
    cells = _cells(triples, attributes).distinct()
    counts = cells.groupBy(F.xxhash64("s").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg((F.sum("n") * F.lit(hot_share)).alias("n"))
    hot = counts.where(F.col("n") > F.greatest(total.scalar(), F.lit(part_rows))).select("h", F.greatest(F.lit(LEAST_PARTS), F.ceil(F.col("n") / part_rows)).alias("parts"))
    spread = cells.withColumn("h", F.xxhash64("s")).join(F.broadcast(hot), "h", "left")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("p", "v"), F.col("parts")).cast("int"))
    lists = [F.collect_list(F.when(F.col("p") == a.predicate, F.col("v"))).alias(a.column) for a in attributes]
    return spread.groupBy("s", part.alias("part")).agg(*lists)


def cells(triples: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """(s, p, v): the filled cells of ``widen_all``, one row for each distinct value of an entity's attribute."""
    wide = widen_all(triples, attributes)
    pairs = F.array(*(F.struct(F.lit(a.predicate).alias("p"), F.col(a.column).alias("vs")) for a in attributes))
    filled = wide.select("s", F.explode(F.filter(pairs, lambda x: F.size(x.vs) > 0)).alias("cell"))
    return filled.select("s", "cell.p", F.explode("cell.vs").alias("v"))


def _single(df: DataFrame, *columns: str) -> None:
    for column in columns:
        if df.columns.count(column) != 1:
            raise ValueError(f"the table must have one column {column!r}, it has {df.columns}")

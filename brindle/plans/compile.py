"""From a parsed query to a lazy DataFrame. Nothing here runs a job."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.terms import content
from brindle.plans.order import estimated_rows, expands, multiplies, ordered
from brindle.plans.syntax import Comparison, Pattern, Query, Term, Var
from brindle.sources.graph import Graph


def _internal(name: str) -> str:
    """Column names that keep variables apart which differ in letter case only."""
    return "v_" + "".join(f"{c.lower()}_" if c.isupper() else c.replace("_", "__") for c in name)


def _bindings(found: DataFrame, places: list[tuple[str, Term]]) -> DataFrame:
    """A column for each variable of ``places`` (column, term); equal variables must be bound alike.

    Without a variable it is one row without meaning if there is a row at all, else none.
    """
    bound: dict[str, str] = {}
    for column, term in places:
        if isinstance(term, Var):
            if term.name in bound:
                found = found.where(F.col(bound[term.name]) == F.col(column))
            else:
                bound[term.name] = column
    if not bound:
        return found.select(F.lit(1).alias("exists")).limit(1)
    return found.select(*(F.col(column).alias(_internal(name)) for name, column in bound.items()))


@dataclass
class Input:
    """What is joined: the bindings of some patterns, with repetitions if ``repeats``, and their estimated number."""

    frame: DataFrame
    patterns: list[Pattern]
    repeats: bool
    rows: float

    @property
    def columns(self) -> list[str]:
        return self.frame.columns

    def distinct(self) -> DataFrame:
        return self.frame.distinct() if self.repeats else self.frame

    def keys(self, columns: list[str]) -> DataFrame:
        """The distinct values of some columns: that combines a hot key in the map tasks."""
        return self.frame.select(columns).distinct()


def match(graph: Graph, pattern: Pattern) -> DataFrame:
    """The bindings of one pattern, each once."""
    return _inputs(graph, [pattern])[0].distinct()


def _inputs(graph: Graph, patterns: list[Pattern]) -> list[Input]:
    """The inputs to join, in the order of ``patterns``; patterns that one row answers share an input."""
    out, rest = [], list(patterns)
    while rest:
        shared = graph.same_row(rest)
        if shared:
            taken, rows = shared
            frame, repeats = _bindings(rows, [("s", taken[0].s), *((f"o{k}", p.o) for k, p in enumerate(taken))]), False
        else:
            taken = rest[:1]
            frame = _bindings(graph.scan(rest[0]), list(zip("spo", rest[0].terms(), strict=True)))
            # Constants and variables fix all three places, so the set of triples is the set of bindings.
            repeats = not graph.is_set and bool(rest[0].variables())
        out.append(Input(frame, taken, repeats, min(estimated_rows(p, graph.statistics(), graph.total()) for p in taken)))
        rest = [p for p in rest if p not in taken]
    return out


def _closing(result: DataFrame, waiting: list[Input]) -> list[int]:
    """The numbers of at least two inputs that bind one and the same new variable, their other variables being bound."""
    by_new: dict[str, list[int]] = {}
    for k, one in enumerate(waiting):
        new = [c for c in one.columns if c not in result.columns]
        if len(new) == 1 and len(one.columns) > 1:
            by_new.setdefault(new[0], []).append(k)
    return next((found for found in by_new.values() if len(found) > 1), [])


def _multiway(result: DataFrame, inputs: list[DataFrame]) -> DataFrame:
    """Bind the variable that all ``inputs`` add to ``result``, at the cost of the least of them for each row.

    The number of matches of each row in each input comes from one aggregation by its bound columns; rows without a match
    anywhere are gone before anything is expanded. Each row is then expanded by the input with the fewest matches, and the
    other inputs are tested by semi joins on all their columns.
    """
    keys = [[c for c in one.columns if c in result.columns] for one in inputs]
    for k, (one, key) in enumerate(zip(inputs, keys, strict=True)):
        result = result.join(one.groupBy(*key).agg(F.count(F.lit(1)).alias(f"matches_{k}")), key)
    counts = [F.col(f"matches_{k}") for k in range(len(inputs))]
    chosen = F.coalesce(*(F.when(count == F.least(*counts), k) for k, count in enumerate(counts)))
    parts = []
    for k, (one, key) in enumerate(zip(inputs, keys, strict=True)):
        part = result.where(chosen == k).drop(*(f"matches_{j}" for j in range(len(inputs)))).join(one, key)
        for j, other in enumerate(inputs):
            if j != k:
                part = part.join(other, other.columns, "left_semi")
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def _narrowed(one: Input, shared: list[str], done: list[Input]) -> DataFrame:
    """The distinct bindings of ``one`` that may meet what was joined before it on ``shared``.

    Where an earlier input with far fewer rows binds these variables too, a semi join with its keys comes first: it leaves less to
    make distinct, and the partitioning by key then serves the semi join, the distinct and the join.
    """
    if one.repeats:
        few = [other for other in done if set(shared) <= set(other.columns) and other.rows * 4 <= one.rows]
        if few:
            return one.frame.join(min(few, key=lambda other: other.rows).keys(shared), shared, "left_semi").distinct()
    return one.distinct()


#: Rows of one key on either side from which its pairs are made in blocks, of at most about so many rows by so many.
BLOCK_ROWS = 1024
#: Keys split into blocks, those with the most blocks. Each other key has less than one in so many of all blocks.
SPLIT_KEYS = 10_000


def _blocks(left: DataFrame, right: DataFrame, shared: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The join of two sets of rows on ``shared`` whose result is far larger than both.

    The pairs of a key are dealt out as a grid of blocks by hashes of the whole rows: a row of the left goes to its line of the grid, a
    row of the right to its column, each copied along it. The copies are at most about 2 / ``block_rows`` of the pairs. The number of
    tasks is fixed, as adaptive execution would merge tasks by the bytes that they read, whatever they make of them.
    """
    counts = left.groupBy(*shared).agg(F.count(F.lit(1)).alias("rows_l")).join(right.groupBy(*shared).agg(F.count(F.lit(1)).alias("rows_r")), shared)
    lines, columns = (F.max(F.ceil(F.col(rows) / block_rows)).cast("int").alias(name) for rows, name in (("rows_l", "lines"), ("rows_r", "columns")))
    hot = counts.where(F.greatest("rows_l", "rows_r") > block_rows).groupBy(F.xxhash64(*shared).alias("key_hash")).agg(lines, columns)
    hot = F.broadcast(hot.orderBy(F.desc(F.col("lines").cast("long") * F.col("columns")), "key_hash").limit(SPLIT_KEYS))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)

    def dealt(side: DataFrame, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        parts = {name: F.coalesce(name, F.lit(1)) for name in (own_parts, other_parts)}
        placed = side.withColumn("key_hash", F.xxhash64(*shared)).join(hot, "key_hash", "left")
        own_part = F.pmod(F.xxhash64(*side.columns), parts[own_parts]).cast("int").alias(own)
        placed = placed.select(*side.columns, own_part, F.explode(F.sequence(F.lit(0), parts[other_parts] - 1)).alias(other))
        return placed.repartition(tasks, *shared, "line", "column")

    pairs = dealt(left, "line", "lines", "column", "columns").hint("merge").join(dealt(right, "column", "columns", "line", "lines"), [*shared, "line", "column"])
    return pairs.drop("line", "column")


def _conjunction(graph: Graph, patterns: tuple[Pattern, ...], wanted: set[str] | None = None, multiway: bool | None = None) -> DataFrame:
    """The inner join of all patterns. Each is an input of its own, joined on every variable that is bound already; inputs
    that close a cycle by one new variable are taken in one step where the statistics call for it, or as ``multiway`` tells.

    With ``wanted`` the columns that are used afterwards are known and duplicates don't matter: an input that only tests
    whether something exists is then a semi join, which never multiplies rows.
    """
    result: DataFrame | None = None
    waiting, done = _inputs(graph, ordered(patterns, graph.statistics(), graph.total())), []
    while waiting:
        # A frame of several patterns may have come before what connects it: it waits for that.
        closing = _closing(result, waiting) if multiway is not False and result is not None else []
        if closing:
            bound, open_ = [p for one in done for p in one.patterns], [p for k in closing for p in waiting[k].patterns]
            if multiway or expands(bound, open_, graph.statistics(), graph.total()):
                result = _multiway(result, [waiting[k].distinct() for k in closing])
                done += [waiting[k] for k in closing]
                waiting = [one for k, one in enumerate(waiting) if k not in closing]
                continue
        at = 0 if result is None else next((k for k, one in enumerate(waiting) if set(one.columns) & set(result.columns)), 0)
        one = waiting.pop(at)
        if result is None:
            result = one.distinct()
        else:
            shared = [c for c in one.columns if c in result.columns and c != "exists"]
            used = None if wanted is None else wanted.union(*(set(x.columns) for x in waiting))
            if used is not None and shared and not (set(one.columns) - set(shared)) & used:
                # The distinct keys and the join use the same exchange.
                result = result.join(one.keys(shared), shared, "left_semi")
            elif used is not None and shared and not (set(result.columns) - set(shared)) & used:
                result = one.distinct().join(result.select(shared).distinct(), shared, "left_semi")
            elif shared and multiplies([p for x in done for p in x.patterns], one.patterns, graph.statistics(), graph.total()):
                result = _blocks(result, _narrowed(one, shared, done), shared)
            else:
                result = result.join(_narrowed(one, shared, done), shared) if shared else result.crossJoin(one.distinct())
        done.append(one)
        if "exists" in result.columns and len(result.columns) > 1:
            result = result.drop("exists")
    if result is None:
        return graph.spark.range(1).select(F.lit(1).alias("exists"))
    return result


def _optional(result: DataFrame, inner: DataFrame) -> DataFrame:
    """``result`` with the bindings of an optional group where there are any.

    A group without a shared variable is a cross product if it has a row at all, else nulls. It is written as these two cases: an
    outer join without keys would broadcast the whole group, whatever its size.
    """
    shared = [c for c in inner.columns if c in result.columns]
    if shared:
        return result.join(inner, shared, "left")
    found = inner.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    alone = result.where(found == 0).select("*", *(F.lit(None).cast(inner.schema[c].dataType).alias(c) for c in inner.columns))
    return result.crossJoin(inner).unionByName(alone)


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _never_a_number(text: str) -> bool:
    """Whether a value surely is no number, so that its comparison is a plain one that scans get pushed."""
    inner = text[1 : text.rindex('"')] if text.startswith('"') and text.count('"') > 1 else text
    return not re.search(r"\d", inner) and not re.fullmatch(r"\s*[+-]?(?:nan|inf|infinity)\s*", inner, re.IGNORECASE)


def condition(test: Comparison) -> Column:
    """Numbers are compared as such if both sides are; else terms are equal if written alike, and ordered by their
    content, by code points. An unbound variable fulfils nothing."""
    term = F.col(_internal(test.variable))
    text = F.coalesce(content(term), term)

    def one(value: str) -> Column:
        other = F.lit(value)
        other_text = F.coalesce(content(other), other)
        both = _number(text).isNotNull() & _number(other_text).isNotNull()
        compare = {
            "=": (lambda a, b: a == b, lambda: term == other),
            "!=": (lambda a, b: a != b, lambda: term != other),
            "<": (lambda a, b: a < b, lambda: text < other_text),
            "<=": (lambda a, b: a <= b, lambda: text <= other_text),
            ">": (lambda a, b: a > b, lambda: text > other_text),
            ">=": (lambda a, b: a >= b, lambda: text >= other_text),
        }[test.operator]
        if _never_a_number(value):
            return compare[1]()
        return F.when(both, compare[0](_number(text), _number(other_text))).otherwise(compare[1]())

    return reduce(lambda a, b: a | b, map(one, test.values))


def compile_query(graph: Graph, query: Query, multiway: bool | None = None) -> DataFrame:
    """The answer of ``query``: a bag of rows with one STRING column for each selected variable.

    OPTIONAL groups are joined to the required patterns in their order of writing, FILTERs are applied to the result,
    then come projection, DISTINCT or COUNT, and LIMIT. COUNT gives each distinct row with its number of occurrences.
    ``multiway`` closes cycles by ``_multiway`` always or never instead of by what the statistics show. It is two small
    joins more where few rows are made anyway, but a hub that a binary join would square stays linear.
    """
    wanted = None
    if query.modifier == "DISTINCT":
        wanted = {_internal(name) for name in query.projection} | {_internal(f.variable) for f in query.filters}
        wanted |= {_internal(name) for group in query.optionals for p in group for name in p.variables()}
    result = _conjunction(graph, query.patterns, wanted, multiway)
    required = set().union(*(p.variables() for p in query.patterns))
    early = [f for f in query.filters if f.variable in required]
    for test in early:
        result = result.where(condition(test))
    for group, tests in zip(query.optionals, query.optional_filters, strict=True):
        inner = _conjunction(graph, group, multiway=multiway)
        for test in tests:
            inner = inner.where(condition(test))
        result = _optional(result, inner)
    for test in query.filters:
        if test not in early:
            result = result.where(condition(test))
    rows = result.select(*(F.col(_internal(name)).alias(name) for name in query.projection))
    if query.modifier == "DISTINCT":
        rows = rows.distinct()
    elif query.modifier == "COUNT":
        rows = rows.groupBy(*query.projection).agg(F.count(F.lit(1)).alias("count"))
    return rows if query.limit is None else rows.limit(query.limit)

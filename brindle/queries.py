"""Queries of the core for the driver, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle import graph_queries
from brindle.operators import hotkeys, rejects, wide
from brindle.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """(s, p, v): the filled cells of the wide table, every distinct value of each."""
    return wide.cells(table(spark, root, "dictionary"), wide.attributes_of(table(spark, root, "predicates")))


def p2_wide(spark: SparkSession, root: str) -> DataFrame:
    """One row for each entity, one typed column for each attribute, the latest statement of each."""
    attributes = wide.attributes_of(table(spark, root, "predicates"))
    return wide.widen(table(spark, root, "dictionary"), attributes, ["stated_at", "row_id"])


def p2_types(spark: SparkSession, root: str) -> DataFrame:
    """(p, n, datatype): the attributes that the data itself shows, with the type of nine tenths of their literals."""
    return wide.attribute_types(table(spark, root, "dictionary"), 0.9)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """(side, k): the ids with at least 1 % of all rows of ``store`` on a side."""
    return hotkeys.frequent_keys(table(spark, root, "store"), "s_set_", "o_set_", 0.01).select("side", "k")


def p4_keys(spark: SparkSession, root: str) -> DataFrame:
    """(side, k, n_rows, n_partners, paths) of every id on each side; paths counts the pairs of rows that meet in the id."""
    return hotkeys.side_rows(hotkeys.key_profile(table(spark, root, "store"), "s_set_", "o_set_"))


def p4_paths(spark: SparkSession, root: str) -> DataFrame:
    """(pid, next_pid, n): how many pairs of rows meet in an id that is an object of pid and a subject of next_pid."""
    store = table(spark, root, "store")
    left = store.selectExpr("o_set_ as id", "pid")
    right = store.selectExpr("s_set_ as id", "pid as next_pid")
    return hotkeys.join_counts(left, right, "id", ["pid"], ["next_pid"])


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """(line_id, reason): the lines that fail."""
    return rejects.rejected(rejects.load_lines(table(spark, root, "triple_lines")))


def p5_loaded(spark: SparkSession, root: str) -> DataFrame:
    """(line_id, s, p, o): the lines that were loaded."""
    return rejects.good_triples(rejects.load_lines(table(spark, root, "triple_lines")))


def _cells_sql() -> str:
    return r"""
        with t as (
            select d.s, d.p, a.col_name, a.datatype, d.row_id, d.stated_at,
                case when starts_with(o, '<') or starts_with(o, '_:') then null
                     when starts_with(o, '"') then
                        case when regexp_full_match(o, '"(.*)"(@[^"]*|\^\^[^"]*)?', 's') then regexp_extract(o, '^"(.*)"(@[^"]*|\^\^[^"]*)?$', 1, 's') end
                     else o end as t
            from dictionary d join predicates a on d.p = a.p
            where a.kind = 'attribute' and s is not null and o is not null
        ), u as (select *, trim(t, E' \t\r\n') as x from t where t is not null),
        c as (
            select s, p, col_name, datatype, row_id, stated_at, case datatype
                when 'string' then t
                when 'integer' then case when regexp_full_match(x, '[+-]?[0-9]+') then
                    case when starts_with(x, '-') and not regexp_full_match(x, '-0+') then '-' else '' end || regexp_extract(x, '^[+-]?0*([0-9]+)$', 1) end
                when 'decimal' then case when regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)') then
                    cast(abs(cast(x as decimal(38, 2))) * case when cast(x as decimal(38, 2)) < 0 then -1 else 1 end as varchar) end
                when 'date' then case when regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(x as date) is not null then x end
                when 'boolean' then case when x in ('true', '1') then 'true' when x in ('false', '0') then 'false' end
            end as v from u
        )
    """


def _wide_sql() -> str:
    types = {"integer": "bigint", "decimal": "decimal(38, 2)", "date": "date", "boolean": "boolean", "string": "varchar"}
    columns = {
        "integer": "elevation_m crew_size channel_count year_opened",
        "decimal": "mass_kg aperture_m fee_rate drift_ppm",
        "date": "commissioned_on inspected_on closed_on",
        "boolean": "is_mobile is_open_access needs_permit",
        "string": "serial_code status_code grid_ref",
    }
    picks = ", ".join(f"cast(max(case when col_name = '{c}' then v end) as {types[t]}) as {c}" for t, names in columns.items() for c in names.split())
    return f"""{_cells_sql()},
        r as (select *, row_number() over (partition by s, p order by stated_at desc nulls last, row_id desc nulls last, v desc) as k from c where v is not null)
        select s, {picks} from r where k = 1 group by s
    """


def _types_sql() -> str:
    return r"""
        with t as (
            select p, case when starts_with(o, '<') or starts_with(o, '_:') then null
                     when starts_with(o, '"') then
                        case when regexp_full_match(o, '"(.*)"(@[^"]*|\^\^[^"]*)?', 's') then regexp_extract(o, '^"(.*)"(@[^"]*|\^\^[^"]*)?$', 1, 's') end
                     else o end as t
            from dictionary where p is not null
        ), u as (select p, trim(t, E' \t\r\n') as x from t where t is not null),
        c as (
            select p, count(*) as n, count(*) filter (x in ('true', 'false', '0', '1')) as b, count(*) filter (regexp_full_match(x, '[+-]?[0-9]+')) as i,
                count(*) filter (regexp_full_match(x, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)')) as d,
                count(*) filter (regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(x as date) is not null) as t
            from u group by p
        )
        select p, n, case when b * 10 >= n * 9 then 'boolean' when i * 10 >= n * 9 then 'integer' when d * 10 >= n * 9 then 'decimal' when t * 10 >= n * 9 then 'date' else 'string' end as datatype from c
    """


def _lines_sql() -> str:
    uchar = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
    iri = rf'<(?:[^\x00-\x20<>"{{}}|^`\\]|{uchar})*>'
    blank = r"_:[A-Za-z0-9_:](?:[A-Za-z0-9_:.-]*[A-Za-z0-9_:-])?"
    literal = rf'"(?:[^"\\\n\r]|\\[tbnrf"Q\\]|{uchar})*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{iri})?'.replace("Q", "''")
    bare = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)|true|false"
    good = rf"^[ \t\r\n]*({iri}|{blank})[ \t]+({iri})[ \t]+({iri}|{blank}|{literal}|{bare})[ \t]*\.?[ \t\r\n]*$"
    return rf"""
        with m as (select line_id, regexp_extract(line, '{good}', ['s', 'p', 'o']) as x from triple_lines where regexp_matches(line, '{good}')),
        t as (select line_id, x.s as s, x.p as p, x.o as o from m)
        select line_id, s, p, o from t where not (
            (o like '"%"^^<xsd/integer>' and not regexp_full_match(o, '"[+-]?[0-9]+"\^\^<xsd/integer>'))
            or (o like '"%"^^<xsd/decimal>' and not regexp_full_match(o, '"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"\^\^<xsd/decimal>'))
            or (o like '"%"^^<xsd/boolean>' and not regexp_full_match(o, '"(true|false|1|0)"\^\^<xsd/boolean>'))
            or (o like '"%"^^<xsd/date>' and not (regexp_full_match(o, '"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"\^\^<xsd/date>')
                and try_cast(regexp_extract(o, '^"([^"]*)"', 1) as date) is not null)))
    """


def _rejects_sql() -> str:
    """Escaped signs are blotted out first; then quotes and brackets pair by a pattern, terms are counted by another."""
    inside = r"""<(?:[^"<>]|"[^"]*")*>"""
    return rf"""
        with good as ({_lines_sql()}),
        l as (select line_id, trim(line, E' \t\r\n') as t from triple_lines where line is not null),
        x as (select line_id, replace(replace(t, '\\', 'zz'), '\"', 'zz') as x from l where t <> '' and not starts_with(t, '#') and line_id not in (select line_id from good)),
        f as (
            select line_id, regexp_full_match(x, '(?:[^"<>]|"[^"]*"|{inside})*', 's') and not regexp_matches(x, '^(?:[^"]*"[^"]*")+(?:[^ \t@^.]|\^[^^]|\^$|\.[^ \t])', 's') as paired,
                len(regexp_extract_all(regexp_replace(x, '\.$', ''), '(?:[^"<> \t]|"[^"]*"|{inside})+')) as n from x
        )
        select line_id, case when not paired then 'quoting' when n <> 3 then 'column_count' else 'invalid_value' end as reason from f
    """


PREPARATION: dict[str, Query] = {f.__name__: f for f in (p2_found, p2_wide, p2_types, p4_found, p4_keys, p4_paths, p5_found, p5_loaded)}

_KEYS_SQL = """
    select 's' as side, s_set_ as k, count(*) as n_rows, count(distinct o_set_) as n_partners from store where s_set_ is not null group by s_set_
    union all
    select 'o', o_set_, count(*), count(distinct s_set_) from store where o_set_ is not null group by o_set_
"""


def preparation_sql() -> dict[str, str]:
    return {
        "p2_found": _cells_sql() + "select distinct s, p, v from c where v is not null",
        "p2_wide": _wide_sql(),
        "p2_types": _types_sql(),
        "p4_found": f"select side, k from ({_KEYS_SQL}) where n_rows >= 0.01 * (select count(*) from store)",
        "p4_keys": f"""with n as ({_KEYS_SQL}), s as (select k, n_rows from n where side = 's'), o as (select k, n_rows from n where side = 'o')
            select side, n.k, n.n_rows, n_partners, cast(coalesce(s.n_rows, 0) as decimal(38, 0)) * coalesce(o.n_rows, 0) as paths from n left join s on n.k = s.k left join o on n.k = o.k""",
        "p4_paths": """
            select a.pid, b.next_pid, cast(sum(cast(a.n as decimal(38, 0)) * b.n) as decimal(38, 0)) as n
            from (select o_set_ as id, pid, count(*) as n from store where o_set_ is not null group by all) a
            join (select s_set_ as id, pid as next_pid, count(*) as n from store where s_set_ is not null group by all) b using (id)
            group by all
        """,
        "p5_found": _rejects_sql(),
        "p5_loaded": _lines_sql(),
    }


def queries() -> dict[str, Query]:
    return graph_queries.queries() | PREPARATION


def oracle_sql() -> dict[str, str]:
    return graph_queries.oracle_sql(_lines_sql()) | preparation_sql()

"""Graph queries over the sales tables and over ``dictionary``, each with SQL that gives the same rows.

All columns are strings in the lexical form of the graph, apart from the count of COUNT.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.cli import run_queries
from brindle.engine import Engine, sparql
from brindle.operators.rejects import good_triples, load_lines
from brindle.sales import sales_graph
from brindle.server import Service
from brindle.session import run_dir, table
from brindle.sources.graph import FrameGraph
from brindle.sources.store import Store, graph_info, predicate_counts, triple_counts
from brindle.sources.termids import decode_triples, encode_triples, number_terms, term_zones


def _iri(kind: str, column: str) -> str:
    return f"'<{kind}/' || {column} || '>'"


def _lit(column: str) -> str:
    return f"'\"' || {column} || '\"'"


_CUSTOMER, _NATION, _REGION = _iri("customer", "c_custkey"), _iri("nation", "n_nationkey"), _iri("region", "r_regionkey")
_ORDER, _SUPPLIER = _iri("orders", "o_orderkey"), _iri("supplier", "s_suppkey")
_MONEY = "cast(cast({} as decimal(18, 2)) as varchar)"
_FOLLOWED = """(select distinct '<user/' || a || '>' as a, '<user/' || b || '>' as b from (
    select user_id as a, lead(user_id) over (partition by date_trunc('hour', ts) order by ts, event_id) as b from events) where b is not null)"""
_SUPPLIED = "(select distinct l_orderkey, l_suppkey from lineitem)"
_PARTS = "(select distinct l_orderkey, l_partkey from lineitem)"
_PATH = """from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
_ASIA = "?n <n_regionkey> ?r . ?r <r_name> \"ASIA\" ."

#: name: (query over the sales graph, SQL)
SALES: dict[str, tuple[str, str]] = {
    "scan_predicate": ("SELECT ?c ?m WHERE { ?c <c_mktsegment> ?m . }", f"select {_CUSTOMER} as c, {_lit('c_mktsegment')} as m from customer"),
    "scan_subjects": ("SELECT DISTINCT ?o WHERE { ?o <hasPart> ?p . }", f"select distinct {_iri('orders', 'l_orderkey')} as o from lineitem"),
    "scan_objects": ("SELECT DISTINCT ?p WHERE { ?o <hasPart> ?p . }", f"select distinct {_iri('part', 'l_partkey')} as p from lineitem"),
    "const_object": ('SELECT ?c WHERE { ?c <c_mktsegment> "BUILDING" }', f"select {_CUSTOMER} as c from customer where c_mktsegment = 'BUILDING'"),
    "const_subject": ("SELECT ?n WHERE { <customer/7> <c_nationkey> ?n }", f"select {_iri('nation', 'c_nationkey')} as n from customer where c_custkey = 7"),
    "const_shared_entity": (
        "SELECT ?c ?x WHERE { ?c <c_nationkey> <nation/3> . <nation/3> <n_name> ?x . }",
        f"select {_CUSTOMER} as c, {_lit('n_name')} as x from customer join nation on c_nationkey = n_nationkey where n_nationkey = 3",
    ),
    "unknown_constant": ("SELECT ?c WHERE { ?c <c_nationkey> <nation/999> }", f"select {_CUSTOMER} as c from customer where false"),
    "unknown_predicate": ("SELECT ?s ?o WHERE { ?s <nothing> ?o }", "select '' as s, '' as o where false"),
    "ground_true": (
        "SELECT ?r ?n WHERE { ?r <r_name> ?n . <nation/0> <n_regionkey> <region/0> }",
        f"select {_REGION} as r, {_lit('r_name')} as n from region where exists (select 1 from nation where n_nationkey = 0 and n_regionkey = 0)",
    ),
    "ground_false": (
        "SELECT ?r ?n WHERE { ?r <r_name> ?n . <nation/0> <n_regionkey> <region/99> }",
        f"select {_REGION} as r, {_lit('r_name')} as n from region where exists (select 1 from nation where n_nationkey = 0 and n_regionkey = 99)",
    ),
    "join_ss": (
        "SELECT ?c ?m ?n WHERE { ?c <c_mktsegment> ?m . ?c <c_nationkey> ?n }",
        f"select {_CUSTOMER} as c, {_lit('c_mktsegment')} as m, {_iri('nation', 'c_nationkey')} as n from customer",
    ),
    "join_oo": (
        "SELECT ?c ?s WHERE { ?c <c_nationkey> ?n . ?s <s_nationkey> ?n }",
        f"select {_CUSTOMER} as c, {_SUPPLIER} as s from customer join supplier on c_nationkey = s_nationkey",
    ),
    "join_so": (
        "SELECT ?o ?n WHERE { ?o <o_custkey> ?c . ?c <c_nationkey> ?n }",
        f"select {_ORDER} as o, {_iri('nation', 'c_nationkey')} as n from orders join customer on o_custkey = c_custkey",
    ),
    "star_3": (
        "SELECT ?c ?a ?b ?n WHERE { ?c <c_name> ?a . ?c <c_mktsegment> ?b . ?c <c_nationkey> ?n }",
        f"select {_CUSTOMER} as c, {_lit('c_name')} as a, {_lit('c_mktsegment')} as b, {_iri('nation', 'c_nationkey')} as n from customer",
    ),
    "star_const": (
        'SELECT ?o ?p ?d WHERE { ?o <o_orderpriority> "1-URGENT" ; <o_orderstatus> "F" ; <o_totalprice> ?p ; <o_orderdate> ?d }',
        f"""select {_ORDER} as o, {_lit(_MONEY.format('o_totalprice'))} as p, {_lit("strftime(o_orderdate, '%Y-%m-%d')")} as d
        from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'""",
    ),
    "path_2": (
        "SELECT ?c ?r WHERE { ?c <c_nationkey> ?n . ?n <n_regionkey> ?r }",
        f"select {_CUSTOMER} as c, {_iri('region', 'n_regionkey')} as r from customer join nation on c_nationkey = n_nationkey",
    ),
    "path_4": (
        "SELECT ?o ?x WHERE { ?o <o_custkey> ?c . ?c <c_nationkey> ?n . ?n <n_regionkey> ?r . ?r <r_name> ?x }",
        f"select {_ORDER} as o, {_lit('r_name')} as x {_PATH}",
    ),
    "snowflake": (
        f'SELECT ?o ?c ?name ?status WHERE {{ ?o <o_custkey> ?c . ?c <c_nationkey> ?n . ?n <n_name> ?name . {_ASIA} ?c <c_mktsegment> "BUILDING" . ?o <o_orderstatus> ?status }}',
        f"select {_ORDER} as o, {_CUSTOMER} as c, {_lit('n_name')} as name, {_lit('o_orderstatus')} as status {_PATH} where r_name = 'ASIA' and c_mktsegment = 'BUILDING'",
    ),
    "cross_product": (
        "SELECT ?a ?b WHERE { ?r <r_name> ?a . ?n <n_name> ?b }",
        f"select {_lit('r_name')} as a, {_lit('n_name')} as b from region cross join nation",
    ),
    "cycle_4": (
        "SELECT ?o ?c ?s ?n WHERE { ?o <o_custkey> ?c . ?c <c_nationkey> ?n . ?s <s_nationkey> ?n . ?o <hasSupplier> ?s }",
        f"""select {_ORDER} as o, {_CUSTOMER} as c, {_SUPPLIER} as s, {_iri('nation', 'c_nationkey')} as n from orders
        join customer on o_custkey = c_custkey join {_SUPPLIED} l on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey""",
    ),
    "triangle": (
        "SELECT ?a ?b ?c WHERE { ?a <followedBy> ?b . ?b <followedBy> ?c . ?c <followedBy> ?a }",
        f"select x.a, y.a as b, z.a as c from {_FOLLOWED} x join {_FOLLOWED} y on x.b = y.a join {_FOLLOWED} z on y.b = z.a and z.b = x.a",
    ),
    "square_from": (
        "SELECT ?b ?c ?d WHERE { <user/1> <followedBy> ?b . ?b <followedBy> ?c . ?c <followedBy> ?d . ?d <followedBy> <user/1> }",
        f"""select x.b, y.b as c, z.b as d from {_FOLLOWED} x join {_FOLLOWED} y on x.b = y.a join {_FOLLOWED} z on y.b = z.a
        join {_FOLLOWED} w on z.b = w.a where x.a = '<user/1>' and w.b = '<user/1>'""",
    ),
    "self_loop": ("SELECT ?x WHERE { ?x <followedBy> ?x }", f"select a as x from {_FOLLOWED} where a = b"),
    "reciprocal": ("SELECT ?a ?b WHERE { ?a <followedBy> ?b . ?b <followedBy> ?a }", f"select x.a, x.b from {_FOLLOWED} x join {_FOLLOWED} y on x.b = y.a and y.b = x.a"),
    "same_pred_chain": (
        "SELECT ?a ?c WHERE { ?a <followedBy> ?b . ?b <followedBy> ?c . ?b <followedBy> ?b }",
        f"select x.a, y.b as c from {_FOLLOWED} x join {_FOLLOWED} y on x.b = y.a where x.b in (select a from {_FOLLOWED} where a = b)",
    ),
    "same_pred_chain_reversed_text": (
        "SELECT ?a ?c WHERE { ?b <followedBy> ?b . ?b <followedBy> ?c . ?a <followedBy> ?b }",
        f"select x.a, y.b as c from {_FOLLOWED} x join {_FOLLOWED} y on x.b = y.a where x.b in (select a from {_FOLLOWED} where a = b)",
    ),
    "project_bag": ("SELECT ?n WHERE { ?c <c_nationkey> ?n }", f"select {_iri('nation', 'c_nationkey')} as n from customer"),
    "select_star": ("SELECT * WHERE { ?n <n_name> ?x . ?n <n_regionkey> ?r }", f"select {_NATION} as n, {_iri('region', 'n_regionkey')} as r, {_lit('n_name')} as x from nation"),
    "distinct_nonprefix": (
        "SELECT DISTINCT ?n WHERE { ?o <o_custkey> ?c . ?c <c_nationkey> ?n }",
        f"select distinct {_iri('nation', 'c_nationkey')} as n from orders join customer on o_custkey = c_custkey",
    ),
    "reduced": ("SELECT REDUCED ?m WHERE { ?c <c_mktsegment> ?m }", f"select {_lit('c_mktsegment')} as m from customer"),
    "duplicates": ("SELECT DUPLICATES ?m WHERE { ?c <c_mktsegment> ?m }", f"select {_lit('c_mktsegment')} as m from customer"),
    "count_modifier": (
        "SELECT COUNT ?n WHERE { ?o <o_custkey> ?c . ?c <c_nationkey> ?n }",
        f"select {_iri('nation', 'c_nationkey')} as n, count(*) as count from orders join customer on o_custkey = c_custkey group by 1",
    ),
    "limit_all": ("SELECT ?n ?x WHERE { ?n <n_name> ?x } LIMIT 1000", f"select {_NATION} as n, {_lit('n_name')} as x from nation"),
    "distinct_limit": ("SELECT DISTINCT ?m WHERE { ?c <c_mktsegment> ?m } LIMIT 500", f"select distinct {_lit('c_mktsegment')} as m from customer"),
    "limit_zero": ("SELECT ?n WHERE { ?n <n_name> ?x } LIMIT 0", f"select {_NATION} as n from nation where false"),
    "nested_group": ("SELECT ?n ?r WHERE { { ?n <n_name> ?x . { ?n <n_regionkey> ?r } } }", f"select {_NATION} as n, {_iri('region', 'n_regionkey')} as r from nation"),
    "no_dot": ("SELECT ?n ?r WHERE { ?n <n_name> ?x ?n <n_regionkey> ?r }", f"select {_NATION} as n, {_iri('region', 'n_regionkey')} as r from nation"),
    "keyword_case": ("select distinct ?r wHeRe { ?n <n_regionkey> ?r } limit 99", f"select distinct {_iri('region', 'n_regionkey')} as r from nation"),
    "prefix_expansion": (
        "PREFIX nation: <nation/> PREFIX : <n_> SELECT ?x WHERE { nation:4 :name ?x }",
        f"select {_lit('n_name')} as x from nation where n_nationkey = 4",
    ),
    "variable_case": ("SELECT ?n ?R WHERE { ?n <n_regionkey> ?R . ?R <r_name> ?r }", f"select {_NATION} as n, {_iri('region', 'n_regionkey')} as \"R\" from nation"),
    "filter_eq": ('SELECT ?c WHERE { ?c <c_mktsegment> ?m . FILTER(?m = "BUILDING" "MACHINERY") }', f"select {_CUSTOMER} as c from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "filter_ne": ('SELECT ?n WHERE { ?n <n_name> ?x FILTER(?x != "NATION_7") }', f"select {_NATION} as n from nation where n_name <> 'NATION_7'"),
    "filter_lt": ("SELECT ?s WHERE { ?s <s_acctbal> ?b FILTER(?b < 1000) }", f"select {_SUPPLIER} as s from supplier where cast(s_acctbal as decimal(18, 2)) < 1000"),
    "filter_le": ("SELECT ?p WHERE { ?p <p_size> ?z FILTER(?z <= 5) }", f"select {_iri('part', 'p_partkey')} as p from part where p_size <= 5"),
    "filter_gt": ('SELECT ?o WHERE { ?o <o_orderdate> ?d FILTER(?d > "1998-01-01") }', f"select {_ORDER} as o from orders where strftime(o_orderdate, '%Y-%m-%d') > '1998-01-01'"),
    "filter_ge": ('SELECT ?n WHERE { ?n <n_name> ?x FILTER(?x >= "NATION_3") }', f"select {_NATION} as n from nation where n_name >= 'NATION_3'"),
    "optional_single": (
        "SELECT ?c ?o WHERE { ?c <c_mktsegment> ?m . OPTIONAL { ?o <o_custkey> ?c } }",
        f"select {_CUSTOMER} as c, {_ORDER} as o from customer left join orders on o_custkey = c_custkey",
    ),
    "optional_filter": (
        'SELECT ?n ?c WHERE { ?n <n_name> ?x . OPTIONAL { ?c <c_nationkey> ?n . ?c <c_mktsegment> "BUILDING" } FILTER(?x < "NATION_15") }',
        f"select {_NATION} as n, {_CUSTOMER} as c from nation left join customer on c_nationkey = n_nationkey and c_mktsegment = 'BUILDING' where n_name < 'NATION_15'",
    ),
    "var_predicate_sp_o": (
        "SELECT ?s ?p WHERE { ?s ?p <nation/3> }",
        f"select {_CUSTOMER} as s, '<c_nationkey>' as p from customer where c_nationkey = 3 union all select {_SUPPLIER}, '<s_nationkey>' from supplier where s_nationkey = 3",
    ),
    "var_predicate_s_po": (
        "SELECT ?p ?o WHERE { <nation/3> ?p ?o }",
        f"select '<n_name>' as p, {_lit('n_name')} as o from nation where n_nationkey = 3 union all select '<n_regionkey>', {_iri('region', 'n_regionkey')} from nation where n_nationkey = 3",
    ),
    "var_predicate_s_p_o": (
        "SELECT ?p WHERE { <nation/3> ?p ?o . <nation/0> ?p <region/0> }",
        "select '<n_regionkey>' as p from nation where n_nationkey = 3 and exists (select 1 from nation where n_nationkey = 0 and n_regionkey = 0)",
    ),
    "orders_of_parts": (
        'SELECT ?o ?p WHERE { ?o <hasPart> ?p . ?p <p_brand> ?b . ?o <o_orderstatus> "P" FILTER(?b = "Brand#11" "Brand#12" "Brand#13") }',
        f"select {_ORDER} as o, {_iri('part', 'p_partkey')} as p from orders join {_PARTS} l on l_orderkey = o_orderkey join part on l_partkey = p_partkey where o_orderstatus = 'P' and p_brand in ('Brand#11', 'Brand#12', 'Brand#13')",
    ),
    "events_of_users": (
        'SELECT ?e ?t ?v WHERE { ?e <byUser> <user/5> . ?e <event_type> ?t . ?e <value> ?v }',
        f"select {_iri('event', 'event_id')} as e, {_lit('event_type')} as t, {_lit(_MONEY.format('value'))} as v from events where user_id = 5",
    ),
}

_T = "(select distinct s, p, o from dictionary where s is not null and p is not null and o is not null)"

#: name: (query over the triples of ``dictionary``, SQL). A few classes, places and values recur everywhere.
TRIPLES: dict[str, tuple[str, str]] = {
    "rdf_star": (
        "SELECT ?s ?place ?year WHERE { ?s <rdf/type> <class/station> . ?s <rel/locatedIn> ?place . ?s <prop/yearOpened> ?year }",
        f"select a.s, b.o as place, c.o as year from {_T} a join {_T} b on a.s = b.s join {_T} c on a.s = c.s where a.p = '<rdf/type>' and a.o = '<class/station>' and b.p = '<rel/locatedIn>' and c.p = '<prop/yearOpened>'",
    ),
    "rdf_path": (
        "SELECT ?a ?c WHERE { ?a <rel/partOf> ?b . ?b <rel/observes> ?c . ?c <rdf/type> ?t }",
        f"select a.s as a, b.o as c from {_T} a join {_T} b on a.o = b.s join {_T} c on b.o = c.s where a.p = '<rel/partOf>' and b.p = '<rel/observes>' and c.p = '<rdf/type>'",
    ),
    "rdf_var_predicate": (
        "SELECT ?a ?p ?b WHERE { ?a ?p ?b . ?b <rdf/type> <class/dataset> }",
        f"select a.s as a, a.p, a.o as b from {_T} a join {_T} b on a.o = b.s where b.p = '<rdf/type>' and b.o = '<class/dataset>'",
    ),
    "rdf_cycle": (
        "SELECT ?a ?b WHERE { ?a <rel/locatedIn> ?place . ?b <rel/locatedIn> ?place . ?a <rel/partOf> ?b }",
        f"select a.s as a, b.s as b from {_T} a join {_T} b on a.o = b.o join {_T} c on c.s = a.s and c.o = b.s where a.p = '<rel/locatedIn>' and b.p = '<rel/locatedIn>' and c.p = '<rel/partOf>'",
    ),
    "rdf_literals": (
        'SELECT ?s ?o WHERE { ?s <prop/note> "no description"@en . ?s <prop/isMobile> "true"^^<xsd/boolean> . ?s <prop/crewSize> ?o FILTER(?o > 40) }',
        f"""select a.s, c.o from {_T} a join {_T} b on a.s = b.s join {_T} c on a.s = c.s where a.p = '<prop/note>' and a.o = '"no description"@en'
        and b.p = '<prop/isMobile>' and b.o = '"true"^^<xsd/boolean>' and c.p = '<prop/crewSize>' and coalesce(
            case when starts_with(c.o, '<') or starts_with(c.o, '_:') then c.o when starts_with(c.o, '"') then regexp_extract(c.o, '^"(.*)"(@[^"]*|\\^\\^[^"]*)?$', 1) else c.o end, c.o) > ''
        and case when try_cast(trim(regexp_replace(regexp_replace(c.o, '^"', ''), '"(@[^"]*|\\^\\^[^"]*)?$', '')) as double) is not null
            then try_cast(trim(regexp_replace(regexp_replace(c.o, '^"', ''), '"(@[^"]*|\\^\\^[^"]*)?$', '')) as double) > 40
            else regexp_replace(regexp_replace(c.o, '^"', ''), '"(@[^"]*|\\^\\^[^"]*)?$', '') > '40' end""",
    ),
    "rdf_optional": (
        "SELECT ?s ?l WHERE { ?s <rel/storedIn> ?x . OPTIONAL { ?s <prop/label> ?l } }",
        f"select a.s, b.o as l from {_T} a left join (select s, o from {_T} where p = '<prop/label>') b on a.s = b.s where a.p = '<rel/storedIn>'",
    ),
}

_CONTENT = """case when starts_with(o, '<') or starts_with(o, '_:') then o when starts_with(o, '"') then coalesce(regexp_extract(o, '^"(.*)"(@[^"]*|\\^\\^[^"]*)?$', 1, 's'), o) else o end"""
_YEAR_TEST = f"case when try_cast({_CONTENT} as double) is not null then try_cast({_CONTENT} as double) > 1990 else {_CONTENT} > '1990' end"
_ZONES = f"(select distinct s as term, 's' as z from {_T} union all select distinct o, 'o' from {_T})"


def _over_sales(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, root: sparql(sales_graph(spark, root), text)


def _over_triples(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, root: sparql(FrameGraph(table(spark, root, "dictionary")), text)


def var_predicate_spo(spark: SparkSession, root: str) -> DataFrame:
    """Every triple of ``dictionary`` as (s, p, o)."""
    return sparql(FrameGraph(table(spark, root, "dictionary")), "SELECT ?s ?p ?o WHERE { ?s ?p ?o }")


def limit_rows(spark: SparkSession, root: str) -> DataFrame:
    """(n): how many rows a LIMIT below the number of matches gives; which ones is not specified."""
    return sparql(sales_graph(spark, root), "SELECT ?c WHERE { ?c <c_mktsegment> ?m } LIMIT 17").agg(F.count(F.lit(1)).alias("n"))


def result_count(spark: SparkSession, root: str) -> DataFrame:
    """(n): the number of answers of a query."""
    return sparql(sales_graph(spark, root), SALES["cycle_4"][0]).agg(F.count(F.lit(1)).alias("n"))


def db_info(spark: SparkSession, root: str) -> DataFrame:
    """(triplets, triples, predicates, entities) of ``dictionary``: rows, distinct triples, and distinct terms of each kind."""
    return graph_info(triple_counts(table(spark, root, "dictionary")))


def predicate_stats(spark: SparkSession, root: str) -> DataFrame:
    """(p, rows, subjects, objects): distinct triples, subjects and objects of each predicate of ``dictionary``."""
    return predicate_counts(triple_counts(table(spark, root, "dictionary"))).select("p", "rows", "subjects", "objects")


def lookup_by_subject(spark: SparkSession, root: str) -> DataFrame:
    """(p, o) of one subject of ``dictionary``."""
    return sparql(FrameGraph(table(spark, root, "dictionary")), "SELECT ?p ?o WHERE { <ent/stn-0> ?p ?o }")


def lookup_by_object(spark: SparkSession, root: str) -> DataFrame:
    """(s, p) of one object of ``dictionary``."""
    return sparql(FrameGraph(table(spark, root, "dictionary")), "SELECT ?s ?p WHERE { ?s ?p <ent/stn-0> }")


def stored_database(spark: SparkSession, root: str) -> DataFrame:
    """(s, o): a database built of the good lines of ``triple_lines``, written to the shared folder and queried there."""
    store = Store(spark, run_dir(spark, "databases"))
    store.create("delivered", good_triples(load_lines(table(spark, root, "triple_lines"))))
    return sparql(store.open("delivered"), "SELECT ?s ?o WHERE { ?s <rdf/type> ?t . ?s <prop/label> ?o }")


@lru_cache(maxsize=8)
def _engine_of(application: str, root: str) -> Engine:
    spark = SparkSession.active()
    engine = Engine(spark, run_dir(spark, "databases"))
    # A low bound, so that predicates with a part of their own and shared parts both occur at any size of the test data.
    engine.store.create("known", table(spark, root, "dictionary"), heavy_rows=500)
    return engine


def _engine(spark: SparkSession, root: str) -> Engine:
    """An engine with the triples of ``dictionary`` as the database ``known``, built once for a session and a folder of tables."""
    return _engine_of(spark.sparkContext.applicationId, root)


def _over_store(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, root: _engine(spark, root).query("known", text)


def stored_info(spark: SparkSession, root: str) -> DataFrame:
    """(triplets, triples, predicates, entities) as the catalogue has them."""
    return spark.createDataFrame([_engine(spark, root).store.info("known")], "triplets long, triples long, predicates long, entities long")


def stored_predicates(spark: SparkSession, root: str) -> DataFrame:
    """(p, rows, subjects, objects, most_s, most_o) as the catalogue has them."""
    return _engine(spark, root).store.predicate_statistics("known").drop("part")


def stored_preloaded(spark: SparkSession, root: str) -> DataFrame:
    """(s, place): a query over predicates that are kept in memory."""
    engine = _engine(spark, root)
    engine.graph("known").preload(["<rel/locatedIn>"])
    return engine.query("known", "SELECT ?s ?place WHERE { ?s <rdf/type> <class/station> . ?s <rel/locatedIn> ?place }")


def stored_export(spark: SparkSession, root: str) -> DataFrame:
    """(s, p, o): all triples of a database, exported as plain Parquet."""
    engine, path = _engine(spark, root), run_dir(spark, "export")
    engine.store.export("known", path)
    return spark.read.parquet(path)


_INFO_SQL = f"""select (select count(*) from dictionary where s is not null and p is not null and o is not null) as triplets, count(*) as triples,
                count(distinct p) as predicates, (select count(*) from (select s from {_T} union select o from {_T})) as entities from {_T}"""
_ASKED_SQL = f"select a.s, b.o from {_T} a join {_T} b on a.o = b.s where a.p = '<rel/partOf>' and b.p = '<prop/label>'"
_ASKED = "SELECT ?s ?o WHERE { ?s <rel/partOf> ?x . ?x <prop/label> ?o }"


def service_rows(spark: SparkSession, root: str) -> DataFrame:
    """(s, o): the bindings in the JSON that the HTTP service answers with."""
    status, pieces = Service(_engine(spark, root), fixed="known").sparql(_ASKED)
    answer = json.loads("".join(pieces))
    assert status == 200 and answer["head"]["vars"] == ["s", "o"] and answer["results"]["binding_cnt"] == len(answer["results"]["bindings"])
    return spark.createDataFrame(answer["results"]["bindings"], "s string, o string")


def engine_answer(spark: SparkSession, root: str) -> DataFrame:
    """(s, o): the rows of the library's answer."""
    return spark.createDataFrame(_engine(spark, root).answer("known", _ASKED).rows, "s string, o string")


def command_line_count(spark: SparkSession, root: str) -> DataFrame:
    """(n): how many rows the command line prints for a query, as it reports them."""
    out = io.StringIO()
    run_queries(_engine(spark, root), "known", [_ASKED + "\n"], out)
    return spark.createDataFrame([(int(next(line for line in out.getvalue().split("\n") if line.startswith("rows: "))[6:]),)], "n long")


def analyzed_path(spark: SparkSession, root: str) -> DataFrame:
    """(a, c): ``rdf_path`` over a DataFrame whose statistics were gathered first."""
    return sparql(FrameGraph(table(spark, root, "dictionary")).analyzed(), TRIPLES["rdf_path"][0])


def coded_triples(spark: SparkSession, root: str) -> DataFrame:
    """(s, p, o): the triples of ``dictionary`` turned to ids and back."""
    triples = table(spark, root, "dictionary").where("s is not null and p is not null and o is not null").select("s", "p", "o").distinct()
    terms = number_terms(spark, triples, run_dir(spark, "terms"))
    return decode_triples(encode_triples(triples, terms), terms)


def subjects_of_links(spark: SparkSession, root: str) -> DataFrame:
    """(p, s): the distinct subjects of each predicate of kind link, as one scan over all of them."""
    links = table(spark, root, "predicates").where("kind = 'link'").select("p")
    return sparql(FrameGraph(table(spark, root, "dictionary").join(links, "p", "left_semi")), "SELECT DISTINCT ?p ?s WHERE { ?s ?p ?o }")


def term_zone(spark: SparkSession, root: str) -> DataFrame:
    """(term, zone) of every subject and object of ``dictionary``."""
    return term_zones(table(spark, root, "dictionary").where("s is not null and p is not null and o is not null"))


def term_ids(spark: SparkSession, root: str) -> DataFrame:
    """(term_id, term, zone): dense ids, shared terms first, then subjects, then objects, each by text."""
    triples = table(spark, root, "dictionary").where("s is not null and p is not null and o is not null")
    return number_terms(spark, triples, run_dir(spark, "terms"))


def triangle_binary(spark: SparkSession, root: str) -> DataFrame:
    """(a, b, c): ``triangle`` by binary joins, for comparison."""
    return sparql(sales_graph(spark, root), SALES["triangle"][0], multiway=False)


#: name: (query over the stored ``dictionary``, SQL)
STORED: dict[str, tuple[str, str]] = {name.replace("rdf_", "stored_"): case for name, case in TRIPLES.items()} | {
    "stored_spo": ("SELECT ?s ?p ?o WHERE { ?s ?p ?o }", f"select s, p, o from {_T}"),
    "stored_by_subject": ("SELECT ?p ?o WHERE { <ent/stn-0> ?p ?o }", f"select p, o from {_T} where s = '<ent/stn-0>'"),
    "stored_by_object": ("SELECT ?s ?p WHERE { ?s ?p <ent/stn-0> }", f"select s, p from {_T} where o = '<ent/stn-0>'"),
    "stored_const_object": ("SELECT ?s WHERE { ?s <rdf/type> <class/station> }", f"select s from {_T} where p = '<rdf/type>' and o = '<class/station>'"),
    "stored_subjects": ("SELECT DISTINCT ?s WHERE { ?s <rel/locatedIn> ?o }", f"select distinct s from {_T} where p = '<rel/locatedIn>'"),
    "stored_objects": ("SELECT DISTINCT ?o WHERE { ?s <rel/locatedIn> ?o }", f"select distinct o from {_T} where p = '<rel/locatedIn>'"),
    "stored_count": ("SELECT COUNT ?o WHERE { ?s <rel/locatedIn> ?o }", f"select o, count(*) as count from {_T} where p = '<rel/locatedIn>' group by o"),
    "stored_oo": (
        "SELECT ?a ?b WHERE { ?a <rel/partOf> ?x . ?b <rel/partOf> ?x }",
        f"select a.s as a, b.s as b from {_T} a join {_T} b on a.o = b.o where a.p = '<rel/partOf>' and b.p = '<rel/partOf>'",
    ),
    "stored_optional_filter": (
        "SELECT ?s ?y WHERE { ?s <rdf/type> <class/station> . OPTIONAL { ?s <prop/yearOpened> ?y FILTER(?y > 1990) } }",
        f"""select a.s, b.o as y from {_T} a left join (select s, o from {_T} where p = '<prop/yearOpened>' and {_YEAR_TEST}) b on a.s = b.s where a.p = '<rdf/type>' and a.o = '<class/station>'""",
    ),
}

_OTHER = (stored_info, stored_predicates, stored_preloaded, stored_export, service_rows, engine_answer, command_line_count, analyzed_path, coded_triples, triangle_binary, subjects_of_links, term_zone, term_ids, var_predicate_spo, limit_rows, result_count, db_info, predicate_stats, lookup_by_subject, lookup_by_object, stored_database)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return (
        {name: _over_sales(text) for name, (text, _) in SALES.items()}
        | {name: _over_triples(text) for name, (text, _) in TRIPLES.items()}
        | {name: _over_store(text) for name, (text, _) in STORED.items()}
        | {f.__name__: f for f in _OTHER}
    )


def oracle_sql(lines_sql: str) -> dict[str, str]:
    """The SQL of each query; ``lines_sql`` gives (line_id, s, p, o) of the good lines of ``triple_lines``."""
    return (
        {name: sql for name, (_, sql) in (SALES | TRIPLES | STORED).items()}
        | {
            "var_predicate_spo": f"select s, p, o from {_T}",
            "limit_rows": "select least(17, count(*)) as n from customer",
            "result_count": f"select count(*) as n from ({SALES['cycle_4'][1]})",
            "db_info": _INFO_SQL,
            "stored_info": _INFO_SQL,
            "stored_predicates": f"""with x as (select p, 's' as e, s as x, count(*) as n from {_T} group by p, s union all select p, 'o', o, count(*) from {_T} group by p, o)
                select p, cast(sum(n) filter (e = 's') as bigint) as rows, count(*) filter (e = 's') as subjects, count(*) filter (e = 'o') as objects,
                    max(n) filter (e = 's') as most_s, max(n) filter (e = 'o') as most_o from x group by p""",
            "stored_preloaded": f"select a.s, b.o as place from {_T} a join {_T} b on a.s = b.s where a.p = '<rdf/type>' and a.o = '<class/station>' and b.p = '<rel/locatedIn>'",
            "stored_export": f"select s, p, o from {_T}",
            "service_rows": _ASKED_SQL,
            "engine_answer": _ASKED_SQL,
            "command_line_count": f"select count(*) as n from ({_ASKED_SQL})",
            "analyzed_path": TRIPLES["rdf_path"][1],
            "coded_triples": f"select s, p, o from {_T}",
            "predicate_stats": f"select p, cast(count(*) as bigint) as rows, count(distinct s) as subjects, count(distinct o) as objects from {_T} group by p",
            "triangle_binary": SALES["triangle"][1],
            "subjects_of_links": f"select distinct p, s from {_T} where p in (select p from predicates where kind = 'link')",
            "term_zone": f"select term, case when count(*) = 2 then 'shared' when min(z) = 's' then 'subject' else 'object' end as zone from {_ZONES} group by term",
            "term_ids": f"""with z as (select term, case when count(*) = 2 then 0 when min(z) = 's' then 1 else 2 end as k from {_ZONES} group by term)
                select row_number() over (order by k, term) as term_id, term, case k when 0 then 'shared' when 1 then 'subject' else 'object' end as zone from z""",
            "lookup_by_subject": f"select p, o from {_T} where s = '<ent/stn-0>'",
            "lookup_by_object": f"select s, p from {_T} where o = '<ent/stn-0>'",
            "stored_database": f"""with l as ({lines_sql}), d as (select distinct s, p, o from l)
                select b.s, b.o from d a join d b on a.s = b.s where a.p = '<rdf/type>' and b.p = '<prop/label>'""",
        }
    )

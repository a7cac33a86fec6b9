"""Queries over small graphs against a brute-force evaluator."""

import itertools
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brindle.engine import sparql
from brindle.plans.order import Statistics, expands
from brindle.plans.syntax import Const, UnsupportedQuery, parse
from brindle.sources.graph import FrameGraph
from brindle.sources.store import Store

GRAPHS = {
    "basic": [("<a>", "<p>", "<b>"), ("<b>", "<p>", "<c>"), ("<a>", "<q>", '"x"'), ("<b>", "<q>", '"x"')],
    "shared": [("<a>", "<p>", "<b>"), ("<b>", "<q>", "<c>"), ("<z>", "<p>", "<y>")],
    "loop": [("<a>", "<p>", "<a>"), ("<a>", "<p>", "<b>"), ("<b>", "<p>", "<a>")],
    "chain": [("<a>", "<p>", "<b>"), ("<b>", "<p>", "<c>"), ("<c>", "<p>", "<d>")],
    "disjoint": [("<a>", "<p>", "<b>"), ("<c>", "<q>", "<d>"), ("<e>", "<q>", "<f>")],
    "distinct": [("<a>", "<p>", "<x>"), ("<b>", "<p>", "<y>"), ("<c>", "<p>", "<x>")],
    "predvar": [("<a>", "<p>", "<p>"), ("<p>", "<q>", "<b>")],
    "literals": [("<a>", "<p>", '"a b." '), ("<a>", "<p>", '"a"@en'), ("<a>", "<p>", '"1"^^<int>'), ("<a>", "<p>", '"?x"'), ("<a>", "<p>", "5"), ("<a>", "<p>", "_:b1")],
}


def frame(spark, triples):
    return spark.createDataFrame(triples, "s string, p string, o string")


def answer(spark, triples, text):
    return Counter(tuple(row) for row in sparql(frame(spark, triples), text).collect())


def brute(triples, text):
    """All bindings of the required patterns, by trying every combination of triples."""
    query = parse(text)
    out = Counter()
    for combination in itertools.product(set(triples), repeat=len(query.patterns)):
        bound, fits = {}, True
        for pattern, triple in zip(query.patterns, combination, strict=True):
            for term, value in zip(pattern.terms(), triple, strict=True):
                if isinstance(term, Const):
                    fits = fits and term.text == value
                else:
                    fits = fits and bound.setdefault(term.name, value) == value
        if fits:
            out[tuple(bound[name] for name in query.projection)] += 1
    return Counter(dict.fromkeys(out, 1)) if query.modifier == "DISTINCT" else out


CASES = [
    ("basic", "SELECT ?a ?b WHERE { ?a <q> ?x . ?b <q> ?x }"),
    ("basic", 'SELECT ?a WHERE { ?a <q> "x" }'),
    ("basic", "SELECT ?a WHERE { ?a <q> x }"),
    ("shared", "SELECT ?o WHERE { <b> <q> ?o }"),
    ("shared", "SELECT ?s WHERE { ?s <p> <b> }"),
    ("shared", "SELECT ?s WHERE { ?s <p> <nothing> }"),
    ("shared", "SELECT ?s ?o WHERE { ?s <nothing> ?o }"),
    ("shared", "SELECT ?s WHERE { ?s <p> ?o . <b> <q> <c> }"),
    ("shared", "SELECT ?s WHERE { ?s <p> ?o . <b> <q> <d> }"),
    ("shared", "SELECT ?s WHERE { ?s <p> ?o . <b> <q> <c> . <z> <p> <y> }"),
    ("shared", "SELECT ?s WHERE { <z> <p> <x> . ?s <p> ?o . <b> <q> <c> . <z> <p> <y> }"),
    ("loop", "SELECT ?x WHERE { ?x <p> ?x }"),
    ("loop", "SELECT ?a ?b WHERE { ?a <p> ?b . ?b <p> ?a }"),
    ("loop", "SELECT ?a ?b ?c WHERE { ?a <p> ?b . ?b <p> ?c . ?c <p> ?a }"),
    ("chain", "SELECT ?a ?d WHERE { ?a <p> ?b . ?b <p> ?c . ?c <p> ?d }"),
    ("chain", "SELECT ?a ?d WHERE { ?c <p> ?d . ?b <p> ?c . ?a <p> ?b }"),
    ("disjoint", "SELECT ?a ?c WHERE { ?a <p> ?b . ?c <q> ?d }"),
    ("distinct", "SELECT ?o WHERE { ?s <p> ?o }"),
    ("distinct", "SELECT DISTINCT ?o WHERE { ?s <p> ?o }"),
    ("distinct", "SELECT DISTINCT ?s WHERE { ?s <p> ?o . ?t <p> ?o . ?t <p> ?q }"),
    ("loop", "SELECT DISTINCT ?c WHERE { ?a <p> ?b . ?b <p> ?c . ?c <p> ?d . ?d <p> ?c }"),
    ("basic", "SELECT DISTINCT ?x WHERE { ?a <p> ?b . ?b <q> ?x . ?a <q> ?y . <a> <p> <b> }"),
    ("predvar", "SELECT ?a ?p ?b WHERE { ?a ?p ?x . ?x <q> ?b }"),
    ("predvar", "SELECT ?p WHERE { <a> ?p ?p }"),
    ("predvar", "SELECT ?s ?p ?o WHERE { ?s ?p ?o }"),
    ("literals", "SELECT ?o WHERE { <a> <p> ?o }"),
    ("literals", 'SELECT ?s WHERE { ?s <p> "?x" }'),
    ("literals", 'SELECT ?s WHERE { ?s <p> "1"^^<int> . ?s <p> 5 . ?s <p> "a"@en }'),
]


@pytest.mark.parametrize("name,text", CASES)
def test_against_brute_force(spark, name, text):
    for triples in (GRAPHS[name], GRAPHS[name] * 2):
        assert answer(spark, triples, text) == brute(triples, text)


@pytest.mark.parametrize("text", [
    "SELECT ?a ?b ?c WHERE { ?a <p> ?b . ?b <p> ?c . ?c <p> ?a }",
    "SELECT ?a ?b ?c ?d WHERE { ?a <p> ?b . ?b <p> ?c . ?c <p> ?d . ?d <p> ?a . ?a <p> ?c }",
    "SELECT DISTINCT ?b WHERE { ?a <p> ?b . ?b <p> ?c . ?c <p> ?a . ?c <p> <a> }",
    "SELECT ?a ?c WHERE { <a> <p> ?b . ?b <p> ?c . ?c <p> <a> . ?a <p> ?c . ?a <p> ?b }",
])
def test_multiway_gives_the_same(spark, text):
    triples = [(f"<{a}>", "<p>", f"<{b}>") for a, b in ["aa", "ab", "ba", "bc", "ca", "cb", "ad", "da", "db"]]
    got = Counter(tuple(row) for row in sparql(frame(spark, triples * 2), text, multiway=True).collect())
    assert got == Counter(tuple(row) for row in sparql(frame(spark, triples), text, multiway=False).collect()) and got
    if text.count("<p>") <= 4:
        assert got == brute(triples, text)


def test_multiway_spares_the_square_of_a_hub(spark):
    # All paths lead through the hub; only one of its 3,000 x 3,000 two-step paths is closed.
    ins = spark.range(3000).selectExpr("concat('<i', id, '>') as s", "'<p>' as p", "'<hub>' as o")
    outs = spark.range(3000).selectExpr("'<hub>' as s", "'<p>' as p", "concat('<o', id, '>') as o")
    triples = ins.unionByName(outs).unionByName(spark.createDataFrame([("<o7>", "<p>", "<i9>")], "s string, p string, o string"))
    found = sparql(triples, "SELECT ?a ?b ?c WHERE { ?a <p> ?b . ?b <p> ?c . ?c <p> ?a }", multiway=True)
    assert sorted(tuple(r) for r in found.collect()) == [("<hub>", "<o7>", "<i9>"), ("<i9>", "<hub>", "<o7>"), ("<o7>", "<i9>", "<hub>")]


def test_known_counts(spark):
    assert sum(answer(spark, GRAPHS["loop"], "SELECT ?a ?b WHERE { ?a <p> ?b . ?b <p> ?a }").values()) == 3
    assert sum(answer(spark, GRAPHS["loop"], "SELECT ?a WHERE { ?a <p> ?b . ?b <p> ?c . ?c <p> ?a }").values()) == 4
    assert sum(answer(spark, GRAPHS["disjoint"], "SELECT ?a ?c WHERE { ?a <p> ?b . ?c <q> ?d }").values()) == 2


NODES = st.sampled_from(["<a>", "<b>", "<c>", '"l"'])
TERMS = st.sampled_from(["?x", "?y", "?z", "<a>", "<b>"])


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    triples=st.lists(st.tuples(NODES, st.sampled_from(["<p>", "<q>", "<a>"]), NODES), min_size=1, max_size=6),
    patterns=st.lists(st.tuples(TERMS, st.sampled_from(["<p>", "<q>", "?p", "?x"]), TERMS), min_size=1, max_size=3),
    distinct=st.booleans(),
)
def test_random_patterns(spark, triples, patterns, distinct):
    body = " . ".join(" ".join(p) for p in patterns)
    if "?" not in body:
        body += " . ?x <p> ?y"
    names = sorted(set(re.findall(r"\?\w+", body)))
    shown = "*" if not distinct else " ".join(names[: 1 + len(names) // 2])
    text = f"SELECT {'DISTINCT' if distinct else ''} {shown} WHERE {{ {body} }}"
    assert answer(spark, triples, text) == brute(triples, text)


def test_limits_and_modifiers(spark):
    triples = GRAPHS["distinct"]
    assert answer(spark, triples, "SELECT ?o WHERE { ?s <p> ?o } LIMIT 0") == Counter()
    assert sum(answer(spark, triples, "SELECT ?o WHERE { ?s <p> ?o } LIMIT 2").values()) == 2
    assert answer(spark, triples, "SELECT DISTINCT ?o WHERE { ?s <p> ?o } LIMIT 2") == Counter({("<x>",): 1, ("<y>",): 1})
    assert answer(spark, triples, "SELECT COUNT ?o WHERE { ?s <p> ?o }") == Counter({("<x>", 2): 1, ("<y>", 1): 1})
    assert answer(spark, triples, "SELECT REDUCED ?o WHERE { ?s <p> ?o }")[("<x>",)] == 2


def test_optional_and_filters(spark):
    triples = [("<a>", "<p>", "5"), ("<b>", "<p>", '"30"'), ("<c>", "<p>", '"x"'), ("<a>", "<q>", "<z>"), ("<b>", "<r>", '"-2.5"^^<d>')]
    assert answer(spark, triples, "SELECT ?s ?z WHERE { ?s <p> ?v OPTIONAL { ?s <q> ?z } }") == Counter({("<a>", "<z>"): 1, ("<b>", None): 1, ("<c>", None): 1})
    assert answer(spark, triples, "SELECT ?s WHERE { ?s <p> ?v FILTER(?v > 5) FILTER(?v < 100) }") == Counter({("<b>",): 1})
    assert answer(spark, triples, "SELECT ?s WHERE { ?s <p> ?v FILTER(?v = 30 5) }") == Counter({("<a>",): 1, ("<b>",): 1})
    assert answer(spark, triples, 'SELECT ?s WHERE { ?s <p> ?v FILTER(?v != "x") }') == Counter({("<a>",): 1, ("<b>",): 1})
    assert answer(spark, triples, "SELECT ?s WHERE { ?s <p> ?v OPTIONAL { ?s <r> ?w } FILTER(?w < 0) }") == Counter({("<b>",): 1})
    assert answer(spark, triples, "SELECT ?s ?x WHERE { ?s <q> ?z OPTIONAL { ?x <none> ?y } }") == Counter({("<a>", None): 1})


def test_nulls_names_and_empty_graphs(spark):
    triples = [("<a>", None, "<b>"), (None, "<p>", "<b>"), ("<a>", "<p>", None), ("<a>", "<p>", "<b>")]
    assert answer(spark, triples, "SELECT ?s ?p ?o WHERE { ?s ?p ?o }") == Counter({("<a>", "<p>", "<b>"): 1})
    assert answer(spark, [], "SELECT ?s ?o WHERE { ?s <p> ?o . ?o <q> ?s }") == Counter()
    out = sparql(frame(spark, triples), "SELECT ?R ?x WHERE { ?x <p> ?R . ?x <p> ?r }")
    assert out.columns == ["R", "x"] and out.count() == 1
    more = frame(spark, triples).selectExpr("*", "1 as v_x", "2 as exists")
    assert sparql(more, "SELECT ?x WHERE { ?x <p> ?y . <a> <p> <b> }").collect()[0][0] == "<a>"


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_stored_graphs_answer_alike(spark, tmp_path, name):
    store = Store(spark, str(tmp_path))
    info = store.create(name, frame(spark, GRAPHS[name] * 2), heavy_rows=2)
    assert info["triplets"] == 2 * len(GRAPHS[name]) and info["triples"] == len(set(GRAPHS[name]))
    graph = store.open(name)
    for case, text in CASES:
        if case == name:
            assert Counter(tuple(r) for r in sparql(graph, text).collect()) == brute(GRAPHS[name], text)


def test_filters_inside_optional_groups(spark):
    triples = [("<a>", "<p>", "5"), ("<b>", "<p>", "6"), ("<a>", "<q>", "1"), ("<a>", "<q>", "9"), ("<b>", "<q>", "2")]
    assert answer(spark, triples, "SELECT ?s ?z WHERE { ?s <p> ?v OPTIONAL { ?s <q> ?z FILTER(?z > 5) } }") == Counter({("<a>", "9"): 1, ("<b>", None): 1})
    assert answer(spark, triples, "SELECT ?s ?z WHERE { ?s <p> ?v OPTIONAL { ?s <q> ?z FILTER(?z > 1) FILTER(?z < 5) } FILTER(?v > 5) }") == Counter({("<b>", "2"): 1})
    for text in ("SELECT ?s WHERE { ?s <p> ?v OPTIONAL { ?s <q> ?z FILTER(?v > 5) } }", "SELECT ?s WHERE { ?s <p> ?v } LIMIT 2147483648"):
        with pytest.raises(UnsupportedQuery):
            parse(text)
    assert parse("SELECT ?s WHERE { ?s <p> ?v } LIMIT 2147483647").limit == 2**31 - 1


def test_an_optional_without_shared_variables_needs_no_broadcast(spark):
    triples = [("<a>", "<p>", "<b>"), ("<b>", "<p>", "<c>"), ("<x>", "<q>", "1"), ("<x>", "<q>", "2")]
    text = "SELECT ?s ?z WHERE { ?s <p> ?v OPTIONAL { ?x <%s> ?z } }"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert answer(spark, triples, text % "q") == Counter({(s, z): 1 for s in ("<a>", "<b>") for z in "12"})
        assert answer(spark, triples, text % "none") == Counter({("<a>", None): 1, ("<b>", None): 1})
        plan = sparql(frame(spark, triples), text % "q")._jdf.queryExecution().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_terms_in_single_quotes_and_blank_nodes(spark):
    assert answer(spark, GRAPHS["literals"], "SELECT ?s WHERE { ?s <p> 'a'@en . ?s <p> '1'^^<int> . ?s <p> _:b1 }") == Counter({("<a>",): 1})
    assert parse("""SELECT ?s WHERE { ?s <p> 'it\\'s "x"' }""").patterns[0].o == Const('"it\'s \\"x\\""')


def test_selective_patterns_narrow_what_is_made_distinct(spark):
    triples = [(f"<s{k}>", p, f"<o{k % 5}>") for k in range(60) for p in ("<p>", "<q>")] + [(f"<s{k}>", "<t>", "<c>") for k in range(0, 60, 7)]
    text = "SELECT ?s ?a ?b WHERE { ?s <t> <c> . ?s <p> ?a . ?s <q> ?b }"
    assert answer(spark, triples * 2, text) == Counter({(f"<s{k}>", f"<o{k % 5}>", f"<o{k % 5}>"): 1 for k in range(0, 60, 7)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sparql(frame(spark, triples * 2), text)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 5  # two of them are the keys of the first pattern, which are reused
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_statistics_decide_about_multiway_steps():
    p, even = parse("SELECT ?a WHERE { ?a <p> ?b . ?b <p> ?c . ?c <p> ?a }").patterns, Statistics(1e5, 1e4, 1e4, 20, 20)
    assert expands([p[0]], [p[1], p[2]], {})
    assert not expands([p[0]], [p[1], p[2]], {"<p>": even})
    assert expands([p[0]], [p[1], p[2]], {"<p>": Statistics(1e5, 1e4, 1e4, 2e4, 20)})
    assert expands([p[0]], [p[1], p[2]], {"<p>": Statistics(1e5, 1e2, 1e2)})


def test_analyzed_graphs(spark):
    graph = FrameGraph(frame(spark, GRAPHS["basic"] * 2)).analyzed()
    assert graph.statistics() == {"<p>": Statistics(4, 2, 2), "<q>": Statistics(4, 2, 1)}
    text = "SELECT ?a ?x WHERE { ?a <p> ?b . ?b <q> ?x }"
    assert Counter(tuple(r) for r in sparql(graph, text).collect()) == brute(GRAPHS["basic"], text)

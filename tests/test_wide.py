import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brindle.functions.terms import canonical_value, content
from brindle.operators.wide import Attribute, attributes_of, cells, discover_attributes, widen, widen_all

ATTRIBUTES = [Attribute("<i>", "integer", "size"), Attribute("<d>", "decimal", "mass"), Attribute("<t>", "date", "day"), Attribute("<b>", "boolean", "ok"), Attribute("<s>", "string", "code")]
SCHEMA = "id long, s string, p string, o string, at int, v string, n string"


def triples(spark, rows):
    return spark.createDataFrame([(k, *row, "clash", "clash") for k, row in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(
    "o,datatype,value",
    [
        ('"  +007 "', "integer", "7"), ('"-0"', "integer", "0"), ("-12", "integer", "-12"), ('"12.0"', "integer", None), ('"1e3"', "integer", None),
        ('"99999999999999999999999"', "integer", "99999999999999999999999"), ('""', "integer", None), ('"1,000"', "integer", None),
        ('".5"^^<x>', "decimal", "0.50"), ('"952."', "decimal", "952.00"), ('"-0.00"', "decimal", "0.00"), ('" -1.5 "@en', "decimal", "-1.50"), ('"NaN"', "decimal", None), ('"."', "decimal", None),
        ('"2024-02-29"', "date", "2024-02-29"), ('"2023-02-29"', "date", None), ('"1900-02-29"', "date", None), ('"2000-02-29 "', "date", "2000-02-29"), ('"2020-1-7"', "date", None), ('"2020-04-31"', "date", None), ('"2020-01-07Z"', "date", None),
        ('"1"', "boolean", "true"), ("false", "boolean", "false"), ('"TRUE"', "boolean", None), (' "true"', "boolean", None),
        ('" a "@en', "string", " a "), ('""', "string", ""), ("bare", "string", "bare"), ("<iri>", "string", None), ("_:b", "string", None), (None, "string", None), ('"open', "string", None), ('"a"b"', "string", 'a"b'), ('"x\ny"', "string", "x\ny"),
        ('"1"', "unknown", None), ('"1"', None, None),
    ],
)
def test_canonical_values(spark, o, datatype, value):
    row = spark.createDataFrame([(o, datatype)], "o string, t string").select(canonical_value(F.col("o"), F.col("t")), content(F.col("o"))).first()
    assert row[0] == value


ROWS = [
    ("<a>", "<i>", '"1"', 1), ("<a>", "<i>", '"2"', 3), ("<a>", "<i>", '"3"', 2), ("<a>", "<i>", '"4"', None), ("<a>", "<i>", '"bad"', 9),
    ("<a>", "<s>", '"x"', 1), ("<a>", "<s>", '"x"@en', 1), ("<a>", "<s>", None, 5), ("<a>", None, '"y"', 5), (None, "<s>", '"z"', 5),
    ("<b>", "<d>", '"1.5"', 1), ("<b>", "<t>", "2020-02-02", 1), ("<b>", "<b>", '"0"', 1), ("<b>", "<other>", '"1"', 1),
    ("<c>", "<i>", "<iri>", 1), ("<e>", "<i>", '"99999999999999999999"', 1),
]


def test_latest_statement_wins(spark):
    wide = {row.s: row for row in widen(triples(spark, ROWS), ATTRIBUTES, ["at", "id"]).collect()}
    assert set(wide) == {"<a>", "<b>", "<e>"}
    assert (wide["<a>"].size, wide["<a>"].code, wide["<a>"].mass) == (2, "x", None)
    assert (wide["<b>"].mass, wide["<b>"].day, wide["<b>"].ok) == (Decimal("1.50"), datetime.date(2020, 2, 2), False)
    assert wide["<e>"].size is None


def test_cells_hold_every_distinct_value_once(spark):
    found = sorted(tuple(row) for row in cells(triples(spark, ROWS), ATTRIBUTES).collect())
    assert found == sorted(
        [("<a>", "<i>", x) for x in "1234"] + [("<a>", "<s>", "x"), ("<b>", "<d>", "1.50"), ("<b>", "<t>", "2020-02-02"), ("<b>", "<b>", "false"), ("<e>", "<i>", "99999999999999999999")]
    )


def test_hot_entity_is_split_and_stays_whole(spark):
    rows = spark.range(30_000).selectExpr("'<hot>' as s", "'<i>' as p", "cast(id % 11000 as string) as o").unionByName(spark.createDataFrame([("<a>", "<i>", '"1"')], "s string, p string, o string"))
    wide = widen_all(rows, ATTRIBUTES)
    assert wide.where("s = '<hot>'").count() > 100 and wide.where("s = '<a>'").count() == 1
    assert cells(rows, ATTRIBUTES).where("s = '<hot>'").distinct().count() == 11_000 == cells(rows, ATTRIBUTES).where("s = '<hot>'").count()


def test_empty_table_and_missing_columns(spark):
    assert widen(triples(spark, []), ATTRIBUTES, ["at"]).collect() == []
    assert cells(triples(spark, []), ATTRIBUTES).collect() == []
    with pytest.raises(ValueError):
        widen(spark.createDataFrame([("a", "b")], "s string, p string"), ATTRIBUTES, [])


def test_attribute_lists(spark):
    schema = "p string, datatype string, col_name string, pid int"
    rows = [("<i>", "integer", "size", 1), ("<i>", "integer", "size", 2), ("<x>", None, None, 3), ("<y>", "geometry", "shape", 4), (None, "date", "day", 5)]
    assert attributes_of(spark.createDataFrame(rows, schema)) == [Attribute("<i>", "integer", "size")]
    with pytest.raises(ValueError):
        attributes_of(spark.createDataFrame([("<i>", "integer", "size", 1), ("<j>", "integer", "Size", 1)], schema))
    found = discover_attributes(triples(spark, ROWS), 0.8)
    assert {(a.predicate, a.datatype) for a in found} == {("<i>", "integer"), ("<s>", "string"), ("<d>", "decimal"), ("<t>", "date"), ("<b>", "boolean"), ("<other>", "boolean")}
    assert {a.predicate: a.datatype for a in discover_attributes(triples(spark, ROWS))}["<i>"] == "string"


def test_decimals_of_any_length(spark):
    big = "9" * 60
    want = {
        f'"{big}"': f"{big}.00", f'"-00{big}.994"': f"-{big}.99", f'"{big}.995"': f"1{'0' * 60}.00", f'"+{big}8.1"@en': f"{big}8.10", "0" * 50 + "12.5": "12.50", "-." + "0" * 40 + "1": "0.00", ".00499999999": "0.00", "-0.00500000000": "-0.01",
        "1.23499999999": "1.23", "-1.99500000001": "-2.00", "0.99999999": "1.00", "1.2950000000": "1.30", "9" * 31 + ".005": "9" * 31 + ".01", "1" + "0" * 40 + ".": "1" + "0" * 40 + ".00", "9" * 40 + "e1": None, "9" * 40 + ".1.2": None,
    }
    rows = spark.createDataFrame([(o,) for o in want], "o string").select("o", canonical_value(F.col("o"), F.lit("decimal"))).collect()
    assert {row[0]: row[1] for row in rows} == want
    df = triples(spark, [("<a>", "<d>", f'"{big}"', 1), ("<b>", "<d>", '"1.5"', 1)])
    assert sorted(tuple(row) for row in cells(df, ATTRIBUTES).collect()) == [("<a>", "<d>", f"{big}.00"), ("<b>", "<d>", "1.50")]
    assert {row.s: row.mass for row in widen(df, ATTRIBUTES, ["at"]).collect()} == {"<a>": None, "<b>": Decimal("1.50")}

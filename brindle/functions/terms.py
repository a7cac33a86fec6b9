"""Column expressions on RDF terms in their lexical form.

A term is an IRI ``<...>``, a blank node ``_:x``, a literal ``"..."`` with an optional ``@lang`` or ``^^<type>``, or a
bare token. All expressions run inside generated code; none of them raises on odd input.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INTEGER = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"
_USUAL = r"^[+-]?[0-9]{0,30}(?:\.[0-9]{0,6})?$"
_PARTS = r"^([+-]?)0*([0-9]*)(?:\.([0-9]*))?$"
_SPACES = " \t\r\n"
_DATE = r"^(-?(?:[1-9][0-9]{4,}|[0-9]{4}))-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"

#: The datatypes that ``canonical_value`` knows, with the Spark type of a typed column.
DATATYPES = {"integer": "bigint", "decimal": "decimal(38,2)", "date": "date", "boolean": "boolean", "string": "string"}


def content(o: Column) -> Column:
    """The text between the quotes of a literal or the whole bare token; null for an IRI, a blank node or null.

    What follows the last quote is the tag, so a literal needs no pattern.
    """
    node = o.startswith("<") | o.startswith("_:")
    tag = F.substring_index(o, '"', -1)
    inside = F.length(o) - F.length(tag) - 2
    closed = (inside >= 0) & ((tag == "") | tag.startswith("@") | tag.startswith("^^"))
    return F.when(node, None).when(o.startswith('"'), F.when(closed, F.substring(o, F.lit(2), inside))).otherwise(o)


def _integer(v: Column) -> Column:
    signed = v.startswith("+") | v.startswith("-")
    digits = F.ltrim(F.when(signed, F.substring(v, F.lit(2), F.length(v))).otherwise(v), F.lit("0"))
    return F.when(v.rlike(_INTEGER), F.when(digits == "", "0").when(v.startswith("-"), F.concat(F.lit("-"), digits)).otherwise(digits))


def _decimal(v: Column) -> Column:
    """Two fraction digits; values with more than two significant ones are rounded half up. Numbers of usual length are
    cast, others are written from their digits, so that none is too long."""
    number = v.try_cast("decimal(38,6)").try_cast("decimal(38,2)")
    usual = F.when(number == 0, "0.00").otherwise(number.cast("string"))
    return F.when(v.rlike(_DECIMAL), F.when(v.rlike(_USUAL), usual).otherwise(_long_decimal(v)))


def _long_decimal(v: Column) -> Column:
    sign, whole, part = (F.regexp_extract(v, _PARTS, k) for k in (1, 2, 3))
    cents = F.concat(whole, F.rpad(F.substring(part, 1, 2), 2, "0"))
    kept = F.rtrim(cents, F.lit("9"))  # a carry turns the nines behind it to zeros
    carried = F.concat(F.left(kept, F.length(kept) - 1), F.translate(F.right(kept, F.lit(1)), "012345678", "123456789"))
    zeros = F.repeat(F.lit("0"), F.length(cents) - F.length(kept))
    rounded = F.when(F.substring(part, 3, 1) >= "5", F.concat(F.when(kept == "", "1").otherwise(carried), zeros)).otherwise(cents)
    units = F.left(rounded, F.length(rounded) - 2)
    minus = F.when((sign == "-") & (rounded != "00"), "-").otherwise("")
    return F.concat(minus, F.when(units == "", "0").otherwise(units), F.lit("."), F.right(rounded, F.lit(2)))


def _date(v: Column) -> Column:
    """A real day of the (proleptic) Gregorian calendar; leap years depend on the last four digits of the year only."""
    year, month, day = (F.regexp_extract(v, _DATE, k) for k in (1, 2, 3))
    last = F.substring(year, -4, 4).try_cast("int")
    leap = (last % 4 == 0) & ((last % 100 != 0) | (last % 400 == 0))
    days = F.when(month.isin("04", "06", "09", "11"), 30).when(month == "02", F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.when(v.rlike(_DATE) & (day.try_cast("int") <= days), v)


def _boolean(v: Column) -> Column:
    return F.when(v.isin("true", "1"), "true").when(v.isin("false", "0"), "false")


def _canonical(text: Column, value: Column, datatype: Column) -> Column:
    return (
        F.when(datatype == "string", text)
        .when(datatype == "integer", _integer(value))
        .when(datatype == "decimal", _decimal(value))
        .when(datatype == "date", _date(value))
        .when(datatype == "boolean", _boolean(value))
    )


def canonical_value(o: Column, datatype: Column) -> Column:
    """The canonical text of object ``o`` read as ``datatype``, or null where it is no lexical form of it.

    integer: plain digits, ``-`` only for negative values. decimal: two fraction digits. date: yyyy-MM-dd, no zone.
    boolean: true or false. string: unchanged, may be empty. Except for string, spaces around the content are ignored.
    A null, an IRI, a blank node and an unknown datatype give null.
    """
    text = content(o)
    return _canonical(text, F.btrim(text, F.lit(_SPACES)), datatype)


@lru_cache(maxsize=4)
def _canonical_columns(_gateway: int) -> Column:
    """The expression on the columns of ``with_canonical``: it is long, and made once for a connection to the JVM."""
    return _canonical(F.col("_text"), F.col("_value"), F.col("_type"))


def with_canonical(df: DataFrame, o: Column, datatype: Column, name: str, *kept: str) -> DataFrame:
    """(*kept, name): the columns ``kept`` of ``df`` and the canonical text of ``o`` read as ``datatype``, as ``canonical_value``
    has it. Content and trimmed content are columns of their own on the way, so each is worked out once for a row."""
    texts = df.select(*kept, content(o).alias("_text"), datatype.alias("_type"))
    values = texts.select(*kept, "_text", "_type", F.btrim("_text", F.lit(_SPACES)).alias("_value"))
    return values.select(*kept, _canonical_columns(id(df.sparkSession.sparkContext._gateway)).alias(name))

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.operators.rejects import good_triples, load_lines, rejected, split_lines

GOOD = {
    "<a> <p> <b> .": ("<a>", "<p>", "<b>"),
    "  <a>\t<p>  <b>. \r": ("<a>", "<p>", "<b>"),
    '_:b1 <p> "x y"@en-GB': ("_:b1", "<p>", '"x y"@en-GB'),
    '<a> <p> "a \\"q\\" b" .': ("<a>", "<p>", '"a \\"q\\" b"'),
    '<a> <p> "C:\\\\" .': ("<a>", "<p>", '"C:\\\\"'),
    '<a> <p> "<t> & > . ; # x"^^<u>.': ("<a>", "<p>", '"<t> & > . ; # x"^^<u>'),
    "<a> <p> 5.": ("<a>", "<p>", "5"),
    "<a> <p> +4.25 .": ("<a>", "<p>", "+4.25"),
    "<a> <p> false.": ("<a>", "<p>", "false"),
    "<a> <p> _:x.y.": ("<a>", "<p>", "_:x.y"),
    '<a> <p> "2024-02-29"^^<xsd/date> .': ("<a>", "<p>", '"2024-02-29"^^<xsd/date>'),
    '<a> <p> "\\u00E9 \\U0001F30A" .': ("<a>", "<p>", '"\\u00E9 \\U0001F30A"'),
    '<a> <p> "日本語"@ja .': ("<a>", "<p>", '"日本語"@ja'),
    '<> <p> "" .': ("<>", "<p>", '""'),
}
BAD = {
    "quoting": ['<a> <p> "x .', '<a> <p> "x\\" .', '<a> <p> "a "b" c" .', '<a> <p> ""x""@en .', '<a> <p> "x"y .', '<a> <p> "x"<b> .', "<a <p> <b> .", "a> <p> <b> .", '<a> <p> "1"^^<xsd/integer .', '<a> <p> "5 "t" .'],
    "column_count": [".", "<a> .", "<a> <p> .", "<a> <p> <b> <g> .", "<a> <p> <b> . <c> <p> <d> .", "<a> <p> <b> ; <q> <d> .", '<a> <p> "x" "y"@en .', "<a> <p> <b> . .", "word", "<a> <p> <b> . # note"],
    "invalid_value": [
        "a <p> <b> .", '"a" <p> <b> .', "<a> _:p <b> .", "<a> a <b> .", '<a> "p" <b> .', "<a> <p> b .", "<a> <p> _: .", "<a> <p> _:-x .", "<a> <p> <b c> .", "<a> <p> <b^> .", '<a> <p> "x"@ .', '<a> <p> "x"@en_GB .', '<a> <p> "x"^^xsd .',
        '<a> <p> "\\x" .', '<a> <p> "\\u12G4" .', '<a> <p> "1.5"^^<xsd/integer> .', '<a> <p> " 5"^^<xsd/integer> .', '<a> <p> "2023-02-29"^^<xsd/date> .', '<a> <p> "2020-01-01Z"^^<xsd/date> .', '<a> <p> "TRUE"^^<xsd/boolean> .', '<a> <p> "1e3"^^<xsd/decimal> .', "<a> <p> 1e3 .", "<a> <p> - .",
    ],
}
SKIPPED = [None, "", "   ", "\t", "\r", "# note: \"open", "  #<a> <p> <b> ."]


def test_every_line_has_its_result(spark):
    lines = [*GOOD, *SKIPPED, *(x for bad in BAD.values() for x in bad)] * 2
    df = spark.createDataFrame([(k, line, "clash", "clash") for k, line in enumerate(lines)], "line_id long, line string, s string, reason string")
    found = {row.line_id: row for row in load_lines(df).collect()}
    reasons = {line: reason for reason, bad in BAD.items() for line in bad}
    for k, line in enumerate(lines):
        if line in GOOD:
            assert (found[k].s, found[k].p, found[k].o, found[k].reason) == (*GOOD[line], None), line
        elif line in SKIPPED:
            assert k not in found
        else:
            assert (found[k].s, found[k].reason) == (None, reasons[line]), line
    assert good_triples(load_lines(df)).count() == 2 * len(GOOD)
    assert rejected(load_lines(df)).columns == ["line_id", "reason"]


def test_empty_long_and_missing(spark):
    df = spark.createDataFrame([], "line_id long, line string")
    assert load_lines(df).collect() == []
    long = '<a> <p> "' + "x y \\\\ " * 100_000 + '" .'
    which, terms, reason = split_lines(pa.array([long, long[:-3]]))
    assert reason.to_pylist() == [None, "quoting"] and terms[2][0].as_py() == long[8:-2]
    assert split_lines(pa.array([None, ""], pa.string()))[0].tolist() == []
    with pytest.raises(ValueError):
        load_lines(spark.range(1))


def test_slices_are_put_together_again(spark, monkeypatch):
    from brindle.operators import rejects

    lines = pa.array(['<a> <p> "' + "x" * k + '" .' for k in range(50)] + [None, "", "<a>", "<a> <p> <b>"])
    monkeypatch.setattr(rejects, "SLICE", 100)
    slices = list(rejects._slices(lines))
    assert pa.concat_arrays(slices).equals(lines) and len(slices) > 10 and all(len(x) for x in slices)


def slow(line):
    """The structure of a line, one character after another: None, a reason, or the number of terms."""
    line = line.strip(" \t\r\n")
    quote, depth, terms, inside, k = False, 0, 0, False, 0
    while k < len(line):
        c = line[k]
        back = len(line[:k]) - len(line[:k].rstrip("\\"))
        if c == '"' and back % 2 == 0:
            quote = not quote
            if not quote:
                rest = line[k + 1 :]
                if rest and rest[0] not in " \t@" and not rest.startswith("^^") and not (rest[0] == "." and (len(rest) == 1 or rest[1] in " \t")):
                    return "quoting"
            inside, terms = True, terms + (not inside)
        elif quote:
            pass
        elif c == "<" or c == ">":
            depth += 1 if c == "<" else -1
            if depth not in (0, 1):
                return "quoting"
            inside, terms = True, terms + (not inside)
        elif c in " \t" and depth == 0:
            inside = False
        else:
            inside, terms = True, terms + (not inside)
        k += 1
    if quote or depth:
        return "quoting"
    return "column_count" if terms - (line[-1] == "." and (len(line) == 1 or line[-2] in " \t")) != 3 else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='<>"\\ \t.ab@^', min_size=1, max_size=20), min_size=1, max_size=8))
def test_structure_against_a_scanner(lines):
    which, _, reason = split_lines(pa.array(lines))
    for k, i in enumerate(which):
        got, want = reason[k].as_py(), slow(lines[i])
        if "quoting" in (got, want):
            assert got == want, lines[i]
        elif not lines[i].strip(" \t\r\n").endswith("."):
            assert (got == "column_count") == (want == "column_count"), lines[i]

import collections
import itertools
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.glyphs import LOOK_ALIKES, Transducer, base_rules, consistent, resolve, same_looking_classes, same_looking_pairs, transducer
from pyspark.sql import functions as F

SAME = [
    ("é", "e\u0301", "\u0435\u0301", "e\u200b\u0301", "\uff45\u0301"),
    ("Å", "\u212b", "A\u030a", "\u0391\u030a"),
    ("K1/2 (x)", "\u212a1/2 (x)", "\uff2b\uff11\uff0f\uff12\u3000\uff08\uff58\uff09", "\u041a1/2\u00a0(\u0445)"),
    ("a b", "a\u00a0b", "a\u2007b", "a\u202fb", "a\u3000b", "a\u200e b\ufeff"),
    ("Vv D", "\u2164\u2174 \u216e"),
    ("ガカ", "\uff76\uff9e\uff76", "カ\u3099カ"),
    ("5 µm", "5 \u03bcm"), ("\u03a9", "\u2126"),
    ("ï", "\u0457", "\u0456\u0308"), ("fi", "\ufb01"), ("viii", "\u2177"), ("한", "\u1112\u1161\u11ab"),
    ("ậ", "a\u0323\u0302", "a\u0302\u0323", "\u1ea1\u0302"),
]
DIFFERENT = ["x2", "x²", "X2", "x 2", "x\u0301 2", "xż2", "xz2", "в", "b", "B", "т", "t", "к", "k", "0", "O", "1", "l", "I", "a.b", "a,b", "a-b", "a–b", "ı", "i", '"x"@en', '"x"@de', "カ", "力"]


@pytest.mark.parametrize("group", SAME)
def test_same_look_same_form(group):
    assert len({transducer()(text) for text in group}) == 1


def test_different_look_different_form():
    assert len({transducer()(text) for text in DIFFERENT}) == len(DIFFERENT)


def test_joiners_stay_where_they_show():
    t = transducer()
    assert t("می\u200cخواهم") == "می\u200cخواهم" and t("👩\u200d🔬") == "👩\u200d🔬" and t("क्\u200dष") == "क्\u200dष"
    assert t("a\u200db\u200cc") == "abc" and t("\u200b\u00ad") == "" and t("") == ""


def test_conflicts_are_found():
    with pytest.raises(ValueError):
        resolve([("a", "х", "x"), ("b", "х", "y")])
    with pytest.raises(ValueError):
        resolve([("a", "х", "у"), ("b", "у", "х")])
    assert resolve([("a", "ｘ", "х"), ("b", "х", "x")]) == {"ｘ": "x", "х": "x"}
    flat = [c for others in LOOK_ALIKES.values() for c in others]
    assert len(flat) == len(set(flat)) and all(unicodedata.normalize("NFC", c) == c for c in flat)
    mapping = resolve(base_rules())
    assert not any(c in mapping for to in mapping.values() for c in to)


def brute(text):
    """The rules on decomposed characters, composed again, without clusters or a compiled mapping."""
    mapping = resolve(base_rules())
    out = "".join(mapping.get(c, c) for c in unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", "".join(mapping.get(c, c) for c in unicodedata.normalize("NFD", out)))


ALPHABET = "ab eoВвｅ\uff21\u0301\u0308\u0323\u030a\u200b\u00ad\u034f\u3000\u00a0éÅ\u212bёЇ\u03bc\u00b5\u2164²カ\u3099\uff76\uff9e5"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=12))
def test_against_whole_text_normalisation(text):
    once = transducer()(text)
    assert once == transducer()(once) == brute(text)


def test_rules_can_be_replaced():
    assert Transducer([("x", "ß", "ss")])("Maß") == "Mass"


ROWS = [(1, "a b"), (2, "a\u00a0b"), (3, "a b"), (4, "A b"), (5, None), (6, ""), (7, "\u0430 b"), (8, "a b "), (None, "a\u3000b"), (9, None), (10, "plain"), (11, "plain"), (12, "pl\u00adain")]


def test_pairs_against_brute_force(spark):
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in ROWS], "row_id long, o string, form string, n int")
    t = transducer()
    want = {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(ROWS, 2) if None not in (a, b, x, y) and x != y and t(x) == t(y)}
    found = [tuple(row) for row in same_looking_pairs(df, "row_id", "o").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    forms = df.select(consistent(F.col("o"))).collect()
    assert [row[0] for row in forms] == [None if x is None else t(x) for _, x in ROWS]
    assert same_looking_pairs(df.limit(0), "row_id", "o").collect() == []


def test_hot_text_gives_its_pairs_only(spark):
    hot = spark.range(20_000).selectExpr("id as row_id", "'hot' as o").unionByName(spark.createDataFrame([(-1, "h\u200bot"), (-2, "һot")], "row_id long, o string"))
    assert same_looking_pairs(hot, "row_id", "o").count() == 2 * 20_000 + 1
    assert same_looking_pairs(hot, "row_id", "o", hot_rows=90).distinct().count() == 2 * 20_000 + 1


def test_two_hot_texts(spark):
    rows = spark.range(700).selectExpr("id as row_id", "case when id % 7 < 4 then 'hot' when id % 7 < 6 then 'h\u200bot' else concat('x', id) end as o")
    assert same_looking_pairs(rows, "row_id", "o", hot_rows=50).distinct().count() == 400 * 200 == same_looking_pairs(rows, "row_id", "o", hot_rows=50).count()
    classes = same_looking_classes(rows, "row_id", "o", hot_rows=50)
    assert {tuple(r) for r in classes.groupBy("class_id", "n_links").count().collect()} == {(0, 200, 400), (0, 400, 200)}


def test_classes_against_pairs(spark):
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in ROWS], "row_id long, o string, form string, n int")
    pairs = [tuple(row) for row in same_looking_pairs(df, "row_id", "o").collect()]
    classes = {row.row_id: (row.class_id, row.n_links) for row in same_looking_classes(df, "row_id", "o").collect()}
    assert {k: n for k, (_, n) in classes.items()} == dict(collections.Counter(itertools.chain(*pairs)))
    assert all(classes[a][0] == classes[b][0] <= a for a, b in pairs)
    assert same_looking_classes(df.limit(0), "row_id", "o").collect() == []


def test_letters_that_are_drawn_alike():
    t = transducer()
    for one, two in ("ӕæ", "ӔÆ", "әə", "ӘƏ", "ӡʒ", "ĐÐ", "ƉÐ", "ⲞO", "ꓐB", "۱١", ("o\u0338", "ø"), ("o\u0338\u0301", "ǿ"), ("d\u0335", "đ"), ("l\u0337", "ł"), ("о\u0301\u0338", "ǿ")):
        assert t(one) == t(two), ascii((one, two))
    for one, two in ("۴٤", "đð", "oø", "łl", "²2", "–-"):
        assert t(one) != t(two), ascii((one, two))


def test_rest_behind_the_longest_sequence():
    t = Transducer([("x", "ο", "o"), ("x", "\u200b", "")])
    assert t("ο\u0301\u0323") == "\u1ecd\u0301" and t("ο\u200b\u0323\u0301") == "\u1ecd\u0301" and t("ο\u0302\u0301\u0348") == t("\u1ed1\u0348")


def test_long_runs_of_marks():
    text = "e" + "\u0301\u0323" * 50_000 + "x" + "\u0323\u0301" * 40
    assert transducer()(text[:201]) == unicodedata.normalize("NFC", text[:201])
    once = transducer()(text)
    assert once == transducer()(once) and once.count("\u0301") + once.count("\u0323") > 100_000 - 2


def test_very_long_text():
    text = "e\u0301\u200b " * 200_000
    assert transducer()(text) == "é " * 200_000


def test_canonical_equivalents_of_all_characters():
    t = transducer()
    for char in map(chr, range(0x80, 0x110000)):
        parts = unicodedata.normalize("NFD", char)
        if parts != char:
            assert t(char) == t(parts) == t(t(char)) and t(f"x{char} ") == t(f"x{parts} "), hex(ord(char))
    for one, two in (("\ufb1d", "\u05d9\u05b4"), ("\u0995\u09cb", "\u0995\u09c7\u09be"), ("\uac01", "\uac00\u11a8"), ("\u0915\u093c\u094d", "\u0915\u094d\u093c")):
        assert t(one) == t(two), ascii(one)


def test_joiners_keep_their_place_beside_signs():
    t = transducer()
    for text in ("\u09b0\u200d\u09cd\u09af", "\u09b0\u09cd\u200d\u09af", "\u0915\u094d\u200c\u0937", "\u0d28\u0d4d\u200d"):
        assert t(text) == text
    assert t("\u0915\u200b\u094d\u200d\u0937") == "\u0915\u094d\u200d\u0937"

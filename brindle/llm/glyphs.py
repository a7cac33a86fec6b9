"""One consistent form for text that looks the same (problem 1).

A mapping from character sequences to their consistent form is computed once from rules: widths, spaces, invisible
characters, accents and look-alike letters. It is checked for conflicts and compiled to a transducer that reads a text once,
grapheme cluster by grapheme cluster: it writes the output of the longest known sequence and goes on behind it. Text in
plain ASCII is never sent to Python; of other text only clusters that may change are looked at, and each distinct one is
worked out once per worker.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like a Latin letter (Greek, Cyrillic, Armenian, Cherokee, Coptic and
# Lisu ones, and Latin letters that share a form), each beside that letter.
LOOK_ALIKES = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴⲂꓐ", "C": "СϹᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "ꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻⲎꓧ", "I": "ΙІӀⲒꓲ", "J": "ЈͿᎫꓙ", "K": "ΚКᏦⲔꓗ",
    "L": "Ꮮꓡ", "M": "ΜМᎷⲘꓟ", "N": "ΝⲚꓠ", "O": "ΟОՕⲞꓳ", "P": "ΡРᏢⲢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢⲦꓔ", "U": "Սꓴ",
    "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ΧХⲬꓫ", "Y": "ΥУҮⲨꓬ", "Z": "ΖᏃⲌꓜ",
    "a": "а", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօⲟ",
    "p": "рⲣ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
    "Æ": "Ӕ", "æ": "ӕ", "Ə": "Ә", "ə": "ә", "Ʒ": "Ӡ", "ʒ": "ӡ", "Ð": "ĐƉ",
}

# Overlays that make a letter with a stroke. A stroke goes slantwise through the letters named, else across.
ACROSS, SLANTWISE, SLANTED = "\u0335", "\u0337\u0338", "ACELO"

# The digits that both rows of Arabic digits draw alike.
SAME_DIGITS = "0123789"

# Characters that take no room and leave no mark, as inclusive ranges: controls other than tabs and line
# ends, soft hyphen, grapheme joiner, direction marks, fillers, zero-width characters, variation selectors, tags.
INVISIBLE = [
    (0x00, 0x08), (0x0E, 0x1B), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
]

# The joiners, and the scripts (as ranges of letters) in which they change how neighbours are drawn.
JOINERS = "\u200c\u200d"
JOINING = [(0x600, 0x8FF), (0x900, 0xDFF), (0x1000, 0x109F), (0x1780, 0x18AF), (0x2190, 0x2BFF), (0x1F000, 0x1FAFF)]

# Those of these scripts in which it shows whether a joiner stands before or behind a sign.
ORDERED = [(0x900, 0xDFF), (0x1000, 0x109F), (0x1780, 0x17FF)]
JOINED = frozenset(JOINERS)
_JOINER = re.compile(f"([{JOINERS}])")

#: Runs of characters beyond printable ASCII: whatever isn't in one is in its consistent form.
_ODD = re.compile(r"[^\x20-\x7e\t\n\r]+")

#: Runs and clusters of this length at most are kept by a worker, so many at most.
KNOWN_CHARS, KNOWN_MOST = 16, 200_000

# Blocks whose compatibility characters are drawn like their plain letters: number forms of Roman digits,
# ligatures, digraphs, and the micro sign.
SAME_SHAPE = [(0xB5, 0xB5), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB06)]

def _inside(ranges: list[tuple[int, int]]) -> Iterator[str]:
    return (chr(code) for a, b in ranges for code in range(a, b + 1))


def _within(char: str, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= ord(char) <= b for a, b in ranges)


def base_rules() -> list[tuple[str, str, str]]:
    """(kind, character, replacement) of every rule on single characters. Raised digits and all signs that differ to the
    eye have no rule."""
    rules = [("invisible", char, "") for char in _inside(INVISIBLE)]
    spaces = [char for char in map(chr, range(0x80, 0x3001)) if unicodedata.category(char) == "Zs" and char != " "]
    rules += [("space", char, " ") for char in spaces]
    rules += [("look-alike", other, latin) for latin, others in LOOK_ALIKES.items() for other in others]
    for char in _inside([(0x3000, 0x3000), (0xFF00, 0xFF9F), (0xFFA1, 0xFFEF)]):
        tag, *codes = unicodedata.decomposition(char).split() or [""]
        if tag in ("<wide>", "<narrow>"):
            rules.append(("width", char, "".join(chr(int(code, 16)) for code in codes)))
    rules += [("digit", chr(0x6F0 + int(digit)), chr(0x660 + int(digit))) for digit in SAME_DIGITS]
    for char in _inside(SAME_SHAPE):
        plain = unicodedata.normalize("NFKC", char)
        if plain != char:
            rules.append(("same shape", char, plain))
    return rules


def stroke_rules() -> list[tuple[str, str]]:
    """(letter and overlay, letter with stroke) of all Latin letters that have a form with a stroke, by their names."""
    out = []
    for code in range(0xC0, 0x2C80):
        name = unicodedata.name(chr(code), "")
        if name.startswith("LATIN ") and name.endswith(" WITH STROKE"):
            try:
                letter = unicodedata.lookup(name.removesuffix(" WITH STROKE"))
            except KeyError:
                continue
            out += [(letter + overlay, chr(code)) for overlay in (SLANTWISE if letter.upper() in SLANTED else ACROSS)]
    return out


def resolve(rules: list[tuple[str, str, str]]) -> dict[str, str]:
    """One replacement for each character, followed to its end; raises ValueError where rules conflict.

    A conflict is: two rules give one character different ends, or a chain of rules never ends. Afterwards no replacement
    holds a character that has a rule, so applying the mapping twice changes nothing more.
    """
    step: dict[str, set[str]] = {}
    for _, char, to in rules:
        step.setdefault(char, set()).add(to)

    def end(text: str, seen: tuple[str, ...]) -> str:
        out = []
        for char in text:
            if char in seen:
                raise ValueError(f"rules on {char!r} never end")
            ends = {end(to, (*seen, char)) for to in step[char]} if char in step else {char}
            if len(ends) > 1:
                raise ValueError(f"rules on {char!r} disagree: {sorted(ends)}")
            out.append(ends.pop())
        return "".join(out)

    return {char: end(char, ()) for char in step}


@lru_cache(maxsize=1)
def _composed() -> dict[str, str]:
    """The parts of all characters with a canonical decomposition, but for Hangul syllables, which are their own composed form."""
    chars = (char for char in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.decomposition(char)[:1] not in ("", "<"))
    return {char: unicodedata.normalize("NFD", char) for char in chars}


def decomposed(text: str) -> str:
    """The parts of ``text`` with the marks of each base in canonical order; also long runs of marks are sorted at once."""
    known, out = _composed(), []
    marks: list[str] = []
    for char in text:
        for part in known.get(char) or (unicodedata.normalize("NFD", char) if "\uac00" <= char <= "\ud7a3" else char):
            if unicodedata.combining(part):
                marks.append(part)
            else:
                out += sorted(marks, key=unicodedata.combining)
                marks = []
                out.append(part)
    return "".join(out + sorted(marks, key=unicodedata.combining))


def composed(text: str) -> str:
    """NFC of ``text``, whose marks are in order already: a run of many marks is no work for the library then."""
    return unicodedata.normalize("NFC", text)


def _attached() -> set[str]:
    """All characters that may be sorted or composed with one before them, as marks, vowel signs and jamo, or enclose it."""
    marks = {char for char in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.combining(char)}
    for parts in _composed().values():
        marks.update(parts[1:])
    return marks | set(_inside([(0x1161, 0x1175), (0x11A8, 0x11C2), (0x20D0, 0x20F0)]))


class Transducer:
    """The compiled mapping: a trie over sequences of characters whose nodes carry the output of the sequence so far.

    ``rules`` replace the single-character rules. Sequences of a base and its combining marks are compiled for all precomposed
    letters, and for every base that is mapped to theirs; a sequence that two rules give different outputs is refused.
    """

    def __init__(self, rules: list[tuple[str, str, str]] | None = None):
        self.base = resolve(base_rules() if rules is None else rules)
        self.invisible = {char for char, to in self.base.items() if not to}
        self.root: dict = {}
        self._compile(stroke_rules() if rules is None else [])
        self._known: dict[str, str] = {}
        self.extend = _attached() | self.invisible | {"ﾞ", "ﾟ"}
        extend = _char_class(self.extend)
        #: A grapheme cluster; marks that an invisible character keeps apart from their base belong to it.
        self.cluster = regex.compile(rf"\X{extend}*", regex.DOTALL)
        #: Where a joiner ties a cluster to a further base, as in joined pictures.
        self.joint = regex.compile(rf"(?<=[{JOINERS}])(?=[^{extend[1:-1]}])")

    def _sequence(self, parts: str) -> str:
        """The consistent form of a decomposed sequence, by the rules: map the characters, then compose."""
        return composed(decomposed("".join(self.base.get(char, char) for char in decomposed(parts))))

    def _add(self, sequence: str, out: str) -> None:
        node = self.root
        for char in sequence:
            node = node.setdefault(char, {})
        if node.setdefault("", out) != out:
            raise ValueError(f"{sequence!r} maps to {node['']!r} and {out!r}")

    def _compile(self, strokes: list[tuple[str, str]]) -> None:
        variants: dict[str, list[str]] = {}
        for char, to in self.base.items():
            self._add(char, unicodedata.normalize("NFC", to))
            variants.setdefault(to, []).append(char)
        for parts in _composed().values():
            if len(parts) > 1:
                for base in [parts[0], *variants.get(parts[0], [])]:
                    self._add(base + parts[1:], self._sequence(base + parts[1:]))
        for sequence, letter in strokes:
            for base in [sequence[0], *variants.get(sequence[0], [])]:
                self._add(base + sequence[1:], self.base.get(letter, letter))

    def _cluster(self, cluster: str) -> str:
        """The consistent form of one cluster: the output of the longest compiled sequence, then that of its rest, and so on.

        Invisible characters are passed over. Where several outputs meet they are composed.
        """
        if _within(cluster[0], ORDERED) and not JOINED.isdisjoint(cluster):
            return "".join(part if part in JOINED else self._cluster(part) for part in _JOINER.split(cluster) if part)
        if len(pieces := self.joint.split(cluster)) > 1:
            return "".join(map(self._cluster, pieces))
        visible = "".join(char for char in cluster if char not in self.invisible)
        if not visible:
            return ""
        parts, at, outputs = decomposed(visible), 0, []
        while at < len(parts):
            node, output, end = self.root, parts[at], at + 1
            for k in range(at, len(parts)):
                node = node.get(parts[k])
                if node is None:
                    break
                if "" in node:
                    output, end = node[""], k + 1
            outputs.append(output)
            at = end
        out = outputs[0] if len(outputs) == 1 else composed(decomposed("".join(outputs)))
        if _within(visible[-1] if not unicodedata.combining(visible[-1]) else visible[0], JOINING):
            out += "".join(char for char in cluster if char in JOINERS or (char == "\ufe0f" and ord(visible[0]) > 0x218F))
        return out

    def _look_up(self, sequence: str, work_out: Callable[[str], str]) -> str:
        out = self._known.get(sequence)
        if out is None:
            out = work_out(sequence)
            if len(sequence) <= KNOWN_CHARS:
                if len(self._known) > KNOWN_MOST:
                    self._known.clear()
                self._known[sequence] = out
        return out

    def _run(self, run: str) -> str:
        return "".join(self._look_up(cluster, self._cluster) for cluster in self.cluster.findall(run))

    def __call__(self, text: str) -> str:
        """``text`` in its consistent form; the result of a second pass is the same."""
        if text.isascii() and text.isprintable():
            return text
        out, at = [], 0
        for found in _ODD.finditer(text):
            start = found.start()
            if start > at and text[start] in self.extend:
                start -= 1  # marks or invisible characters behind a plain letter
            out += (text[at:start], self._look_up(text[start : found.end()], self._run))
            at = found.end()
        return "".join(out) + text[at:]


def forms_sql(column: str) -> str:
    """SQL for the consistent form of a text without joiners that show, from the rules alone: characters are removed and replaced
    one kind after the other and the result is composed. It is what the transducer is compared with."""
    base = resolve(base_rules())
    steps = {char: to for char, to in base.items() if to}
    for char, parts in _composed().items():
        if parts[0] in base and char not in base:
            steps[char] = composed(base[parts[0]] + parts[1:])
    single = {char: to for char, to in steps.items() if len(to) == 1}
    several = {char: to for char, to in steps.items() if len(to) > 1} | dict(stroke_rules())
    gone = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in INVISIBLE)
    quoted = [text.replace("'", "''") for text in ("".join(single), "".join(single.values()))]
    sql = f"translate(regexp_replace({column}, '[{gone}]', '', 'g'), '{quoted[0]}', '{quoted[1]}')"
    for char, to in several.items():
        sql = f"replace({sql}, '{char}', '{to}')"
    return f"nfc_normalize({sql})"


def _char_class(chars: set[str]) -> str:
    codes, out = sorted(map(ord, chars)), []
    while codes:
        n = 1
        while n < len(codes) and codes[n] == codes[0] + n:
            n += 1
        out.append(f"\\U{codes[0]:08x}" + (f"-\\U{codes[n - 1]:08x}" if n > 1 else ""))
        codes = codes[n:]
    return f"[{''.join(out)}]"


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def consistent(text: Column) -> Column:
    """``text`` in its consistent form; null stays null, empty stays empty.

    Rows in printable ASCII are their own consistent form and skip Python: the Arrow batches hold nulls for them. The
    function is declared non-deterministic, though it isn't, to keep Catalyst from copying it into filters further down.
    """

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        change = transducer()
        return texts.map(change, na_action="ignore")

    apply = apply.asNondeterministic()
    plain = text.rlike(r"^[\x20-\x7e\t\n\r]*$")
    return F.when(plain, text).otherwise(apply(F.when(~plain, text)))


#: A text with more than this share of all rows, and more than so many rows, is spread over tasks by a salt.
HOT_SHARE, HOT_ROWS = 0.0001, 10_000


def _texts(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, t) with neither null, and the distinct texts (t, n, id, form) that have a look-alike or may have one: a class
    of look-alikes exists only where some text is not in consistent form, so the others are left out by a semi join."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    texts = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).withColumn("form", consistent(F.col("t")))
    # With n and id these are the same aggregation, done once.
    odd = texts.where("form <> t and n > 0 and id is not null").select("form").distinct()
    return rows, texts.join(odd, "form", "left_semi")


def _salts(texts: DataFrame, total: DataFrame, hot_rows: int) -> DataFrame:
    """(h, parts) of the hot ones among ``texts`` by the hash of the text: at most 1/HOT_SHARE rows of two numbers."""
    most = F.greatest(total.scalar(), F.lit(float(hot_rows)))
    hot = texts.where(F.col("n") > most).select(F.xxhash64("t").alias("h"), F.ceil(F.col("n") / most).cast("int").alias("parts"))
    return F.broadcast(hot.groupBy("h").agg(F.max("parts").alias("parts")))


def _parts(df: DataFrame, text: str, salts: DataFrame, name: str) -> DataFrame:
    """``df`` with the number of parts that the rows of ``text`` are spread over, 1 for all but the hot ones."""
    with_hash = df.withColumn("h", F.xxhash64(text)).join(salts, "h", "left")
    return with_hash.withColumn(name, F.coalesce("parts", F.lit(1))).drop("h", "parts")


def _spread(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def same_looking_pairs(df: DataFrame, key: str, text: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(row_a, row_b): the pairs of rows whose texts look the same but differ, the smaller key first, each pair once.

    A null text looks like nothing, not even like another null; rows with a null key give no pair. Rows with equal texts
    are no pair, whatever their number. Exactly the pairs asked for are made, none is made and thrown away:

    1. equal texts are counted (combined before the shuffle) and brought to their form once each;
    2. the distinct texts of a class are paired, the frequent one first;
    3. each pair of texts is expanded to rows. The rows of a hot text are spread over as many parts as its count asks for
       (``HOT_SHARE``, ``hot_rows``), the rows of its partner are repeated for each; usual texts have one part.

    The result has a row for each pair; ``same_looking_classes`` has one for each row instead.
    """
    rows, texts = _texts(df, key, text)
    total = rows.agg((F.count(F.lit(1)) * F.lit(HOT_SHARE)).alias("n"))
    salts = _salts(texts, total, hot_rows)
    one, two = texts.alias("one"), texts.alias("two")
    more = (F.col("one.n") > F.col("two.n")) | ((F.col("one.n") == F.col("two.n")) & (F.col("one.t") > F.col("two.t")))
    pairs = one.join(two, (F.col("one.form") == F.col("two.form")) & more).select(F.col("one.t").alias("often"), F.col("two.t").alias("rare"))
    pairs = _parts(_parts(pairs, "often", salts, "often_parts"), "rare", salts, "rare_parts")
    salted = _parts(rows, "t", salts, "of").select("id", "t", F.pmod(F.xxhash64("id"), F.col("of")).cast("int").alias("part"))
    left = pairs.select("often", "rare", _spread("often_parts").alias("part")).join(salted.select(F.col("id").alias("a"), F.col("t").alias("often"), "part"), ["often", "part"])
    right = pairs.select("often", "rare", "often_parts", _spread("rare_parts").alias("part")).join(salted.select(F.col("id").alias("b"), F.col("t").alias("rare"), "part"), ["rare", "part"])
    right = right.select("b", "often", "rare", _spread("often_parts").alias("part"))
    both = left.join(right, ["often", "rare", "part"])
    return both.select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))


def same_looking_classes(df: DataFrame, key: str, text: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, class_id, n_links): every row whose text looks like a different one, with the least key of its class and the
    number of rows that it looks like without being equal.

    Null texts and null keys are left out; a repeated key is a row of its own. The result grows with the rows, whatever the
    size of a class.
    """
    rows, texts = _texts(df, key, text)
    total = rows.agg((F.count(F.lit(1)) * F.lit(HOT_SHARE)).alias("n"))
    salts = _salts(texts, total, hot_rows)
    classes = texts.groupBy("form").agg(F.min("id").alias("class_id"), F.sum("n").alias("all_rows"))
    linked = texts.join(classes, "form").select("t", "class_id", (F.col("all_rows") - F.col("n")).alias("n_links")).where("n_links > 0")
    linked = _parts(linked, "t", salts, "of").select("t", "class_id", "n_links", _spread("of").alias("part"))
    salted = _parts(rows, "t", salts, "of").select("id", "t", F.pmod(F.xxhash64("id"), F.col("of")).cast("int").alias("part"))
    return salted.join(linked, ["t", "part"]).select(F.col("id").alias(key), "class_id", "n_links")

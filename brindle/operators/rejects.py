"""Loading of raw triple lines with the rows that fail set aside (problem 5).

Structural indexing: the bytes of an Arrow batch are one numpy array. Masks find escapes, quotes and brackets; the parity
of the quotes before a byte, counted from the start of its line, tells whether it is inside a literal; so delimiters and
line ends are known for the whole batch without a loop over lines. Counts and checks then make each line a valid row or a
reject with the first reason that applies. Lines are independent: the operator is one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The terms of N-Triples. IRIs may be relative here.
_UCHAR = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_IRI = rf"<(?:[^\x00-\x20<>\"{{}}|^`\\]|{_UCHAR})*>"
_START = "A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{2FF}\\x{370}-\\x{37D}\\x{37F}-\\x{1FFF}\\x{200C}-\\x{200D}\\x{2070}-\\x{218F}\\x{2C00}-\\x{2FEF}\\x{3001}-\\x{D7FF}\\x{F900}-\\x{FDCF}\\x{FDF0}-\\x{FFFD}\\x{10000}-\\x{EFFFF}_:"
_INNER = _START + "0-9\\x{B7}\\x{300}-\\x{36F}\\x{203F}-\\x{2040}-"
_BLANK = rf"_:[{_START}0-9](?:[{_INNER}.]*[{_INNER}])?"
_TEXT = rf"\"(?:[^\"\\\n\r]|\\[tbnrf\"'\\]|{_UCHAR})*\""
_LITERAL = rf"{_TEXT}(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{_IRI})?"
_BARE = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)|true|false"

SUBJECT = rf"^(?:{_IRI}|{_BLANK})$"
PREDICATE = rf"^{_IRI}$"
OBJECT = rf"^(?:{_IRI}|{_BLANK}|{_LITERAL}|{_BARE})$"

# The lexical forms of the datatypes whose content is checked.
CONTENT = {
    "integer": r"[+-]?[0-9]+",
    "decimal": r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)",
    "date": r"-?(?:[1-9][0-9]{4,}|[0-9]{4})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])",
    "boolean": r"true|false|1|0",
}

#: Bytes of lines whose structure is indexed at once.
SLICE = 4_000_000

QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"


def _no_such_day(dates: pa.Array) -> np.ndarray:
    """Whether each literal of a well-formed date names a day that its month doesn't have."""
    part = pc.extract_regex(dates, r"^\"-?[0-9]*?(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})\"")
    y, m, d = (pc.struct_field(part, k).cast(pa.int32()).to_numpy(zero_copy_only=False) for k in range(3))
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    days = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[m] + ((m == 2) & leap)
    return d > days


def _matches(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


class Index:
    """Where the terms of a batch of trimmed lines begin and end, and which lines are broken in their structure."""

    def __init__(self, lines: pa.LargeStringArray):
        ends = _ends(lines)
        data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = (ends - ends[0]).astype(np.int32 if len(data) < 2**31 else np.int64)
        self.start, self.end, n = ends[:-1], ends[1:], len(data)
        line = np.repeat(np.arange(len(lines), dtype=np.int32), np.diff(ends))
        first = self.start[line]
        at = np.arange(n, dtype=ends.dtype)

        # Escapes: a byte after an odd run of backslashes on its line.
        plain = np.maximum.accumulate(np.where(data != 92, at, -1)) if n else at
        run = at - np.maximum(np.concatenate(([-1], plain[:-1])) if n else at, first - 1) - 1
        escaped = run % 2 == 1

        # Quotes: parity from the start of the line; odd from an opening quote up to the byte before the closing one.
        quote = (data == 34) & ~escaped
        count = np.cumsum(quote, dtype=ends.dtype)
        before = np.concatenate(([0], count))
        parity = (count - before[first]) % 2
        literal = parity == 1
        closing = quote & ~literal
        odd = (before[self.end] - before[self.start]) % 2 == 1

        # Brackets outside literals must alternate.
        step = np.where(literal | closing, 0, (data == 60).astype(np.int8) - (data == 62).astype(np.int8))
        depth_all = np.cumsum(step, dtype=ends.dtype)
        depth_before = np.concatenate(([0], depth_all))
        depth = depth_all - depth_before[first]
        wrong = np.bincount(line[(depth < 0) | (depth > 1)], minlength=len(lines)) > 0
        open_end = depth_before[self.end] != depth_before[self.start]
        inside = literal | closing | (depth == 1) | (step == -1)

        # Delimiters outside literals and brackets; terms are the runs between them.
        white = (data == 32) | (data == 9)
        delimiter = white & ~inside
        new = np.concatenate(([True], delimiter[:-1])) if n else delimiter
        begins = ~delimiter & (new | (at == first))
        last = at == self.end[line] - 1
        follows = np.concatenate((delimiter[1:], [True])) if n else delimiter
        finishes = ~delimiter & (follows | last)

        # What follows a closing quote: the end, a delimiter, a tag, or a dot that ends the statement.
        next_byte = np.concatenate((data[1:], [0])) if n else data
        after_next = np.concatenate((data[2:], [0, 0]))[:n] if n else data
        after_next_last = np.concatenate((last[1:], [True])) if n else last
        dot = (next_byte == 46) & (after_next_last | (after_next == 32) | (after_next == 9))
        tag = (next_byte == 64) | ((next_byte == 94) & (after_next == 94))
        loose = closing & ~last & ~follows & ~tag & ~dot
        follows_text = np.bincount(line[loose], minlength=len(lines)) > 0

        self.quoting = odd | wrong | open_end | follows_text
        self.begin, self.finish, self.of = np.flatnonzero(begins), np.flatnonzero(finishes) + 1, line[begins]
        self.data, self.inside = data, inside
        self._drop_final_dots()
        self.count = np.bincount(self.of, minlength=len(lines))

    def _drop_final_dots(self) -> None:
        """Take the optional dot off the last term of each line; a term that was only that dot is none."""
        final = np.concatenate((self.of[1:] != self.of[:-1], [True])) if len(self.of) else np.zeros(0, bool)
        k = np.flatnonzero(final)
        k = k[(self.data[self.finish[k] - 1] == 46) & ~self.inside[self.finish[k] - 1]]
        self.finish[k] -= 1
        keep = self.finish > self.begin
        self.begin, self.finish, self.of = self.begin[keep], self.finish[keep], self.of[keep]


def _ends(lines: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]


def _slices(lines: pa.Array) -> Iterator[pa.Array]:
    """``lines`` in slices of about ``SLICE`` bytes: the masks of a slice take some 40 bytes for each of its bytes."""
    starts = _ends(lines.cast(pa.large_string()))
    at = 0
    while at < len(lines):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE, "right")) - 1)
        yield lines.slice(at, end - at)
        at = end


def split_lines(lines: pa.Array) -> tuple[np.ndarray, list[pa.Array], pa.Array]:
    """(which, [s, p, o], reason) of an array of lines: the numbers of the lines that are neither blank nor comments,
    their terms (null for a reject) and their reason (null for a good line)."""
    lines = pc.utf8_trim(lines.cast(pa.large_string()), " \t\r\n")
    used = pc.and_(pc.is_valid(lines), pc.fill_null(pc.invert(pc.match_substring_regex(lines, "^(?:#|$)")), False))
    which = np.flatnonzero(used.to_numpy(zero_copy_only=False))
    lines = pa.concat_arrays([lines.take(pa.array(which))])
    index = Index(lines)
    good = ~index.quoting & (index.count == 3)
    three = good[index.of]
    begin, finish = index.begin[three].reshape(-1, 3), index.finish[three].reshape(-1, 3)
    raw = index.data
    terms = [_cut(raw, begin[:, k], finish[:, k]) for k in range(3)]
    s, p, o = terms
    valid = _matches(s, SUBJECT) & _matches(p, PREDICATE) & _matches(o, OBJECT)
    for name, form in CONTENT.items():
        tagged = np.flatnonzero(valid & _matches(o, rf"^\".*\"\^\^<xsd/{name}>$"))
        content = o.take(pa.array(tagged))
        fits = _matches(content, rf"^\"(?:{form})\"")
        if name == "date" and fits.any():
            at = np.flatnonzero(fits)
            fits[at[_no_such_day(content.take(pa.array(at)))]] = False
        valid[tagged[~fits]] = False
    rows = np.flatnonzero(good)
    reason = np.where(index.quoting, QUOTING, COLUMN_COUNT).astype(object)
    reason[rows] = np.where(valid, None, INVALID_VALUE)
    place = np.full(len(which), -1)
    place[rows[valid]] = np.flatnonzero(valid)
    take = pa.array(place, mask=place < 0)
    return which, [term.take(take) for term in terms], pa.array(reason, pa.string())


def _cut(data: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> pa.Array:
    """The strings data[begin:finish], copied by one gather."""
    sizes = finish - begin
    ends = np.concatenate(([0], np.cumsum(sizes)))
    places = np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[places]))


def load_lines(df: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """(key, s, p, o, reason): every line of ``df`` that is neither null, blank nor a comment.

    A good line has s, p and o in their lexical form and a null reason. A line that fails has null terms and the first
    reason that applies: quoting, column_count or invalid_value. Repeated lines are rows of their own, and a null key is
    kept. Other columns are ignored. Terms inside one pair of angle brackets are one term, whatever they hold.
    """
    for column in (key, line):
        if df.columns.count(column) != 1:
            raise ValueError(f"the table must have one column {column!r}, it has {df.columns}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                which, terms, reason = split_lines(part)
                keys = batch.column(0).slice(at, len(part)).take(pa.array(which))
                at += len(part)
                yield pa.RecordBatch.from_arrays([keys, *(x.cast(pa.string()) for x in terms), reason], names=[key, "s", "p", "o", "reason"])

    schema = T.StructType([df.schema[key], *(T.StructField(x, T.StringType(), True) for x in ("s", "p", "o", "reason"))])
    return df.select(key, line).mapInArrow(run, schema)


def good_triples(loaded: DataFrame) -> DataFrame:
    """The rows of ``load_lines`` that were loaded, without the reason."""
    return loaded.where("reason is null").drop("reason")


def rejected(loaded: DataFrame, key: str = "line_id") -> DataFrame:
    """(key, reason) of the rows of ``load_lines`` that failed."""
    return loaded.where("reason is not null").select(key, "reason")

r"""Fields that pack several values: one row per value, with its position.

The field is read by a parsing expression grammar with ordered alternatives:

    Field   <- WS Listing WS END
    Listing <- Group &(WS END) / Items
    Group   <- '[' Items ']' / '{' Items '}'
    Items   <- Item (DELIM Item)*
    Item    <- WS (Quoted / Group / Bare) WS &(DELIM / CLOSE / END)
    Quoted  <- '"' ('""' / '\' any / [^"])* '"'    and the same for '…', “…” and «…»
    Bare    <- [^DELIM]*                           less a CLOSE that ends the enclosing group

An alternative that fails gives back what it read: a quote that is never closed, or is closed
before the value ends, is read again as a bare value and the value is flagged.

What an item at one place and under one enclosing bracket is, and where the items from there end, is settled once and kept
(packrat parsing), ends of quotes and bare values come from tables of the characters that can end them, and
nested groups wait on a list of their own instead of the call stack: a field takes time in proportion to its length
(times a logarithm), however malformed or deep it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import spread_input

# Delimiters, quotes, list brackets and words for "no value".
DELIMITERS = ",;/|\t\n\r，；｜／、"
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»"}
BRACKETS = {"[": "]", "{": "}"}
NULL_WORDS = frozenset({"", "nan", "na", "none", "null"})

BLANK = "\u200b\ufeff"
OK, BAD_QUOTE, BAD_BRACKET = "", "unbalanced_quote", "unbalanced_bracket"
_STRAY = "".join(QUOTES) + "".join(QUOTES.values()) + "".join(BRACKETS) + "".join(BRACKETS.values())
_DELIM = re.compile(f"[{re.escape(DELIMITERS)}]")
_EDGE = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + BLANK
_SPACE = re.compile(f"[{re.escape(''.join(set(_EDGE) - set(DELIMITERS)))}]*")
_PLAIN = re.compile(f"[^{re.escape(_STRAY)}]*")
_ESCAPE = re.compile(r"\\(.)", re.S)

Value = tuple[str, str]
Key = tuple[int, str]
QUOTED, GROUP, BARE = range(3)


def _strip(text: str) -> str:
    return text.strip(_EDGE)


class _Field:
    """One field with its tables; a key is a place and the bracket that closes the enclosing group ('' for none)."""

    def __init__(self, text: str) -> None:
        self.text, self.size = text, len(text)
        self.item: dict[Key, tuple[int, int, int]] = {}
        self.end: dict[Key, int] = {}
        self.after: dict[Key, Key | None] = {}
        self.quotes: dict[str, tuple[list[int], list[int]]] = {}
        self.stops: dict[str, list[int]] = {}

    def space(self, at: int) -> int:
        return _SPACE.match(self.text, at).end()  # type: ignore[union-attr]

    def ends(self, at: int, close: str) -> bool:
        """Lookahead: a delimiter, the close of the enclosing group or the end stands after white space."""
        at = self.space(at)
        return at == self.size or self.text[at] in DELIMITERS or (close != "" and self.text[at] == close)

    def quote_end(self, at: int, quote: str) -> int:
        """Where a quoted body that starts at a place is closed, past the closing quote; -1 if never.

        A doubled closing quote or a backslash goes on two characters later, if a close follows at all.
        """
        if quote not in self.quotes:
            close = QUOTES[quote]
            marks = [m.start() for m in re.finditer(f"[{re.escape(close)}\\\\]", self.text)]
            ends = [-1] * (len(marks) + 1)
            for k in range(len(marks) - 1, -1, -1):
                place = marks[k]
                doubled = self.text[place] == "\\" or self.text[place + 1 : place + 2] == close
                ends[k] = ends[bisect_left(marks, place + 2, k)] if doubled else -1
                if ends[k] < 0 and self.text[place] == close:
                    ends[k] = place + 1
            self.quotes[quote] = marks, ends
        marks, ends = self.quotes[quote]
        return ends[bisect_left(marks, at)]

    def bare_end(self, at: int, close: str) -> int:
        """The next delimiter, or close that a delimiter or the end follows; the end of the field if none."""
        if close not in self.stops:
            found = re.finditer(f"[{re.escape(DELIMITERS + close)}]", self.text)
            self.stops[close] = [m.start() for m in found if m[0] != close or self.ends(m.end(), "")]
        stops = self.stops[close]
        k = bisect_left(stops, at)
        return stops[k] if k < len(stops) else self.size

    def settle(self, root: Key) -> None:
        """Item and end of items for root and all keys it depends on."""
        waiting = [root]
        while waiting:
            key = waiting[-1]
            if key not in self.item:
                at = self.space(key[0])
                first, close = self.text[at : at + 1], key[1]
                found = None
                if first in QUOTES and first:
                    end = self.quote_end(at + 1, first)
                    if end >= 0 and self.ends(end, close):
                        found = QUOTED, at, end
                elif first in BRACKETS and first:
                    inside = at + 1, BRACKETS[first]
                    if inside not in self.end:
                        waiting.append(inside)
                        continue
                    end = self.end[inside]
                    if self.text[end : end + 1] == inside[1] and self.ends(end + 1, close):
                        found = GROUP, at, end + 1
                self.item[key] = found or (BARE, at, self.bare_end(at, close))
            at = self.space(self.item[key][2])
            following = (at + 1, key[1]) if at < self.size and self.text[at] in DELIMITERS else None
            if following and following not in self.end:
                waiting.append(following)
                continue
            self.end[key], self.after[key] = self.end[following] if following else at, following
            waiting.pop()

    def value(self, kind: int, start: int, end: int) -> Value:
        if kind == QUOTED:
            close = QUOTES[self.text[start]]
            body = self.text[start + 1 : end - 1].replace(close + close, close)
            return _strip(_ESCAPE.sub(r"\1", body)), OK
        raw = _strip(self.text[start:end])
        value = _strip(raw.strip(_STRAY))
        if value == raw:
            return value, OK
        edges = raw[: len(raw) - len(raw.lstrip(_STRAY))] + raw[len(raw.rstrip(_STRAY)) :]
        return value, BAD_BRACKET if any(c in "[]{}" for c in edges) else BAD_QUOTE

    def values(self, root: Key) -> Iterator[Value]:
        self.settle(root)
        due: list[Key | None] = [root]
        while due:
            key = due.pop()
            if key is not None:
                kind, start, end = self.item[key]
                due.append(self.after[key])
                if kind == GROUP:
                    due.append((start + 1, BRACKETS[self.text[start]]))
                else:
                    yield self.value(kind, start, end)


def parse_packed(text: str | None) -> list[Value]:
    """(value, error flag) of each value of a field; [] of null. Empty values and null words drop out."""
    if text is None:
        return []
    if _PLAIN.fullmatch(text):  # bare values only
        found: Iterator[Value] = ((_strip(part), OK) for part in _DELIM.split(text))
    else:
        found = _Field(text).values((0, ""))
    return [(v, f) for v, f in found if v.lower() not in NULL_WORDS]


def unpack_values(df: DataFrame, id_col: str, value_col: str, *, memo_size: int = 200_000) -> DataFrame:
    """(id, pos, value, error) with one row per value of value_col; pos counts from 1.

    Null or empty fields, and fields of null words only, give no row. Repeated rows give their
    values again, and a null id stays null. Very long fields are read whole. error is '' for a value
    that was read as written, else what was malformed. Only the two named columns are read.

    Fields repeat, so each distinct field of a batch is parsed once, and a bounded memo keeps fields
    between batches; it is emptied when full, which changes no result.
    """
    source = spread_input(df.select(F.col(id_col).alias("id"), F.col(value_col).cast("string").alias("packed")))
    id_type = source.schema["id"].dataType
    fields = f"id {id_type.simpleString()}, pos bigint, value string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[Value]] = {}
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            parsed = []
            for text in coded.dictionary.to_pylist():
                got = memo.get(text)
                if got is None:
                    if len(memo) >= memo_size:
                        memo.clear()
                    got = memo[text] = parse_packed(text)
                parsed.append(got)
            take, pos, value, error = [], [], [], []
            for row, code in enumerate(coded.indices.to_pylist()):
                if code is not None:
                    for n, (v, flag) in enumerate(parsed[code], 1):
                        take.append(row)
                        pos.append(n)
                        value.append(v)
                        error.append(flag)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(take, pa.int64())),
                    pa.array(pos, pa.int64()),
                    pa.array(value, pa.string()),
                    pa.array(error, pa.string()),
                ],
                names=["id", "pos", "value", "error"],
            )

    return source.mapInArrow(run, fields)

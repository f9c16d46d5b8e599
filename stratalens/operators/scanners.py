"""Exact token scanners of five formats, and the dispatch by mode.

Scanners never fail: what is malformed gives the tokens that the rules below give. They need no
row but their own, so they are one Arrow map without a shuffle. Rules:

* JSON: a string is a key when the innermost frame is an object that awaits one. The field of a value
  is the last key in an object, ``[]`` in any array and empty at the top. Numbers stand behind a colon,
  or behind an opening bracket or comma outside objects. Closers without an opener change nothing.
* CSV: commas part cells and line feeds part rows, outside quotes, which toggle.
* SQL: columns count commas within parentheses; each depth has its own count, which comes back behind
  the closing one. Strings are in single quotes with backslash escapes, and a doubled quote toggles twice.
* XML: a closing tag pops whatever is innermost, a slash in a tag closes it at once, all others are
  pushed as far as ``MOST_OPEN``; inside a tag any quote opens an attribute value.
* Generic: blanks end a token outside quotes; an opening quote begins one.

A number that the end of the text cuts off, without a byte behind it, is not a number yet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detect import integer_token, sniff

#: Open XML elements, and depths of SQL parentheses that are told apart.
MOST_OPEN, MOST_DEEP = 64, 32

JSON = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\[\]:,]|[^"{}\[\]:,\s]+', re.S)
CSV = re.compile(r'([^",\n]*(?:"[^"]*(?:"|\Z)[^",\n]*)*)(,|\n|\Z)')
SQL = re.compile(r"'(?:[^'\\]|\\.)*(?:'|\Z)|[(),]|[^'(),]+", re.S)
XML = re.compile(r"[^<]+|<")
IN_TAG = re.compile(r""""[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^"'/>]+|[/>]""")
GENERIC = re.compile(r'(?:"[^"]*(?:"|\Z)|[^ \t\r\n"])[^ \t\r\n"]*')

#: kind, field, depth, column, row, start (in characters), value, whether it may be a number
Token = tuple[str, str, int, int, int, int, str, bool]


def json_tokens(text: str) -> Iterator[Token]:
    frames: list[list] = []  # [is an object, last key, awaits a key]
    opened = False
    for m in JSON.finditer(text):
        t = m[0]
        top = frames[-1] if frames else None
        if t in "{[":
            frames.append([t == "{", "", t == "{"])
            opened = t == "["
        elif t in "}]":
            if frames:
                frames.pop()
            opened = False
        elif t in ":,":
            if top and top[0]:
                top[2], opened = t == ",", t == ":"
            else:
                opened = True
        elif t[0] == '"' and top and top[0] and top[2]:
            body = t[1:-1] if len(t) > 1 and t[-1] == '"' else t[1:]
            top[1], top[2] = re.sub(r"\\(.)", r"\1", body, flags=re.S), False
        else:
            field = "" if top is None else top[1] if top[0] else "[]"
            yield "string" if t[0] == '"' else "scalar", field, len(frames), 0, 0, m.start(), t, opened and t[0] != '"' and m.end() < len(text)
            opened = False


def csv_tokens(text: str) -> Iterator[Token]:
    row = col = 0
    ended = True  # nothing follows the last row's line feed
    for m in CSV.finditer(text):
        if m.end() == len(text) and not m[0] and ended:
            return
        yield "cell", str(col), 0, col, row, m.start(), m[1], m[2] != ""
        row, col = (row + 1, 0) if m[2] == "\n" else (row, col + 1)
        ended = m[2] != ","
        if not m[2]:
            return


def sql_tokens(text: str) -> Iterator[Token]:
    levels: list[list] = []  # [column, start, parts] of each open parenthesis
    row, depth = -1, 0
    for m in SQL.finditer(text):
        t = m[0]
        if t == "(":
            depth += 1
            row += depth == 1
            levels.append([0, m.end(), []])
        elif t in ",)" and levels:
            col, start, parts = levels[-1]
            whole = "".join(parts)
            value = whole.lstrip(" \t\r\n")
            yield "cell", f"{min(depth, MOST_DEEP)}:{col}", min(depth, MOST_DEEP), col, row, start + len(whole) - len(value), value, True
            if t == ",":
                levels[-1] = [col + 1, m.end(), []]
            else:
                levels.pop()
                depth -= 1
        elif levels and t not in ",)":
            levels[-1][2].append(t)


def xml_tokens(text: str) -> Iterator[Token]:
    stack: list[str] = []
    at, n = 0, len(text)
    while at < n:
        m = XML.match(text, at)
        if m[0] != "<":
            yield "text", stack[-1] if stack else "", len(stack), 0, 0, at, m[0], False
            at = m.end()
            continue
        closing = text.startswith("</", at)
        name = re.compile(r"[^\s/>]*").match(text, at + 1 + closing)
        start, at, alone, ended = at, name.end(), False, False
        while at < n and not ended:
            m = IN_TAG.match(text, at)
            if m[0][0] in "\"'":
                yield "attribute", name[0], len(stack), 0, 0, at, m[0], False
            alone |= m[0] == "/"
            ended = m[0] == ">"
            at = m.end()
        yield "close" if closing else "open", name[0], len(stack), 0, 0, start, text[start:at], False
        if closing:
            stack[-1:] = []
        elif not alone and len(stack) < MOST_OPEN:
            stack.append(name[0])


def generic_tokens(text: str) -> Iterator[Token]:
    for m in GENERIC.finditer(text):
        yield "word", "", 0, 0, 0, m.start(), m[0], False


SCANNERS: dict[str, Callable[[str], Iterator[Token]]] = {"json": json_tokens, "csv": csv_tokens, "sql": sql_tokens, "xml": xml_tokens, "generic": generic_tokens}
TOKENS = "key long, mode string, seq int, kind string, field string, depth int, col int, row_no int, start int, value string, numeric boolean"


def tokens(df: DataFrame, key: str, text: str, mode: Column | None = None) -> DataFrame:
    """The tokens of each text by the scanner of its mode (sniffed where not given), with ``number``:
    the tracked integer of a token that may be one. Null text has no token."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in TOKENS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 11, kinds, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for k, own, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for seq, token in enumerate(SCANNERS[own](t or "")):
                    rows.append((k, own, seq, *token))
                    if len(rows) >= 20_000:
                        yield made(rows)
                        rows = []
            yield made(rows)

    source = df.select(F.col(key).cast("long").alias("key"), (sniff(F.col(text)) if mode is None else mode).alias("mode"), F.col(text).cast("string"))
    out = source.mapInArrow(run, TOKENS)
    return out.withColumn("number", F.when(F.col("numeric"), integer_token(F.col("value")))).drop("numeric").withColumnRenamed("key", key)

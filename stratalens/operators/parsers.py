"""Structural tokenizers as built-in expressions: CSV by its exact rules, the others for well-formed input.

``scanners`` has the exact rules of every format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import integer_token
from . import scanners


def json_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field, value, number) of the fields of flat objects; the field is the key's name only."""
    rows = df.select(key, text, F.explode(F.json_object_keys(text)).alias("field"))
    value = F.expr(f"get_json_object(`{text}`, concat('$.', field))")
    return rows.select(key, "field", value.alias("value")).withColumn("number", integer_token(F.col("value")))


#: A record, and a cell, with what ends it. Quotes toggle; possessive, so that nothing is tried twice.
RECORD = r'[^"\n]*+(?:"[^"]*+(?:"|\z)[^"\n]*+)*+(?:\n|\z)'
CELL = r'[^",\n]*+(?:"[^"]*+(?:"|\z)[^",\n]*+)*+(?:,|\n|\z)'


def csv_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row_no, col, value, number) of CSV text: commas and line feeds inside quotes part nothing, cells
    keep their quotes, and a number that the end of the text cuts off is not one yet."""
    whole = F.regexp_extract_all(F.col(text), F.lit(RECORD), F.lit(0))
    records = df.select(key, F.posexplode(F.filter(whole, lambda x: x != "")).alias("row_no", "record"))
    found = F.regexp_extract_all("record", F.lit(CELL), F.lit(0))
    quotes = lambda c: F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))
    # the end of a record matches once more: an empty cell only behind a comma outside quotes
    before = F.get(found, F.size(found) - 2)
    more = before.endswith(",") & (quotes(before) % 2 == 0)
    cells = F.when((F.element_at(found, -1) == "") & ~F.coalesce(more, F.lit(False)), F.slice(found, 1, F.size(found) - 1)).otherwise(found)
    rows = records.select(key, "row_no", F.posexplode(cells).alias("col", "cell"))
    # a cell is ended by a comma or line feed that is not inside its quotes
    ended = F.col("cell").rlike(r"[,\n]\z") & (quotes(F.col("cell")) % 2 == 0)
    value = F.when(ended, F.expr("left(cell, length(cell) - 1)")).otherwise(F.col("cell"))
    return rows.select(key, "row_no", "col", value.alias("value"), F.when(ended, integer_token(value)).alias("number"))


def sql_cells(df: DataFrame, key: str, statement: str) -> DataFrame:
    """(key, row_no, col, value, number) of the tuples of INSERT statements: cells at depth 1, by the exact scanner."""
    cells = scanners.tokens(df, key, statement, F.lit("sql")).filter("depth = 1")
    return cells.select(key, "row_no", "col", "value", "number")


def tag_counts(df: DataFrame, text: str) -> DataFrame:
    """Opening, closing and other tags by name."""
    tags = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(</?[A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


def generic_tokens(df: DataFrame, text: str) -> DataFrame:
    """Lengths of tokens of plain text and how often they occur: blanks part tokens outside quotes, and an
    opening quote begins one."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r'(?:"[^"]*+(?:"|\z)|[^ \t\r\n"])[^ \t\r\n"]*+'), F.lit(0))).alias("w"))
    return words.groupBy(F.octet_length("w").cast("bigint").alias("n_bytes")).agg(F.count("*").alias("n"))

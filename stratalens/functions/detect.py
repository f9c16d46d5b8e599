"""Format detection: a scalar expression over the first 65,536 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sample size, blank signs, and the codes of the modes.
SAMPLE = 65536
BLANKS = " \t\n\f\r"
CODES = {"generic": 0, "json": 1, "csv": 2, "sql": 3, "xml": 4}


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def sniff(text: Column) -> Column:
    """The mode of a text; null counts as empty. The first rule that holds decides."""
    sample = F.coalesce(F.substring(text, 1, SAMPLE), F.lit(""))
    lines = _count(sample, "\n") + 1
    first = F.substring(F.ltrim(sample, F.lit(BLANKS)), 1, 1)
    has = lambda s: F.contains(sample, F.lit(s))
    return (
        F.when(first.isin("{", "[") & (_count(sample, "{") * 2 >= lines), "json")
        .when((first == "<") & (has("</") | has("<?xml") | has("/>")), "xml")
        .when(has("INSERT INTO") | has("CREATE TABLE"), "sql")
        .when(_count(sample, ",") >= lines, "csv")
        .otherwise("generic")
    )


def mode_code(mode: Column) -> Column:
    out = F.lit(0)
    for name, code in CODES.items():
        out = F.when(mode == name, F.lit(code)).otherwise(out)
    return out.cast("int")


def integer_token(text: Column) -> Column:
    """The tracked integer at the start of a token, or null: up to 18 digits, no fraction or exponent."""
    found = F.regexp_extract(text, r"^(-?[0-9]{1,18})([^0-9.eE]|$)", 1)
    return F.when(found != "", found.cast("bigint"))

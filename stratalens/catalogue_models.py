"""Queries of the match, field-context and mixing models, with DuckDB equivalents where SQL has them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import context, matches, parsers
from .sources import mixing


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLES: dict = {}


def _bytes(table: str, key: str) -> str:
    return f"SELECT {key}, unnest(l) AS byte, unnest(range(1, len(l) + 1)) AS p FROM (SELECT {key}, regexp_extract_all(hex(encode(text)), '..') AS l FROM {table})"


def _grams(table: str, key: str, k: int) -> str:
    return f"SELECT * FROM (SELECT {key}, p, {' || '.join(f'lag(byte, {i}) OVER w' for i in range(k - 1, 0, -1))} || byte AS gram FROM ({_bytes(table, key)}) WINDOW w AS (PARTITION BY {key} ORDER BY p)) WHERE p >= {k}"


for _k in (6, 16):
    QUERIES[f"match_previous_{_k}"] = lambda spark, sf_dir, k=_k: matches.previous(_t(spark, sf_dir, "documents"), "doc_id", "text", k)
    ORACLES[f"match_previous_{_k}"] = f"""SELECT doc_id, count(*) AS n_positions, count(d) AS n_found, CAST(coalesce(sum(d), 0) AS BIGINT) AS total_distance FROM (
    SELECT doc_id, p - lag(p) OVER (PARTITION BY doc_id, gram ORDER BY p) AS d FROM ({_grams('documents', 'doc_id', _k)})) GROUP BY doc_id"""


def match_candidates_6(spark, sf_dir):
    rows = matches.candidates(_t(spark, sf_dir, "benchmark"), "item_id", "text", 6)
    return rows.select("item_id", F.col("p").cast("bigint").alias("p"), F.size("found").cast("bigint").alias("n_found"), F.element_at("found", 1).cast("bigint").alias("oldest"), F.element_at("found", -1).cast("bigint").alias("newest"))


QUERIES["match_candidates_6"] = match_candidates_6
ORACLES["match_candidates_6"] = f"""SELECT item_id, p, CAST(len(f) AS BIGINT) AS n_found, f[1] AS oldest, f[-1] AS newest FROM (
    SELECT item_id, p, list(p) OVER (PARTITION BY item_id, gram ORDER BY p ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS f FROM ({_grams('benchmark', 'item_id', 6)})) WHERE len(f) > 0"""


for _k in (6, 16):
    QUERIES[f"match_rides_{_k}"] = lambda spark, sf_dir, k=_k: matches.rides(_t(spark, sf_dir, "documents"), "doc_id", "text", k)


for _k in (0, 1):
    QUERIES[f"adaptive_bit_cost_{_k}"] = lambda spark, sf_dir, k=_k: mixing.adaptive_cost(_t(spark, sf_dir, "benchmark"), "item_id", "text", k)
    ORACLES[f"adaptive_bit_cost_{_k}"] = f"""WITH b AS ({_bytes('benchmark', 'item_id')}),
    c AS (SELECT item_id, p, {"coalesce(lag(byte) OVER (PARTITION BY item_id ORDER BY p), '')" if _k else "''"} AS ctx, CAST('0x' || byte AS BIGINT) + 256 AS v FROM b),
    r AS (SELECT item_id, ctx, p, v >> (8 - i) AS node, (v >> (7 - i)) & 1 AS bit FROM c, (SELECT unnest(range(0, 8)) AS i)),
    f AS (SELECT item_id, count(*) AS n, list_reduce(list_prepend({{'p': 2048::BIGINT, 'cost': 0::BIGINT}}, list({{'p': bit::BIGINT, 'cost': 0::BIGINT}} ORDER BY p)),
        lambda a, x: {{'p': a.p + CAST(floor((x.p * 4096 - a.p) / 16.0) AS BIGINT), 'cost': a.cost + CAST(round(-log2((CASE WHEN x.p = 1 THEN greatest(1, least(4095, a.p)) ELSE 4096 - greatest(1, least(4095, a.p)) END) / 4096.0) * 65536) AS BIGINT)}}) AS s
        FROM r GROUP BY item_id, ctx, node)
    SELECT item_id, CAST(sum(n) AS BIGINT) AS n_bits, CAST(sum(s.cost) AS BIGINT) AS cost FROM f GROUP BY item_id"""


def mixed_code_length(spark, sf_dir):
    return mixing.mixed_lengths(_t(spark, sf_dir, "benchmark"), "item_id", "text")


QUERIES["mixed_code_length"] = mixed_code_length

_CSV = "concat_ws(',', CAST(o_orderkey AS {s}), CAST(o_custkey AS {s}), o_orderstatus, o_orderpriority)"
for _by, _second in (("position", "CAST(least(p - 1, 31) AS VARCHAR)"), ("previous", "CASE WHEN p > 1 THEN l[p - 1] ELSE '' END")):

    def _field(spark, sf_dir, by=_by):
        lines = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.expr(_CSV.format(s="STRING")), F.lit("\n")).alias("line"))
        return context.entropy(context.field_bytes(parsers.csv_cells(lines, "o_orderkey", "line"), "col", "value", by))

    QUERIES[f"field_{_by}_entropy"] = _field
    ORACLES[f"field_{_by}_entropy"] = f"""SELECT count(DISTINCT ctx) AS n_contexts, CAST(sum(c) AS BIGINT) AS n_bytes, round(sum(-c * log2(c / t)) / sum(c), 6) AS bits_per_byte FROM (
    SELECT ctx, byte, count(*) AS c, sum(count(*)) OVER (PARTITION BY ctx) AS t FROM (
    SELECT col || ':' || {_second} AS ctx, l[p] AS byte FROM (SELECT col, l, unnest(range(1, len(l) + 1)) AS p FROM (
    SELECT i - 1 AS col, regexp_extract_all(hex(encode(cells[i])), '..') AS l FROM (SELECT cells, unnest(range(1, len(cells) + 1)) AS i FROM
    (SELECT string_split({_CSV.format(s='VARCHAR')}, ',') AS cells FROM orders))))) GROUP BY ctx, byte)"""

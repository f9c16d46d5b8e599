"""All queries of the profiler by name, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalogue_formats, catalogue_models
from .functions.detect import integer_token, mode_code, sniff
from .operators import context, numeric, parsers
from .sources import blocks


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _duck_sniff(c: str) -> str:
    s = f"left({c}, 65536)"
    count = lambda sign: f"(length({s}) - length(replace({s}, '{sign}', '')))"
    first = f"left(ltrim({s}, ' ' || chr(9) || chr(10) || chr(12) || chr(13)), 1)"
    lines = f"(length({s}) - length(replace({s}, chr(10), '')) + 1)"
    return f"""CASE WHEN {first} IN ('{{', '[') AND {count("{")} * 2 >= {lines} THEN 'json'
      WHEN {first} = '<' AND (contains({s}, '</') OR contains({s}, '<?xml') OR contains({s}, '/>')) THEN 'xml'
      WHEN contains({s}, 'INSERT INTO') OR contains({s}, 'CREATE TABLE') THEN 'sql'
      WHEN {count(",")} >= {lines} THEN 'csv' ELSE 'generic' END"""


def _duck_int(c: str) -> str:
    return f"CAST(nullif(regexp_extract({c}, '^(-?[0-9]{{1,18}})([^0-9.eE]|$)', 1), '') AS BIGINT)"


@_query("format_sniff", f"SELECT page_id, {_duck_sniff('html')} AS mode FROM pages")
def format_sniff(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", sniff(F.col("html")).alias("mode"))


@_query(
    "format_counts",
    f"""SELECT kind, mode, CAST(CASE mode WHEN 'json' THEN 1 WHEN 'csv' THEN 2 WHEN 'sql' THEN 3 WHEN 'xml' THEN 4 ELSE 0 END AS INTEGER) AS code, count(*) AS n FROM (
    SELECT 'documents' AS kind, {_duck_sniff('text')} AS mode FROM documents UNION ALL SELECT 'pages', {_duck_sniff('html')} FROM pages
    UNION ALL SELECT 'props', {_duck_sniff('props')} FROM events) GROUP BY ALL""",
)
def format_counts(spark, sf_dir):
    part = lambda kind, table, c: _t(spark, sf_dir, table).select(F.lit(kind).alias("kind"), sniff(F.col(c)).alias("mode"))
    rows = part("documents", "documents", "text").unionByName(part("pages", "pages", "html")).unionByName(part("props", "events", "props"))
    return rows.groupBy("kind", "mode").agg(F.count("*").alias("n")).select("kind", "mode", mode_code(F.col("mode")).alias("code"), "n")


@_query("integer_tokens", f"SELECT o_orderkey, {_duck_int('o_orderpriority')} AS priority, {_duck_int('strftime(o_orderdate, $$%Y-%m-%d$$)')} AS year FROM orders")
def integer_tokens(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", integer_token(F.col("o_orderpriority")).alias("priority"), integer_token(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


@_query(
    "json_tokens",
    f"""SELECT field, count(*) AS n, CAST(count(num) AS BIGINT) AS n_numbers, CAST(sum(num) AS BIGINT) AS total FROM (
    SELECT field, {_duck_int("json_extract_string(props, '$.' || field)")} AS num FROM (SELECT props, unnest(json_keys(props)) AS field FROM events)) GROUP BY field""",
)
def json_tokens(spark, sf_dir):
    rows = parsers.json_tokens(_t(spark, sf_dir, "events"), "event_id", "props")
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count("number").alias("n_numbers"), F.sum("number").alias("total"))


_CSV = "concat_ws(',', CAST(o_orderkey AS {s}), CAST(o_custkey AS {s}), o_orderstatus, o_orderpriority)"


@_query(
    "csv_cells",
    f"""SELECT CAST(col AS INTEGER) AS col, count(*) AS n, CAST(count(num) AS BIGINT) AS n_numbers, CAST(sum(num) AS BIGINT) AS total FROM (
    SELECT i - 1 AS col, {_duck_int('cells[i]')} AS num FROM (SELECT cells, unnest(range(1, len(cells) + 1)) AS i FROM (SELECT string_split({_CSV.format(s='VARCHAR')}, ',') AS cells FROM orders))) GROUP BY ALL""",
)
def csv_cells(spark, sf_dir):
    lines = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.expr(_CSV.format(s="STRING")), F.lit("\n")).alias("line"))
    return parsers.csv_cells(lines, "o_orderkey", "line").groupBy("col").agg(F.count("*").alias("n"), F.count("number").alias("n_numbers"), F.sum("number").alias("total"))


_SQL = "concat('INSERT INTO orders VALUES (', CAST(o_orderkey AS {s}), ', ', CAST(o_custkey AS {s}), ', ''', o_orderstatus, ''');')"


@_query(
    "sql_tuple_cells",
    f"""SELECT CAST(col AS INTEGER) AS col, count(*) AS n, CAST(count(num) AS BIGINT) AS n_numbers, CAST(sum(num) AS BIGINT) AS total FROM (
    SELECT i - 1 AS col, {_duck_int('ltrim(cells[i])')} AS num FROM (SELECT cells, unnest(range(1, len(cells) + 1)) AS i FROM
    (SELECT string_split(regexp_extract({_SQL.format(s='VARCHAR')}, 'VALUES \\((.*)\\)', 1), ',') AS cells FROM orders))) GROUP BY ALL""",
)
def sql_tuple_cells(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("INSERT INTO orders VALUES ("), F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit(", '"), F.col("o_orderstatus"), F.lit("');")).alias("line"))
    return parsers.sql_cells(rows, "o_orderkey", "line").groupBy("col").agg(F.count("*").alias("n"), F.count("number").alias("n_numbers"), F.sum("number").alias("total"))


@_query("xml_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '(</?[A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def xml_tag_counts(spark, sf_dir):
    return parsers.tag_counts(_t(spark, sf_dir, "pages"), "html")


@_query(
    "generic_token_positions",
    """SELECT CAST(octet_length(encode(w)) AS BIGINT) AS n_bytes, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?:"[^"]*(?:"|$)|[^ \\t\\r\\n"])[^ \\t\\r\\n"]*')) AS w FROM documents) GROUP BY 1""",
)
def generic_token_positions(spark, sf_dir):
    return parsers.generic_tokens(_t(spark, sf_dir, "documents"), "text")


_PRED = """SELECT {f} AS field, {o} AS o, {v} AS v, lag({v}, 1) OVER w AS p1, lag({v}, 2) OVER w AS p2 FROM {t} WHERE {v} IS NOT NULL WINDOW w AS (PARTITION BY {f} ORDER BY {o})"""
_HIT = "CASE WHEN p1 IS NULL THEN NULL WHEN p2 IS NULL THEN v = p1 ELSE v = 2 * p1 - p2 END"
_FOLD = "CAST(list_reduce(list_prepend(0, list(CASE WHEN hit IS NULL THEN -1 WHEN hit THEN 1 ELSE 0 END ORDER BY o)), lambda a, h: CASE WHEN h = -1 THEN 0 WHEN h = 1 THEN least(a + 1, 255) ELSE a // 2 END) AS BIGINT)"


def _extrapolation_sql(f, o, v, t):
    return f"""SELECT field AS {f}, count(*) AS n_values, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n_hits, {_FOLD} AS final_hits
    FROM (SELECT *, {_HIT} AS hit FROM ({_PRED.format(f=f, o=o, v=v, t=t)})) GROUP BY field"""


@_query("numeric_extrapolation", _extrapolation_sql("event_type", "event_id", "event_id", "events"))
def numeric_extrapolation(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_type", "event_id", F.col("event_id").alias("v"))
    return numeric.extrapolation(rows, "event_type", "event_id", "v")


@_query("numeric_confidence", f"SELECT o_orderstatus, final_hits, CAST(2048 + floor(2047 * final_hits / (final_hits + 1)) AS BIGINT) AS p FROM ({_extrapolation_sql('o_orderstatus', 'o_orderkey', 'o_orderkey', 'orders')})")
def numeric_confidence(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.col("o_orderkey").alias("v"))
    out = numeric.extrapolation(rows, "o_orderstatus", "o_orderkey", "v")
    return out.select("o_orderstatus", "final_hits", numeric.confidence(F.col("final_hits")).alias("p"))


@_query(
    "numeric_digit_prefix",
    f"""SELECT o_orderstatus, o_orderkey, value, pred, CAST(len(list_filter(range(1, greatest(least(length(a), length(b)), 1) + 1), lambda i: left(a, i) = left(b, i))) AS BIGINT) AS digits_right FROM (
    SELECT field AS o_orderstatus, o AS o_orderkey, v AS value, CASE WHEN p2 IS NULL THEN p1 ELSE 2 * p1 - p2 END AS pred, CAST(v AS VARCHAR) AS a, CAST(CASE WHEN p2 IS NULL THEN p1 ELSE 2 * p1 - p2 END AS VARCHAR) AS b
    FROM ({_PRED.format(f='o_orderstatus', o='o_orderkey', v='o_custkey', t='orders')}) WHERE p1 IS NOT NULL)""",
)
def numeric_digit_prefix(spark, sf_dir):
    return numeric.digit_prefix(_t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", "o_custkey")


_PAIRS = "SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_suppkey = l_partkey THEN 1 ELSE 0 END) AS BIGINT) AS n_copies FROM lineitem GROUP BY l_returnflag"


@_query("cross_column_copy", _PAIRS)
def cross_column_copy(spark, sf_dir):
    same = F.when(F.col("l_suppkey") == F.col("l_partkey"), 1).otherwise(0)
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(same).cast("bigint").alias("n_copies"))


@_query("cross_column_offset", "SELECT d AS offset_value, count(*) AS n FROM (SELECT l_suppkey - l_partkey AS d FROM lineitem) GROUP BY d")
def cross_column_offset(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") - F.col("l_partkey")).alias("offset_value")).agg(F.count("*").alias("n"))


@_query("cross_column_fold")
def cross_column_fold(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return numeric.cross_column(_t(spark, sf_dir, "lineitem"), "l_returnflag", order, ["l_partkey", "l_suppkey", "l_linenumber"], 2)


@_query("hypothesis_choice", "SELECT h, x, seen, CASE WHEN x >= 2 AND (NOT seen OR x > h) THEN 'cross' WHEN seen THEN 'extrapolate' ELSE 'none' END AS chosen FROM (SELECT range AS h FROM range(0, 6)), (SELECT range AS x FROM range(0, 6)), (SELECT unnest([true, false]) AS seen)")
def hypothesis_choice(spark, sf_dir):
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")))
    rows = spark.range(0, 6).withColumnRenamed("id", "h").select("h", each.alias("x")).select("h", "x", F.explode(F.array(F.lit(True), F.lit(False))).alias("seen"))
    return rows.select("h", "x", "seen", numeric.choice(F.col("h"), F.col("x"), F.col("seen")).alias("chosen"))


def _entropy_sql(k: int) -> str:
    return f"""SELECT count(DISTINCT ctx) AS n_contexts, CAST(sum(c) AS BIGINT) AS n_bytes, round(sum(-c * log2(c / t)) / sum(c), 6) AS bits_per_byte FROM (
    SELECT ctx, byte, count(*) AS c, sum(count(*)) OVER (PARTITION BY ctx) AS t FROM (
    SELECT {' || '.join(f"lag(byte, {i}) OVER w" for i in range(k, 0, -1)) or "''"} AS ctx, byte, p FROM ({_BYTES}) WINDOW w AS (PARTITION BY doc_id ORDER BY p)) WHERE p > {k} GROUP BY ctx, byte)"""


_BYTES = "SELECT doc_id, unnest(l) AS byte, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents)"


for _k in range(5):
    _query(f"order{_k}_entropy", _entropy_sql(_k))(lambda spark, sf_dir, k=_k: context.entropy(context.byte_rows(_t(spark, sf_dir, "documents"), "text", k)))


def _repeat_sql(k: int) -> str:
    return f"""SELECT CAST(sum(c) AS BIGINT) AS n_grams, CAST(sum(c - 1) AS BIGINT) AS n_repeats FROM (SELECT count(*) AS c FROM (
    SELECT {' || '.join(f"lag(byte, {i}) OVER w" for i in range(k - 1, 0, -1))} || byte AS g, p FROM ({_BYTES}) WINDOW w AS (PARTITION BY doc_id ORDER BY p)) WHERE p >= {k} GROUP BY g)"""


for _k in (6, 16):
    _query(f"repeat_coverage_{_k}", _repeat_sql(_k))(lambda spark, sf_dir, k=_k: context.repeat_coverage(_t(spark, sf_dir, "documents"), "doc_id", "text", k))


@_query("stretch_table", "SELECT p, CAST(greatest(-2047, least(2047, round(256 * ln(p / (4096.0 - p))))) AS BIGINT) AS logit FROM (SELECT range AS p FROM range(1, 4096))")
def stretch_table(spark, sf_dir):
    p = F.col("id").cast("double")
    return spark.range(1, 4096).select(F.col("id").alias("p"), F.greatest(F.lit(-2047.0), F.least(F.lit(2047.0), F.round(256 * F.log(p / (4096 - p))))).cast("bigint").alias("logit"))


@_query("squash_table", "SELECT d, CAST(greatest(1, least(4095, round(4096 / (1 + exp(-d / 256.0))))) AS BIGINT) AS p FROM (SELECT range - 2047 AS d FROM range(0, 4095))")
def squash_table(spark, sf_dir):
    d = F.col("id") - 2047
    return spark.range(0, 4095).select(d.alias("d"), F.greatest(F.lit(1.0), F.least(F.lit(4095.0), F.round(4096 / (1 + F.exp(-d / 256.0))))).cast("bigint").alias("p"))


@_query("roundtrip_check", "SELECT page_id AS stream_id, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, true AS ok FROM pages")
def roundtrip_check(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("data"), sniff(F.col("html")).alias("mode"))
    back = blocks.streams_of(blocks.decompress_blocks(blocks.compress_blocks(rows, "page_id", "data")))
    own = rows.select(F.col("page_id").alias("stream_id"), F.sha2("data", 256).alias("own"))
    return back.join(own, "stream_id").select("stream_id", "n_bytes", (F.col("ok") & (F.col("sha256") == F.col("own"))).alias("ok"))


@_query("container_rejects", "SELECT * FROM (VALUES (1, 1, 'json', CAST(10 AS BIGINT), true), (2, 99, 'json', 10, false), (3, 1, 'other', 10, false), (4, 1, 'csv', 1048577, false), (5, 1, 'xml', -1, false), (6, 1, 'generic', 0, true)) v(id, version, mode, orig_len, accepted)")
def container_rejects(spark, sf_dir):
    rows = spark.createDataFrame([(1, 1, "json", 10), (2, 99, "json", 10), (3, 1, "other", 10), (4, 1, "csv", 1048577), (5, 1, "xml", -1), (6, 1, "generic", 0)], "id int, version int, mode string, orig_len long")
    return rows.withColumn("accepted", blocks.valid_header(F.col("version"), F.col("mode"), F.col("orig_len")))


catalogue_formats.register_dispatch(_duck_sniff)
QUERIES |= catalogue_models.QUERIES | catalogue_formats.QUERIES
ORACLES |= catalogue_models.ORACLES | catalogue_formats.ORACLES

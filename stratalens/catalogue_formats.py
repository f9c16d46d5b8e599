"""Queries of the exact scanners and of the block codecs, with DuckDB equivalents where SQL has them.

The texts are rendered from table columns, so the equivalents read the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions.detect import sniff
from .operators import parsers, scanners
from .sources import blocks


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(name: str):
    return F.col(name).cast("string")


QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@_query(
    "csv_quoted_cells",
    """SELECT doc_id, CAST(r AS INTEGER) AS row_no, CAST(c AS INTEGER) AS col, CAST(octet_length(encode(v)) AS BIGINT) AS n_bytes, num FROM (
    SELECT doc_id, 0 AS r, 0 AS c, CAST(doc_id AS VARCHAR) AS v, doc_id AS num FROM documents UNION ALL
    SELECT doc_id, 0, 1, '"' || replace(coalesce(text, ''), '"', '""') || '"', NULL FROM documents UNION ALL
    SELECT doc_id, 0, 2, '"a, b"', NULL FROM documents UNION ALL SELECT doc_id, 0, 3, '', NULL FROM documents UNION ALL
    SELECT doc_id, 1, 0, '"' || lang || '"', NULL FROM documents UNION ALL SELECT doc_id, 1, 1, CAST(-n_chars AS VARCHAR), -n_chars FROM documents UNION ALL
    SELECT doc_id, 1, 2, '', NULL FROM documents UNION ALL SELECT doc_id, 1, 3, '12', NULL FROM documents)""",
)
def csv_quoted_cells(spark, sf_dir):
    """Cells of two rows with whole texts in quotes: their commas and line feeds part nothing."""
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    both = F.concat(_text("doc_id"), F.lit(","), quoted, F.lit(',"a, b",\n"'), F.col("lang"), F.lit('",'), (-F.col("n_chars")).cast("string"), F.lit(",,12"))
    cells = parsers.csv_cells(_t(spark, sf_dir, "documents").select("doc_id", both.alias("csv")), "doc_id", "csv")
    return cells.select("doc_id", "row_no", "col", F.octet_length("value").cast("bigint").alias("n_bytes"), F.col("number").alias("num"))


@_query(
    "sql_nested_cells",
    """SELECT o_orderkey, CAST(r AS INTEGER) AS row_no, CAST(d AS INTEGER) AS depth, CAST(c AS INTEGER) AS col, v AS value, num AS number FROM (
    SELECT o_orderkey, 0 AS r, 1 AS d, 0 AS c, CAST(o_orderkey AS VARCHAR) AS v, o_orderkey AS num FROM orders UNION ALL
    SELECT o_orderkey, 0, 1, 1, '''it''''s, (' || o_orderpriority || ')''', NULL FROM orders UNION ALL
    SELECT o_orderkey, 0, 2, 0, CAST(o_custkey AS VARCHAR), o_custkey FROM orders UNION ALL SELECT o_orderkey, 0, 2, 1, '7', 7 FROM orders UNION ALL
    SELECT o_orderkey, 0, 1, 2, 'f', NULL FROM orders UNION ALL SELECT o_orderkey, 1, 1, 0, CAST(-o_custkey AS VARCHAR), -o_custkey FROM orders UNION ALL
    SELECT o_orderkey, 1, 1, 1, '''a' || chr(92) || ''', b''', NULL FROM orders)""",
)
def sql_nested_cells(spark, sf_dir):
    """Two tuples with doubled and escaped quotes, separators in strings and a nested call."""
    line = F.concat(F.lit("INSERT INTO t VALUES ("), _text("o_orderkey"), F.lit(", 'it''s, ("), F.col("o_orderpriority"), F.lit(")',f("), _text("o_custkey"), F.lit(", 7)),\n("), (-F.col("o_custkey")).cast("string"), F.lit(", 'a\\', b');"))
    rows = scanners.tokens(_t(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), "o_orderkey", "line", F.lit("sql"))
    return rows.select("o_orderkey", "row_no", "depth", "col", "value", "number")


@_query(
    "json_field_lookup",
    """SELECT event_id, field, CAST(depth AS INTEGER) AS depth, value, number FROM (
    SELECT event_id, 'user' AS field, 1 AS depth, CAST(user_id AS VARCHAR) AS value, user_id AS number FROM events UNION ALL
    SELECT event_id, '[]', 2, CAST(event_id AS VARCHAR), event_id FROM events UNION ALL SELECT event_id, '[]', 2, '-3', -3 FROM events UNION ALL
    SELECT event_id, '[]', 2, '"x,]"', NULL FROM events UNION ALL SELECT event_id, 'user', 3, CAST(user_id + 1 AS VARCHAR), user_id + 1 FROM events UNION ALL
    SELECT event_id, 'a"b', 2, '"' || event_type || '"', NULL FROM events UNION ALL SELECT event_id, 'n', 1, '1.5', NULL FROM events UNION ALL
    SELECT event_id, 'z', 1, 'null', NULL FROM events)""",
)
def json_field_lookup(spark, sf_dir):
    """Fields of nested objects and arrays: one key at two depths is one field, all arrays share one."""
    doc = F.concat(
        F.lit('{"user": '), _text("user_id"), F.lit(', "list": ['), _text("event_id"), F.lit(', -3, "x,]", {"user":'), (F.col("user_id") + 1).cast("string"),
        F.lit('}], "in": {"a\\"b" : "'), F.col("event_type"), F.lit('"}, "n":1.5, "z": null}'),
    )
    rows = scanners.tokens(_t(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "event_id", "doc")
    return rows.filter("mode = 'json'").select("event_id", "field", "depth", "value", "number")


@_query("row_reset", "SELECT o_orderkey, CAST(o_custkey - o_orderkey AS BIGINT) AS offset_value, CAST(r AS INTEGER) AS row_no FROM orders, (SELECT unnest([0, 1]) AS r)")
def row_reset(spark, sf_dir):
    """The offset of each integer cell to the one before it: rows begin anew, so none reaches across a line feed."""
    pair = F.concat(_text("o_orderkey"), F.lit(","), _text("o_custkey"), F.lit("\n"))
    cells = parsers.csv_cells(_t(spark, sf_dir, "orders").select("o_orderkey", F.concat(pair, pair).alias("csv")), "o_orderkey", "csv")
    before = F.lag("number").over(Window.partitionBy("o_orderkey", "row_no").orderBy("col"))
    return cells.select("o_orderkey", "row_no", (F.col("number") - before).alias("offset_value")).filter("offset_value is not null")


_UNQUOTED = """regexp_replace(text, '"[^"]*("|$)', '', 'g')"""


def register_dispatch(duck_sniff) -> None:
    @_query(
        "dispatch_tokens",
        f"""SELECT kind, mode, CAST(sum(n) AS BIGINT) AS n_tokens FROM (
        SELECT 'documents' AS kind, mode, CASE mode WHEN 'csv' THEN length(regexp_replace({_UNQUOTED}, '[^,\\n]', '', 'g')) + CASE WHEN {_UNQUOTED} LIKE '%' || chr(10) THEN 0 ELSE 1 END
          ELSE len(regexp_extract_all(text, '(?:"[^"]*(?:"|$)|[^ \\t\\r\\n"])[^ \\t\\r\\n"]*')) END AS n FROM (SELECT text, {duck_sniff('text')} AS mode FROM documents WHERE text <> '')
        UNION ALL SELECT 'props', {duck_sniff('props')}, len(json_keys(props)) FROM events) GROUP BY ALL""",
    )
    def dispatch_tokens(spark, sf_dir):
        """One scanner for each text, by its mode."""
        part = lambda kind, table, key, c: scanners.tokens(_t(spark, sf_dir, table), key, c).select(F.lit(kind).alias("kind"), "mode")
        rows = part("documents", "documents", "doc_id", "text").unionByName(part("props", "events", "event_id", "props"))
        return rows.groupBy("kind", "mode").agg(F.count("*").alias("n_tokens"))


@_query("xml_tag_states")
def xml_tag_states(spark, sf_dir):
    """Tokens of pages by kind, innermost tag and depth, from the tag stack."""
    rows = scanners.tokens(_t(spark, sf_dir, "pages"), "page_id", "html", F.lit("xml"))
    return rows.groupBy("kind", F.col("field").alias("tag"), "depth").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("n_bytes"))


#: Lines of a rendered stream, about, and tasks a core that streams are dealt to.
_STREAM, _TASKS = 8192, 16


def _rendered(spark, sf_dir):
    """(kind, part, data, mode, id): tables rendered as text of each format, some thousand rows to a stream."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o, e = _t(spark, sf_dir, "orders").filter("o_orderkey is not null"), _t(spark, sf_dir, "events").filter("event_id is not null")
    csv = F.concat_ws(",", _text("o_orderkey"), _text("o_custkey"), F.col("o_orderstatus"), day, F.col("o_orderpriority"))
    sql = F.concat(F.lit("INSERT INTO orders VALUES ("), _text("o_orderkey"), F.lit(", "), _text("o_custkey"), F.lit(", '"), F.col("o_orderstatus"), F.lit("', '"), day, F.lit("');"))
    ndjson = F.concat(F.lit('{"id":'), _text("event_id"), F.lit(',"ts":'), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").cast("string"), F.lit(',"user":'), _text("user_id"), F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    xml = F.concat(F.lit('<event id="'), _text("event_id"), F.lit('"><user>'), _text("user_id"), F.lit("</user><type>"), F.col("event_type"), F.lit("</type></event>"))
    lines = None
    for kind, rows, key, line in (("csv", o, "o_orderkey", csv), ("sql", o, "o_orderkey", sql), ("json", e, "event_id", ndjson), ("xml", e, "event_id", xml)):
        own = rows.select(F.lit(kind).alias("kind"), F.floor(F.col(key) / _STREAM).cast("bigint").alias("part"), F.col(key).cast("bigint").alias("o"), line.alias("line"))
        lines = own if lines is None else lines.unionByName(own)
    # a stream has as many lines as its range of keys; many small tasks, since their texts take long to pack
    dealt = lines.repartition(_TASKS * spark.sparkContext.defaultParallelism, "kind", "part")
    made = dealt.groupBy("kind", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return made.select("kind", "part", F.encode("t", "utf-8").alias("data"), sniff(F.col("t")).alias("mode"), F.xxhash64("kind", "part").alias("id"))


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_LINES = {
    "csv": ("orders", "o_orderkey", f"concat_ws(',', o_orderkey, o_custkey, o_orderstatus, {_DAY}, o_orderpriority)"),
    "sql": ("orders", "o_orderkey", f"'INSERT INTO orders VALUES (' || o_orderkey || ', ' || o_custkey || ', ''' || o_orderstatus || ''', ''' || {_DAY} || ''');'"),
    "json": ("events", "event_id", """'{"id":' || event_id || ',"ts":' || CAST(epoch_ms(ts) AS VARCHAR) || ',"user":' || user_id || ',"type":"' || event_type || '"}'"""),
    "xml": ("events", "event_id", """'<event id="' || event_id || '"><user>' || user_id || '</user><type>' || event_type || '</type></event>'"""),
}
_STREAMS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {o} // {_STREAM} AS part, sum(octet_length(encode({line})) + 1) - 1 AS n FROM {t} GROUP BY 2" for k, (t, o, line) in _LINES.items())


@_query("structured_roundtrip", f"SELECT kind, CAST(part AS BIGINT) AS part, CAST(n AS BIGINT) AS n_bytes, kind AS mode, true AS ok, true AS no_larger FROM ({_STREAMS})")
def structured_roundtrip(spark, sf_dir):
    """Every stream comes back, and is at most a byte a block larger than LZMA at its strongest makes it, in the same run."""
    rows = _rendered(spark, sf_dir).withColumn("own", F.sha2("data", 256))
    made = blocks.compress_blocks(rows, "id", "data", carry=["kind", "part", "own"], plain=True).withColumn("packed", F.octet_length("payload"))
    kept = ["kind", "part", "mode", "own"]
    back = blocks.decompress_blocks(made, [*kept, "packed", "plain"])
    sums = [F.sum("packed").alias("packed"), F.sum("plain").alias("plain"), F.count("*").alias("n_blocks")]
    out = blocks.streams_of(back, *(F.first(c).alias(c) for c in kept), *sums)
    return out.select("kind", "part", "n_bytes", "mode", (F.col("ok") & (F.col("sha256") == F.col("own"))).alias("ok"), (F.col("packed") <= F.col("plain") + F.col("n_blocks")).alias("no_larger"))


@_query("compression_ratio", f"SELECT kind, CAST(sum(n) AS BIGINT) AS orig_bytes, count(*) AS n_streams, true AS beats_lzma FROM ({_STREAMS}) GROUP BY kind")
def compression_ratio(spark, sf_dir):
    """By format: bytes, streams, and whether columns beat LZMA at its strongest; ``ratios`` has the figures."""
    return ratios(spark, sf_dir).select("kind", "orig_bytes", "n_streams", (F.col("ratio") > F.col("lzma_ratio")).alias("beats_lzma"))


def ratios(spark, sf_dir):
    """(kind, orig_bytes, n_streams, ratio, lzma_ratio): sizes vary by library version, so they are no query."""
    made = blocks.compress_blocks(_rendered(spark, sf_dir), "id", "data", carry=["kind"], plain=True)
    streams = made.select("kind", "stream_id", "orig_len", F.octet_length("payload").alias("packed"), "plain").groupBy("kind", "stream_id").agg(*(F.sum(c).alias(c) for c in ("orig_len", "packed", "plain")))
    both = streams.groupBy("kind").agg(F.sum("orig_len").alias("orig_bytes"), F.count("*").alias("n_streams"), F.sum("packed").alias("packed"), F.sum("plain").alias("plain"))
    return both.select("kind", "orig_bytes", "n_streams", F.round(F.col("orig_bytes") / F.col("packed"), 4).alias("ratio"), F.round(F.col("orig_bytes") / F.col("plain"), 4).alias("lzma_ratio"))

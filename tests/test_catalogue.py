import os

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalens import catalogue
from stratalens.functions.detect import integer_token, sniff
from stratalens.sources import blocks

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(map(str, r)) for r in duck.sql(f"SELECT {','.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall())
    assert got == want


def test_detection_edges(spark):
    cases = [("", "generic"), (None, "generic"), ("[1,2,3]", "csv"), ('{"a":1}', "json"), ("a,b\n1,2\n", "generic"), ("a,b\n1,2", "csv"), ("<a/>", "xml"), ("x INSERT INTO y", "sql"), ("insert into", "generic"), ("\f[{}", "json")]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", sniff(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows] == [m for _, m in cases]


def test_integer_tokens(spark):
    cases = [("12abc", 12), ("2024-01-05", 2024), ("1.5", None), ("5e3", None), ("007", 7), ("-", None), ("-7", -7), ("9" * 18, int("9" * 18)), ("9" * 19, None), ("", None), (" 1", None), ("10:30", 10)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", integer_token(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [n for _, n in cases]


def test_blocks_detect_damage(spark):
    rows = spark.createDataFrame([(1, bytearray(b"abc" * 5000), "generic"), (2, bytearray(b""), "csv"), (3, None, "json")], "id long, data binary, mode string")
    made = blocks.compress_blocks(rows, "id", "data", 4096)
    assert made.filter("stream_id = 1").count() == 4
    assert all(r.ok for r in blocks.decompress_blocks(made).collect())
    hurt = made.withColumn("payload", F.concat(F.lit(b"\x00"), F.expr("substring(payload, 2)")))
    assert not any(r.ok for r in blocks.decompress_blocks(hurt.filter("orig_len > 0")).collect())

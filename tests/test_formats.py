"""Exact scanners, the block codecs, the engine, distributed folds and the stream, on the cases that break them."""

import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens import catalogue_formats
from stratalens.engine import Engine
from stratalens.operators import context, numeric, parsers, scanners
from stratalens.sources import blocks, structure
from stratalens.streaming import numeric as streaming

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue_formats.ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = catalogue_formats.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(map(str, r)) for r in duck.sql(f"SELECT {','.join(cols)} FROM ({catalogue_formats.ORACLES[name]})").fetchall())
    assert got == want and got


CSV = [
    "", "a", "a,b", "a,b\n", ",", "\n", "a,\n,b", 'x,"1,2",""\n', '"a ""quoted"" cell",2\n"line\nfeed",3', '"open, never\nclosed', '12,"12",1.5,12', '7,\n8', 'a"b,c"d,e', "a,b\r\n1,2\r\n", '"";', ",,\n\n", '1,"x"\n',
]


def csv_by_hand(text):
    """(row, column, value, number) sign by sign."""
    out, row, col, cell, quoted = [], 0, 0, "", False
    number = lambda v, ended: int(m) if ended and (m := leading(v)) else None
    for c in text:
        if c == '"':
            quoted = not quoted
        if c in ",\n" and not quoted:
            out.append((row, col, cell, number(cell, True)))
            row, col, cell = (row + 1, 0, "") if c == "\n" else (row, col + 1, "")
        else:
            cell += c
    if cell or col:
        out.append((row, col, cell, None))
    return out


def leading(v):
    digits = v[1:] if v[:1] == "-" else v
    n = len(list(itertools.takewhile(lambda c: c in "0123456789", digits)))
    return v[: len(v) - len(digits) + n] if 1 <= n <= 18 and digits[n : n + 1] not in tuple(".eE") else None


def test_csv_cells(spark):
    rng = random.Random(3)
    texts = CSV + ["".join(rng.choice('ab1-,,\n""') for _ in range(rng.randrange(30))) for _ in range(300)] + ['"x",' * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in parsers.csv_cells(df, "id", "t").collect():
        got.setdefault(r.id, []).append((r.row_no, r.col, r.value, r.number))
    exact = {}
    for r in scanners.tokens(df, "id", "t", F.lit("csv")).orderBy("id", "seq").collect():
        exact.setdefault(r.id, []).append((r.row_no, r.col, r.value, r.number))
    for i, t in enumerate(texts):
        want = csv_by_hand(t)
        assert sorted(got.get(i, [])) == sorted(want), t[:80]
        assert exact.get(i, []) == want, t[:80]


def values(mode, text):
    return [(kind, field, depth, value, number) for kind, field, depth, _, _, _, value, number in scanners.SCANNERS[mode](text)]


def test_json_rules():
    assert values("json", '{"a": 1, "b": [2, "x", {"a": -3}], "c": {"d\\"e": "y"}}') == [
        ("scalar", "a", 1, "1", True), ("scalar", "[]", 2, "2", True), ("string", "[]", 2, '"x"', False), ("scalar", "a", 3, "-3", True), ("string", 'd"e', 2, '"y"', False),
    ]
    assert values("json", "5") == [("scalar", "", 0, "5", False)]
    assert values("json", ",5 ") == [("scalar", "", 0, "5", True)] and values("json", ",5")[0][4] is False
    assert values("json", '}}]{"k":1}') == [("scalar", "k", 1, "1", True)]
    for broken in ('{"a": {"b": [1, 2', '"\\', '{"a" "b"}', "\x00\x01\xff{[", '{"x": "never', "{]}["):
        assert isinstance(values("json", broken), list)


def test_sql_rules():
    cells = [(row, depth, col, value) for _, _, depth, col, row, _, value, _ in scanners.sql_tokens("CREATE TABLE t (id int, n varchar(64));\nINSERT INTO t VALUES (1, 'a, (b'),(2,f(3, 4), 'it''s'), (5, 'x\\', y')")]
    assert cells == [
        (0, 1, 0, "id int"), (0, 2, 0, "64"), (0, 1, 1, "n varchar"), (1, 1, 0, "1"), (1, 1, 1, "'a, (b'"), (2, 1, 0, "2"), (2, 2, 0, "3"), (2, 2, 1, "4"), (2, 1, 1, "f"), (2, 1, 2, "'it''s'"), (3, 1, 0, "5"), (3, 1, 1, "'x\\', y'"),
    ]
    assert list(scanners.sql_tokens("-- don't (1, 2)")) == [] and list(scanners.sql_tokens("))) , (")) == []
    assert max(t[2] for t in scanners.sql_tokens("(" * 40 + "1,2" + ")" * 40)) == scanners.MOST_DEEP


def test_xml_rules():
    got = [(k, f, d, v) for k, f, d, _, _, _, v, _ in scanners.xml_tokens('<?xml v="1"?><a><b id="x>y">t</b><c/>u</a>')]
    assert got == [
        ("attribute", "?xml", 0, '"1"'), ("open", "?xml", 0, '<?xml v="1"?>'), ("open", "a", 1, "<a>"), ("attribute", "b", 2, '"x>y"'), ("open", "b", 2, '<b id="x>y">'), ("text", "b", 3, "t"),
        ("close", "b", 3, "</b>"), ("open", "c", 2, "<c/>"), ("text", "a", 2, "u"), ("close", "a", 2, "</a>"),
    ]
    assert [t[0] for t in scanners.xml_tokens("<!-- don't --> swallowed")] == ["attribute", "open"]
    deep = list(scanners.xml_tokens("<x>" * 70 + "t" + "</x>" * 80 + "u"))
    assert max(t[2] for t in deep) == scanners.MOST_OPEN and deep[-1][2] == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='ab1 ,\n"\'{}[]:<>/\\()-', max_size=80))
def test_scanners_never_fail(text):
    for scan in scanners.SCANNERS.values():
        for token in scan(text):
            assert token[6] in text


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(["csv", "json", "sql", "xml", "generic"]))
def test_structure_round_trip(data, mode):
    assert structure.decode(structure.encode(data, mode), len(data)) == data


def test_structure_round_trip_of_numbers():
    rng = random.Random(9)
    odd = ["007", "-0", "-7", "0", "9" * 18, "-" + "9" * 18, "9" * 19, "", "1.5", " 3", "1e5"]
    for make in (lambda i: f"{i},{2 * i},{1700000000 + 60 * i},{i % 7}", lambda i: f"{i},{i + 500},{i},{rng.randrange(97)}", lambda i: ",".join(rng.choice(odd) for _ in range(4))):
        data = "\n".join(make(i) for i in range(3000)).encode()
        packed = structure.encode(data, "csv")
        assert structure.decode(packed, len(data)) == data and len(packed) <= len(structure.pack(data)) + 1
    steady = "\n".join(f'{{"id":{1000 + i},"ts":{1700000000 + i},"v":"x"}}' for i in range(5000)).encode()
    assert len(structure.encode(steady, "json")) * 8 < len(structure.pack(steady))


def test_blocks_of_every_back_end(spark):
    text = "\n".join(f"{i},{i * i % 91},tag{i % 5}" for i in range(4000)).encode()
    rows = spark.createDataFrame([(1, bytearray(text), "csv"), (2, bytearray(b""), "generic"), (3, None, "json")], "id long, data binary, mode string")
    for back_end in ("structure", "lzma"):
        made = blocks.compress_blocks(rows, "id", "data", 8192, back_end)
        assert made.filter("stream_id = 1").count() > 3
        back = {r.stream_id: r for r in blocks.streams_of(blocks.decompress_blocks(made)).collect()}
        assert all(r.ok for r in back.values()) and back[1].n_bytes == len(text) and back[2].n_bytes == 0
        for damage in ("substring(payload, 1, length(payload) - 3)", "concat(substring(payload, 1, 30), x'5a5a', substring(payload, 33))", "x''", "concat(x'43ffffffff', payload)"):
            hurt = made.filter("orig_len > 0").withColumn("payload", F.expr(damage))
            assert not any(r.ok for r in blocks.decompress_blocks(hurt).collect())
        assert not any(r.ok for r in blocks.decompress_blocks(made.withColumn("back_end", F.lit("other"))).collect())
    small = rows.filter("id = 1").withColumn("data", F.substring("data", 1, 600))
    assert all(r.ok for r in blocks.decompress_blocks(blocks.compress_blocks(small, "id", "data", 300, "mix")).collect())


def test_engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = {"a.csv": b"x,y\n" + b"\n".join(b"%d,%d" % (i, i * 3) for i in range(5000)), "b.bin": bytes(range(256)) * 200}
    (tmp_path / "in").joinpath("c").touch()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    engine = Engine(spark, block_bytes=16384)
    made = engine.compress(f"{tmp_path}/in", f"{tmp_path}/packed.blocks")
    assert made.filter("path like '%a.csv'").first().mode == "csv"
    back = {r.path.rsplit("/", 1)[-1]: bytes(r.data) for r in engine.decompress(f"{tmp_path}/packed.blocks").collect()}
    assert back == files
    with pytest.raises(Exception, match="already exists"):
        engine.compress(f"{tmp_path}/in", f"{tmp_path}/packed.blocks")
    report = engine.bench(f"{tmp_path}/in", 20_000)
    assert report["ok"] and report["bytes"] == 40_000 and report["structure_ratio"] >= report["lzma_ratio"] * 0.99


def fold_by_hand(values):
    last = delta = None
    hits = n_hits = 0
    for v in values:
        if last is None:
            delta = 0
        else:
            hit = last + delta == v
            hits, n_hits, delta = min(hits + 1, 255) if hit else hits // 2, n_hits + hit, v - last
        last = v
    return len(values), n_hits, hits


def histories(rng):
    made = {"steady": list(range(1000)), "constant": [5] * 40, "one": [7], "broken": [*range(50), 9, *range(60, 90)], None: [1, 1, 2, 3, 4]}
    for k in range(6):
        v, out = 0, []
        for _ in range(rng.randrange(1, 400)):
            v += rng.choice([1, 1, 1, 1, k])
            out.append(v)
        made[f"f{k}"] = out
    return made


@pytest.mark.parametrize("parts", [1, 8])
def test_extrapolation_over_stretches(spark, parts):
    made = histories(random.Random(parts))
    rows = [(f, i, v) for f, own in made.items() for i, v in enumerate(own)] + [("steady", 5000, None), ("empty", 1, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "f string, o long, v long").repartition(parts)
    got = {r.f: tuple(r)[1:] for r in numeric.extrapolation(df, "f", "o", "v").collect()}
    assert got == {f: fold_by_hand(own) for f, own in made.items()}
    with pytest.raises(Exception, match="equal order keys"):
        numeric.extrapolation(df.unionByName(df.filter("f = 'broken' and o = 7")), "f", "o", "v").collect()


def test_extrapolation_of_a_stream(spark, tmp_path):
    made = {f: v for f, v in histories(random.Random(4)).items() if f}
    for k in range(3):
        rows = [(f, i, v) for f, own in made.items() for i, v in enumerate(own) if k * len(own) // 3 <= i < (k + 1) * len(own) // 3]
        spark.createDataFrame(rows, "f string, o long, v long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("f string, o long, v long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming.extrapolation(source, "f", "o", "v").writeStream.format("memory").queryName("folds").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination(120)
    got = {}
    for r in spark.table("folds").orderBy("n_values").collect():
        got[r.field] = (r.n_values, r.n_hits, r.final_hits)
    assert got == {f: fold_by_hand(v) for f, v in made.items()}


@pytest.mark.parametrize("k", [1, 5, 8, 9, 16])
def test_gram_counts(spark, monkeypatch, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", "a" * 500, "ab" * 300]
    monkeypatch.setattr(context, "COUNTED", 64)
    want = {}
    for t in texts:
        raw = (t or "").encode()
        for i in range(len(raw) - k + 1):
            want[raw[i : i + k]] = want.get(raw[i : i + k], 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    word = lambda x, n: int(np.int64(x).view(np.uint64)).to_bytes(8, "big")[8 - n :] if n else b""
    got = {word(r.high, max(0, k - 8)) + word(r.low, min(k, 8)): r.c for r in context.gram_counts(df, "t", k).collect()}
    assert got == want


def test_streams_are_packed_once(spark, monkeypatch):
    """LZMA over whole blocks is most of the work: both queries run it once a block, in one pass without a join."""
    for name in ("structured_roundtrip", "compression_ratio"):
        plan = catalogue_formats.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 0 and plan.count("MapInArrow") == (2 if name == "structured_roundtrip" else 1)
    block = b"\n".join(b"%d,%d,x" % (i, i * 7) for i in range(500))
    runs = []
    monkeypatch.setattr(structure, "pack", lambda data, real=structure.pack: runs.append(data) or real(data))
    payload, plain = structure.encode_sized(block, "csv")
    assert runs.count(block) == 1 and plain == len(structure.pack(block))
    assert payload == structure.encode(block, "csv") and structure.decode(payload, len(block)) == block
    assert blocks.sized("lzma", block, "csv") == (structure.pack(block), plain) and blocks.sized("structure", block, "csv") == (payload, plain)


def test_carried_columns_stay_with_blocks(spark):
    lines = [b"\n".join(b"%d,%d" % (i, i * k) for i in range(900)) for k in (1, 2)]
    rows = spark.createDataFrame([(i, bytearray(x), "csv", f"own {i}") for i, x in enumerate(lines)], "id long, data binary, mode string, note string")
    made = blocks.compress_blocks(rows, "id", "data", block_bytes=2048, carry=["note"], plain=True)
    assert made.count() > 4 and made.filter("plain is null or note <> concat('own ', stream_id)").isEmpty()
    back = blocks.decompress_blocks(made, ["note", "plain"])
    out = blocks.streams_of(back, F.first("note").alias("note"), F.sum("plain").alias("plain")).collect()
    assert {(r.stream_id, r.note, r.ok, r.n_bytes) for r in out} == {(i, f"own {i}", True, len(x)) for i, x in enumerate(lines)}

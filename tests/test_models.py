import os
import random

import duckdb
import pytest

from stratalens import catalogue_models
from stratalens.operators import context, matches, numeric
from stratalens.sources import fields, mixing

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue_models.ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = catalogue_models.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(map(str, r)) for r in duck.sql(f"SELECT {','.join(cols)} FROM ({catalogue_models.ORACLES[name]})").fetchall())
    assert got == want


def plain_rides(data: bytes, k: int) -> list[tuple[int, int, int, int]]:
    """Looks at every earlier position instead of an index."""
    out, source = [], None
    for n in range(1, len(data) + 1):
        if source is not None and data[source] == data[n - 1]:
            source += 1
            out[-1][3] += 1
        else:
            source = None
        if source is None and n >= k:
            same = [c for c in range(k, n) if data[c - k : c] == data[n - k : n]][-8:]
            if same:
                back = {c: next((i for i in range(64) if i == c or data[c - 1 - i] != data[n - 1 - i]), 64) for c in same}
                source = max(same, key=lambda c: (back[c], c))
                out.append([n, source, back[source], 0])
    return [tuple(x) for x in out]


STREAMS = [b"", b"a", b"abcabcabcabcX" * 9, b"\xff" * 70, bytes(range(256)) * 2, ("el niño come pan, " * 7 + "el niño come uvas").encode(), b'{"id":1,"ts":5}\n{"id":2,"ts":6}\n' * 6]


@pytest.mark.parametrize("k", [1, 6, 16])
@pytest.mark.parametrize("data", STREAMS)
def test_rides(data, k):
    assert matches.rides_of(data, k) == plain_rides(data, k)


@pytest.mark.parametrize("data", [*STREAMS, b"\x00" * 3000, bytes((i * i * 7919 >> 3) & 255 for i in range(1500))])
def test_mixing_round_trip(data):
    packed = mixing.encode(data)
    assert mixing.decode(packed, len(data)) == data
    assert abs(8 * len(packed) - mixing.code_length(data) / mixing.ONE) < 64 + 0.01 * 8 * len(data)


LINES = {
    "json": b"\n".join(b'{"id": %d, "ts":%d, "tags":[%d, "a\\"b"], "in":{"id":%d}}' % (1000 + i, 1700000000 + 60 * i, i, i % 3) for i in range(60)),
    "csv": b"\n".join(b'%d,%d,%d,"x, ""%d""",%d' % (i * 7919 % 1000, i * 7919 % 1000 + 500, i * 7919 % 1000, i % 4, i) for i in range(90)),
    "sql": b"INSERT INTO t VALUES " + b", ".join(b"(%d, %d, 'it''s %d', f(%d, 7))" % (1000 + i, 1700000000 + i, i % 9, i) for i in range(70)),
    "xml": b"<c>" + b"".join(b"<item id='%d'><price>%d</price><e/></item>" % (i, 3 * i) for i in range(60)) + b"</c>",
    "generic": b'word "two words" 12 13 14 ' * 40,
}


@pytest.mark.parametrize("mode", LINES)
def test_mixing_by_mode(mode):
    data = LINES[mode]
    packed = mixing.encode(data, mode)
    assert mixing.decode(packed, len(data), mode) == data
    if mode in ("json", "csv", "sql"):  # fields and their numbers say more than bytes alone
        assert mixing.code_length(data, mode) < 0.9 * mixing.code_length(data, "generic")
    for broken in (b'{"a": [1, {"b" "c\\', b"}}]],1", b'"open, never', b")))((1,", b"<<a b='>", bytes(range(256))):
        assert mixing.decode(mixing.encode(broken, mode), len(broken), mode) == broken


def test_numbers_of_fields():
    csv = fields.Csv()
    for i in range(20):
        for c in b"%d,%d,%d,x\n" % (i * 37 % 101, i * 37 % 101 + 500, i * 37 % 101):
            csv.push(c)
    assert csv.numbers.across[1][:2] == [0, 500] and csv.numbers.across[2][:2] == [0, 0] and 3 not in csv.numbers.across and not csv.numbers.row
    for c in b"77,5":
        csv.push(c)
    assert csv.digit() == ord("7")  # 577 is expected
    json = fields.Json()
    for i in range(5):
        for c in b'{"x": %d, "y":%d}\n' % (i - 1000, 9 * 10**18 - i):
            json.push(c)
    assert json.numbers.known == {b"x": [-996, 1, 3]}


def test_streams_of_rows(spark):
    rows = spark.createDataFrame([(1, "abcdefgh abcdefgh"), (2, None), (3, "")], "id long, text string")
    assert {r.id for r in matches.rides(rows, "id", "text", 6).collect()} == {1}
    made = {r.id: r for r in mixing.mixed_lengths(rows, "id", "text").collect()}
    assert len(made) == 3 and all(r.ok for r in made.values())


@pytest.mark.parametrize("k", [1, 6, 8, 16, 40])
def test_distances_back_need_no_shuffle_of_positions(spark, k):
    texts = ["", "a", "abcabcabcabcX" * 9, "el niño come pan, " * 7 + "el niño come uvas", "ab" * 50]
    rows = spark.createDataFrame([*enumerate(texts), (5, None)], "id long, text string")
    made = matches.previous(rows, "id", "text", k)
    plan = made._jdf.queryExecution().toString()
    assert "Window" not in plan and "Generate" not in plan
    assert sorted(map(tuple, made.collect())) == sorted((i, *wanted) for i, t in enumerate(texts) if (wanted := plain_distances([t], k))[0])


def test_distances_back_of_rows_with_one_key(spark):
    data = [(1, "abcdefgh abcdefgh"), (1, "xabcdefgh"), (None, "aaaaaaaaa"), (None, "baaaaaaa"), (2, "abcabcabcabc"), (3, None)]
    made = matches.previous(spark.createDataFrame(data, "id long, text string"), "id", "text", 6).collect()
    assert {tuple(r) for r in made} == {(i, *plain_distances([t for j, t in data if j == i], 6)) for i in (1, None, 2)}


def plain_distances(texts: list[str], k: int) -> tuple[int, int, int]:
    at: dict[bytes, list[int]] = {}
    for raw in (t.encode() for t in texts):
        for p in range(k, len(raw) + 1):
            at.setdefault(raw[p - k : p], []).append(p)
    far = [b - a for p in map(sorted, at.values()) for a, b in zip(p, p[1:], strict=False)]
    return sum(map(len, at.values())), len(far), sum(far)


@pytest.mark.parametrize("k", [1, 2, 6, 9, 16])
def test_repeats_of_pieces(spark, monkeypatch, k):
    texts = ["", "a", "abcabcabcabcX" * 9, "el niño come pan, " * 7 + "el niño come uvas", "ab" * 300, "€" * 40, "".join(chr(32 + i * i * 7919 % 95) for i in range(2000))]
    grams = [t.encode()[i : i + k] for t in texts for i in range(len(t.encode()) - k + 1)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    assert tuple(context.repeat_coverage(rows, "text", "text", k).first()) == (len(grams), len(grams) - len(set(grams)))
    # few buckets, those dealt again and hashes that are equal change nothing
    monkeypatch.setattr(context, "SORTED", 97)
    monkeypatch.setattr(context, "BUCKETS", 3)
    for mixed in (context._mixed, lambda high, low: low & 15):
        monkeypatch.setattr(context, "_mixed", mixed)
        n, made = context._packed([t.encode() for t in texts], k)
        assert n == len(grams)
        held: dict[int, list] = {}
        for bucket, size, packed in made + made:
            held.setdefault(bucket, []).append((size, packed))
        assert sum(context._different(x, k, max(1, min(context.DEALT_BY, k - 2))) for x in held.values()) == len(set(grams))


def test_repeats_take_no_row_of_each_gram(spark):
    text = "".join(chr(32 + (i * i * 7919 >> 3) % 95) for i in range(40000))
    n, made = context._packed([text.encode()], 16)
    assert sum(len(x) for _, _, x in made) < 4 * n
    plan = context.repeat_coverage(spark.createDataFrame([(text,)], "text string"), "text", "text", 16)._jdf.queryExecution().toString()
    assert "high" not in plan


def plain_cross(rows: list[tuple], column: int) -> tuple[int, int, int]:
    """One state from the first row to the last."""
    src, off, hits = -1, 0, 0
    for *left, v in rows:
        if v is None:
            continue
        equal = [i for i in range(column) if left[i] == v]
        if hits >= 1 and src >= 0 and left[src] is not None and left[src] + off == v:
            hits = min(hits + 1, 255)
        elif equal:
            src, off, hits = equal[0], 0, 1
        elif column and left[column - 1] is not None:
            src, off, hits = column - 1, v - left[column - 1], 1
        else:
            hits //= 2
    return src, off, hits


def cross_rows(draw: random.Random, n: int, kind: int) -> list[tuple]:
    if kind == 0:  # a constant offset, now and then broken, and rows without the column to the left
        return [(i, None if draw.random() < 0.3 else i + 3, i + (5 if draw.random() < 0.95 else 6)) for i in range(n)]
    if kind == 1:  # few values, many nulls
        return [tuple(draw.choice([None, None, 1, 2, 3]) for _ in range(3)) for _ in range(n)]
    return [(i, draw.choice([None] * 9 + [i + 1]), i + 7) for i in range(n)] if kind == 2 else [(i, None, i * i) for i in range(n)]


@pytest.mark.parametrize("kind", range(4))
def test_stretches_of_cross_columns_compose(kind):
    draw = random.Random(kind)
    for _ in range(60):
        rows = cross_rows(draw, draw.choice([1, 3, 9, 40, 600]), kind)
        at, state = 0, (-1, 0, 0)
        while at < len(rows):
            stretch, n = numeric.CrossStretch(2), draw.choice([1, 2, 5, 30, 400])
            for row in rows[at : at + n]:
                if row[-1] is not None:
                    stretch.add(row)
            at += n
            state = numeric.follow_cross(state, *stretch.ends())
        assert state == plain_cross(rows, 2)


def test_cross_column_is_no_array_of_a_field(spark):
    draw = random.Random(7)
    rows = [(f, i, *r) for f in ("a", None) for i, r in enumerate(cross_rows(draw, 700, 0) + cross_rows(draw, 300, 1))] + [("c", 0, 1, 1, None)]
    made = numeric.cross_column(spark.createDataFrame(rows, "f string, o long, a long, b int, c long").repartition(7), "f", ["o"], ["a", "b", "c"], 2)
    assert "collect_list" not in made._jdf.queryExecution().toString()
    assert {tuple(r) for r in made.collect()} == {(f, *plain_cross([r[2:] for r in rows if r[0] == f], 2)) for f in ("a", None, "c")}


def test_rides_of_a_batch_are_handed_on(spark, monkeypatch):
    """Rides of one batch of texts are many rows, so a task holds a bounded number of them."""
    text = "ab cd ef gh ab cd xx ef gh ab " * 3
    texts = [(i if i % 5 else None, f"{text}{i}") for i in range(300)]

    sizes = []
    monkeypatch.setattr(matches, "HELD", 50)

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts, strict=True)], names=["id", "text"])
            self.made = list(run(iter([batch])))
            sizes.extend(x.num_rows for x in self.made)
            return self

        def withColumnRenamed(self, a, b):
            return [tuple(r.values()) for x in self.made for r in x.to_pylist()]

    monkeypatch.setattr(matches, "spread", lambda df: df, raising=False)
    most = max(len(plain_rides(t.encode(), 4)) for _, t in texts)
    assert matches.rides(Frame(), "id", "text", 4) == [(i, *r) for i, t in texts for r in plain_rides(t.encode(), 4)]
    assert len(sizes) > 1 and max(sizes) <= 50 + most


def test_rides_of_drawn_streams():
    draw = random.Random(3)
    for _ in range(150):
        words = ["".join(draw.choice("abc") for _ in range(draw.choice([1, 3, 30, 200]))) for _ in range(6)]
        data = "".join(draw.choice(words) for _ in range(draw.choice([3, 12, 20]))).encode()[:1500]
        for k in (1, 2, 6, 9, 16, 20):
            assert matches.rides_of(data, k) == plain_rides(data, k)


def test_rides_look_at_no_byte_alone(monkeypatch):
    """Bytes between rides and on them are passed over: the byte-wise automaton of the mixer is not run."""
    monkeypatch.setattr(matches, "Ride", None)
    data = b"the quick brown fox, the quick brown cat, the quick brown fox" * 3
    assert matches.rides_of(data, 6) == plain_rides(data, 6)


@pytest.mark.parametrize("k", [6, 16])
def test_previous_of_documents_sorts_within_streams(spark, k):
    plan = catalogue_models.QUERIES[f"match_previous_{k}"](spark, DATA)._jdf.queryExecution().toString()
    assert "Window" not in plan and "gram" not in plan and "MapInArrow" in plan

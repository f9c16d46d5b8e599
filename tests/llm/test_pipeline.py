"""The stages of the corpus pipeline on small inputs, each against what it promises."""

import collections
import random
import re

import pytest

from stratalens.llm import packing, suffix_dedup

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsi zeta eta theta iota kappa".split()) + str(rng.randrange(60)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 1) for i, t in rows], COLUMNS)


def test_toxic_documents_go(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, prose(rng, 50) + (" vileword vileword nastyword" if i % 4 == 0 else "")) for i in range(400)] + [(None, prose(rng, 50)), (900, None), (901, "")]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, frame(spark, rows), str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None and i < 400} == {i for i in range(400) if i % 4} and {900, 901} <= set(ids) and None in ids


def test_one_of_each_near_duplicate_group_stays(spark, tmp_path):
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(6)]
    rows = [(10 * k + j, b + (" end" if j else "")) for k, b in enumerate(base) for j in range(3)]
    rows += [(None, base[0]), (None, prose(rng, 60)), (None, None), (500, None), (501, ""), (501, ""), (600, base[1]), (600, base[1]), (700, prose(rng, 40)), (700, prose(rng, 40)), (700, base[2])]
    found = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path)).collect()
    count = collections.Counter((r.doc_id, r.text) for r in found)
    assert all(n == 1 for n in count.values())
    assert [i for i in range(0, 60) if any(r.doc_id == i for r in found)] == [0, 10, 20, 30, 40, 50]
    ids = collections.Counter(r.doc_id for r in found)
    assert ids[None] == 2 and ids[500] == ids[501] == 1 and ids[600] == 0 and ids[700] == 2


def test_repeats_are_cut(spark, tmp_path):
    rng = random.Random(4)
    passage = prose(rng, 80)
    rows = [(i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for i in range(5)] + [(None, f"{prose(rng, 30)} {passage}"), (7, None), (8, ""), (9, prose(rng, 90))]
    rows += [(20, "é" * 300), (21, "x" + "é" * 300)]
    got = {(r.doc_id): r for r in corpus_pipeline.cut_repeats(spark, frame(spark, rows), str(tmp_path)).collect()}
    raws, width = [(t or "").encode() for _, t in rows], suffix_dedup.WIDTH
    seen = collections.Counter(r[p : p + width] for r in raws for p in range(len(r) - width + 1))
    for (i, t), raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            if seen[raw[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert got[i].text == (None if t is None else left) and got[i].n_chars == (None if t is None else len(left))


def test_passages_of_words_are_cut(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    long, short = text(51), text(49)
    assert len(" ".join(long).encode()) < suffix_dedup.WIDTH
    rows = [(i, f"<{i}> {' '.join(text(30))} <{i}>", [long, short][i % 2], f"<{i}> {' '.join(text(9))}") for i in range(6)]
    rows.append((None, "<null>", long, ""))
    texts = [(i, f"{a} {(chr(10) + ' ' if k == 2 else ' ').join(p)} {b}") for k, (i, a, p, b) in enumerate(rows)]
    texts += [(20, None), (21, ""), (22, " ".join(long)), (23, " ".join(long)), (24, " ".join(text(60)))]
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, frame(spark, texts), "").collect()}
    want = {i: f"{a}  {b}" if p is long else t for (i, a, p, b), (_, t) in zip(rows, texts)}
    want |= {i: t for i, t in texts if i in (20, 21, 24)} | {22: "", 23: ""}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())


def test_the_whole_pipeline(spark, tmp_path):
    import public_tokenizers

    rng = random.Random(5)
    shared = prose(rng, 90)
    rows = [(i, prose(rng, 60) + (" vileword vileword" if i % 5 == 0 else "")) for i in range(100)]
    rows += [(200 + i, f"{prose(rng, 40)} {shared} {prose(rng, 20)}") for i in range(4)] + [(300, rows[1][1]), (301, "card 4111111111111111 here " + prose(rng, 10)), (302, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {i for i in range(0, 100, 5)} and 300 not in ids and {1, 200, 201, 202, 203, 301, 302} <= ids
    tokens = collections.Counter()
    for r in got:
        tokens[r.doc_id] += r.length
    own = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json")).own
    assert tokens[302] == 1 and tokens[1] == len(own.encode(rows[1][1], add_special_tokens=False).ids) + 1
    alone = len(own.encode(re.sub(re.escape(shared), "", rows[100][1]), add_special_tokens=False).ids)
    assert tokens[200] < len(own.encode(rows[100][1], add_special_tokens=False).ids) and abs(tokens[200] - alone) < 30
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0, name

"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import bpe, jaccard, langid, packing, pii, quality, suffix_dedup, topk, toxicity, warc
from stratalens.llm.common import shared_dir

P = pytest.importorskip("public_tokenizers")
RNG = random.Random(31)
LONG = " ".join(RNG.choice(["alpha", "beta", "gamma", "идиот", "1d10t", "x" * 40]) for _ in range(60_000))
ROWS = [(1, "a short text of some words"), (2, None), (3, ""), (None, "a text without an id, told twice"), (None, "a text without an id, told twice"), (None, None), (4, LONG), (5, "copy " * 200), (6, "copy " * 200), (7, "same row"), (7, "same row"), (7, "same id, other text"), (8, " \t\n")]

#: Each operator over (doc_id, text) with the columns it makes; inputs hold columns of those very names.
OPERATORS = {
    "toxicity": (lambda d: toxicity.score(d, toxicity.Lexicon(dict(toxicity.SEED))), ["score", "n_hits"], True),
    "pii": (lambda d: pii.pseudonymise(d), ["pii_counts"], True),
    "quality": (lambda d: quality.quality(d), ["n_words", "base_failed", "kept"], True),
    "suffix": (lambda d: suffix_dedup.dedup(d), ["n_bytes", "n_removed", "kept"], False),
    "jaccard": (lambda d: jaccard.join(d, 3, 90), ["n_shingles", "component_id", "node", "n"], False),
    "langid": (lambda d: langid.predict(d, langid.BiGru(["de", "en"])), ["lang_pred", "score"], True),
    "bpe": (lambda d: bpe.encode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), ["ids", "n_tokens"], True),
}


def frame(spark, rows, clashing=()):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("mine") for c in clashing} | {"Extra": F.lit(5)})


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    run, made, keeps = OPERATORS[name]
    out = run(frame(spark, ROWS, made))
    rows = out.collect()
    assert len(rows) == len(ROWS) and sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    assert all(c in out.columns for c in made if c not in ("node", "n"))
    if keeps:
        assert all(r["Extra"] == 5 for r in rows)
        assert not any(r[c] == "mine" for r in rows for c in made)
    empty = run(frame(spark, ROWS, made).filter("false"))
    assert empty.count() == 0 and empty.schema == out.schema


def test_jaccard_names_and_firsts(spark):
    got = jaccard.join(frame(spark, ROWS), 3, 90).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[5] + by[6]} == {5} and [r.first for r in by[5]] == [True] and [r.first for r in by[6]] == [False]
    assert sorted((r.n_shingles, r.first) for r in by[7]) == [(1, True), (1, True), (2, False)] or len({r.set_id for r in by[7]}) == 2
    assert all(r.component_id is None for r in by[None]) and sum(r.first for r in by[None]) == 3  # the text twice, and the null
    assert all(r.n_shingles == 0 and r.set_id is None and r.component_id == r.doc_id for i in (2, 3, 8) for r in by[i])


def test_packing_odd_rows(spark):
    rows = [(i, t) for i, t in ROWS if i is not None and i != 7] + [(7, "same row"), (7, "same row")]
    got = packing.pack(frame(spark, rows, ["start", "length", "sequence_id"]), P.path("word_bpe_49k.json")).collect()
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert sum(r.length for r in got if r.doc_id == 2) == 1 and sum(r.length for r in got if r.doc_id == 7) == 2 * next(r.doc_tokens for r in got if r.doc_id == 7)
    assert packing.pack(frame(spark, rows).filter("false"), P.path("word_bpe_49k.json")).count() == 0


def test_warc_odd_rows(spark):
    far = 1 << 62
    rows = [(i, f"http://x/{i}", f"page {i} " * 40) for i in range(200)] + [(far, None, "page 3 " * 40), (-far, "u", None), (None, "v", "no id"), (None, "w", "page 5 " * 40), (9, "http://x/9", "page 9 " * 40), (300, "y", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"shard": F.lit("mine"), "key": F.lit(1)})
    folder = shared_dir(spark, "test-warc-odd")
    listed = warc.write(df.repartition(5), folder, roll_bytes=1500, shard_bytes=9000)
    got = warc.read(spark, folder).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert len(got) == len(rows) and len(by[None]) == 2
    assert by[far][0].record_type == "revisit" and by[far][0].refers_to == 3 and by[3][0].record_type == "response" and by[-far][0].payload_bytes == 0
    assert sorted(r.record_type for r in by[9]) == ["response", "revisit"] and by[300][0].payload_bytes == len(LONG.encode())
    assert {r.refers_to for r in by[None]} == {None, 5}
    # an outlying key does not put the others into one shard
    assert listed.select("shard").distinct().count() > 5
    again = shared_dir(spark, "test-warc-again")
    key = lambda x: sorted((r.path, r.sha256) for r in x.collect())
    assert key(listed) == key(warc.write(df.repartition(2), again, roll_bytes=1500, shard_bytes=9000))
    nothing = shared_dir(spark, "test-warc-none")
    warc.write(df.filter("false"), nothing)
    assert warc.read(spark, nothing).count() == 0


def test_topk_ties(spark):
    same = spark.createDataFrame([(i, [1, 2, 3]) for i in range(30)] + [(30, [])], "id long, v array<bigint>")
    got = topk.top_k(same, same.filter("id in (0, 12, 30)"), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, i, 14) for i in (1, 2, 3, 4, 5)] + [(12, i, 14) for i in (0, 1, 2, 3, 4)]


def naive_hits(lexicon, text):
    """Words hit, and weights, by trying every entry and phrase at every word."""
    words = toxicity.words_of(text or "")
    phrases = [toxicity.words_of(p) for p in lexicon.exceptions]
    masked = set()
    for i in range(len(words)):
        for p in phrases:
            if words[i : i + len(p)] == p:
                masked.update(range(i, i + len(p)))
    found = [max((w for s, w in lexicon.weights.items() if word.startswith(s)), default=0.0) for word in words]
    return [w for i, w in enumerate(found) if w and i not in masked]


def test_toxicity_equals_naive_matching():
    rng = random.Random(17)
    lexicon = toxicity.Lexicon(dict(toxicity.SEED) | {"trashy": 1.0, "clo": 0.5})
    pool = ["you", "IDIOT", "1d10t", "іdіоt", "trash", "can", "bag", "clown", "fish", "clownfish", "class", "sore", "loser", "rule", "scum", "line", "pond", "ﬁne", "m0r0n!", "St​upid", "simple", "2020", "trashy"]
    for _ in range(400):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        hits = naive_hits(lexicon, text)
        density, amount, n = lexicon.features(text)
        assert n == len(hits) and amount == pytest.approx(np.log1p(sum(hits))) and density == pytest.approx(np.log1p(100 * sum(hits) / max(len(toxicity.words_of(text)), 20)))


def test_langid_equals_a_plain_network():
    """States and probabilities of one window, position by position and without batches."""
    net = langid.BiGru(["a", "b", "c"], 4)
    sig = lambda x: 1 / (1 + np.exp(-x))
    text = "Grüße, wörld".encode()
    n, states = net.units, np.zeros((len(text), 8))
    for k, d in enumerate("fb"):
        e, u, h = net.p[f"e{d}"].astype(float), net.p[f"u{d}"].astype(float), np.zeros(4)
        for t in range(len(text)) if d == "f" else reversed(range(len(text))):
            z, r = sig(e[text[t], :n] + h @ u[:, :n]), sig(e[text[t], n : 2 * n] + h @ u[:, n : 2 * n])
            h = z * h + (1 - z) * np.tanh(e[text[t], 2 * n :] + r * (h @ u[:, 2 * n :]))
            states[t, k * n : (k + 1) * n] = h
    scores = np.exp(states @ net.p["v"] + net.p["c"])
    want = scores / scores.sum(1, keepdims=True)
    got = net.probabilities(net.run(np.frombuffer(text, np.uint8)[:, None])[0])[:, 0]
    assert np.allclose(got, want, atol=1e-4)


def test_langid_draws_from_whole_texts(spark):
    texts = [("x" * 20_000) + "y" * 20_000 for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)] + [(100, None, "l"), (101, "short", "m"), (None, "none", "n")], "doc_id long, text string, lang string")
    rows = langid.training_rows(docs, sample=30, drawn=6)
    drawn = [w for w, lang in rows if lang == "l"]
    assert 60 < len(drawn) <= 180 and all(len(w) <= langid.WINDOW for w in drawn)
    share = np.mean([w.startswith(b"y") for w in drawn])
    assert 0.3 < share < 0.7 and not any(lang == "n" for _, lang in rows)
    assert rows == langid.training_rows(docs.repartition(7), sample=30, drawn=6)


def test_bpe_joins_every_piece():
    codec = bpe.TreeCodec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    pieces = [m for m in re.findall(r" ?\w+", LONG[:4000] + " unbelievable antidisestablishmentarianism Straße") if len(m) > 1]
    for piece in set(pieces):
        before = codec.joins
        ids = codec.tree(piece.encode())
        assert ids == codec.merged(piece.encode()) and (codec.joins > before or len(piece.encode()) <= bpe.HALF)
    assert codec.joins > 0 and codec.grown > 0


def test_a_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(unset, "x")


def test_stored_steps_leave_the_settings_alone(spark):
    from stratalens.llm.common import discard, materialise

    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before = [spark.conf.get(k) for k in keys]
    stored = materialise(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "test-stored")
    assert stored.count() == 7 and stored.agg(F.sum("count")).first()[0] == 100
    with pytest.raises(Exception, match="(?i)divi"):
        materialise(spark.sql("select 1 / id as x from range(3)"), "test-fails")
    assert [spark.conf.get(k) for k in keys] == before
    discard(stored)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        stored.count()

"""Packing into fixed-length sequences by cutting-stock column generation.

Documents become pieces: full sequences and one rest each. The histogram of rest lengths, rounded
up to bins of ``BIN`` tokens, is a cutting-stock problem: a linear program over patterns (how many
rests of each bin one sequence takes) is solved by column generation. Its master is kept as a
basis with dual prices; an unbounded knapsack, solved by dynamic programming over the capacity,
prices the next pattern. The optimum is rounded down and what remains is packed best-fit
decreasing, in bins. The histogram has at most ``LENGTH / BIN`` entries whatever the corpus size,
so the driver's part is bounded.

Rests are ranked within their bin, in two steps so that a bin with a third of all documents is
ranked by many tasks, and rank intervals of a bin belong to patterns: a search in the plan's
prefix sums gives the sequence of every rest without a shuffle. Offsets within a sequence are
running sums over its few pieces.

Defined cases: null text is empty and packs its end token alone; repeated ids and rows are packed
separately; rows without an id are packed like any other, with a null id; texts longer than a sequence are cut; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise

#: Tokens of a sequence, tokens of a histogram bin, and the id that ends a document.
LENGTH, BIN, END = 4096, 16, 2
#: The linear program ends when its value is proven to be within this share of the optimum.
TOLERANCE = 1e-3
#: Words whose ids a worker remembers; emptied when full.
CACHE_ENTRIES = 100_000
#: Rows that one ranking task is meant to hold.
RANKED = 50_000

PIECES = "doc_id long, doc_key long, start long, length long, ids_crc32 long, doc_tokens long"


#: Words of these signs are lower-cased, cut and merged without the tokenizer's
#: general path: printable ASCII but the apostrophe (which starts contractions), Latin-1 letters.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
UNITS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordTokens(dict):
    """Ids of white-space separated words as little-endian bytes, encoded when first met.

    The vocabulary marks word ends. With an end mark as a byte that UTF-8 never holds, its ids
    are ranks of byte-level merges, which a merge routine applies to plain words directly; all
    other words go through the tokenizer. Both give the same ids (tested).
    """

    def __init__(self, file: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.own = Tokenizer.from_file(file)
        self.own.encode_special_tokens = True
        with open(file, encoding="utf-8") as f:
            stored = json.load(f)
        special = {t["content"] for t in stored["added_tokens"]}
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {}
        for token, i in stored["model"]["vocab"].items():
            if token not in special:
                end = token.endswith("</w>")
                ranks[bytes(byte_of[c] for c in (token[:-4] if end else token)) + b"\xff" * end] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            ids = [i for unit in UNITS.findall(word.lower()) for i in self.merge(unit.encode() + b"\xff")]
        else:
            ids = self.own.encode(word, add_special_tokens=False).ids
        made = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = made
        return made


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones stay themselves."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


_tokens: dict[str, WordTokens] = {}


def token_ids(file: str, text: str | None) -> bytes:
    """Ids of a text. The vocabulary drops white space and never merges across it, so words are
    encoded one by one. ``str.split`` cuts at what the tokenizer drops and at four control signs
    that it keeps; texts with those are cut at ASCII white space only."""
    if file not in _tokens:
        _tokens[file] = WordTokens(file)
    if not text:
        return b""
    odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
    return b"".join(map(_tokens[file].__getitem__, re.split(r"[ \t\n\v\f\r]+", text) if odd else text.split()))


def pieces(docs: DataFrame, file: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Cuts every document into full sequences and a rest, with checksums of the ids."""
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", "doc_key", "start", "length", "ids_crc32", "doc_tokens")])
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                rows = []
                for doc_id, text, key in zip(*(whole.column(i).slice(k, 1024).to_pylist() for i in range(3)), strict=True):
                    ids = token_ids(file, text) + tail
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, key, start, len(part) // 4, zlib.crc32(part), n))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 6)], schema=kinds)

    # the key tells rows of equal ids apart, in the order of ranks
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("doc_key")).mapInArrow(lean(run), PIECES)


def best_pattern(prices, sizes, capacity: int):
    """Unbounded knapsack: how many of each size give the most worth within the capacity."""
    import numpy as np

    worth = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_up, prices_up = sizes[order], prices[order]
    fits = np.searchsorted(sizes_up, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        worth[c], taken[c] = worth[c - 1], -1
        if m := fits[c]:
            gain = worth[c - sizes_up[:m]] + prices_up[:m]
            k = int(gain.argmax())
            if gain[k] > worth[c] + 1e-12:
                worth[c], taken[c] = gain[k], order[k]
    pattern = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[taken[c]] += 1
            c -= sizes[taken[c]]
    return worth[capacity], pattern


def column_generation(sizes, demand, capacity: int, rounds: int = 4000):
    """Patterns (rows) and their amounts in an optimum of the linear program, by the revised
    simplex method with an explicit inverse of the basis."""
    import numpy as np

    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # columns are patterns
    inverse = np.diag(1.0 / (capacity // sizes))
    amounts = inverse @ demand
    for step in range(rounds):
        worth, pattern = best_pattern(inverse.sum(0), sizes, capacity)  # every pattern costs one sequence
        if worth <= 1 + TOLERANCE:  # then no solution is better by more than this share
            break
        column = inverse @ pattern
        up = column > 1e-10
        if not up.any():
            break
        ratio = np.where(up, amounts / np.where(up, column, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = pattern
        amounts = amounts - ratio[leave] * column
        amounts[leave] = ratio[leave]
        amounts = np.maximum(amounts, 0)
        inverse[leave] /= column[leave]
        others = np.arange(m) != leave
        inverse[others] -= np.outer(column[others], inverse[leave])
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
            amounts = np.maximum(inverse @ demand, 0)
    return basis.T.round().astype(np.int64), amounts


def plan(histogram: dict[int, int], length: int = LENGTH, bin_size: int = BIN) -> list[tuple[dict[int, int], int]]:
    """(pattern by bin, copies) that hold exactly the histogram {bin: rests}; a bin b stands for
    rests of up to b * bin_size tokens."""
    import numpy as np

    left = {b: n for b, n in histogram.items() if n}
    if not left:
        return []
    capacity = length // bin_size
    sizes = np.array(sorted(left))
    patterns, amounts = column_generation(sizes, np.array([left[b] for b in sizes], float), capacity)
    out: list[tuple[dict[int, int], int]] = []
    for pattern, amount in sorted(zip(patterns.tolist(), amounts.tolist(), strict=True), key=lambda x: (-x[1], x[0])):
        use = {int(b): k for b, k in zip(sizes, pattern, strict=True) if k}
        copies = min([int(amount + 1e-6), *(left[b] // k for b, k in use.items())])
        if copies > 0 and use:
            out.append((use, copies))
            for b, k in use.items():
                left[b] -= k * copies
    # what rounding left over: best fit decreasing, equal fills in one step
    open_bins: list[tuple[int, dict[int, int]]] = []
    for b in sorted((b for b in left if left[b]), reverse=True):
        for _ in range(left[b]):
            fit = min((i for i, (free, _) in enumerate(open_bins) if free >= b), key=lambda i: open_bins[i][0], default=None)
            if fit is None:
                open_bins.append((capacity - b, {b: 1}))
            else:
                free, use = open_bins[fit]
                use[b] = use.get(b, 0) + 1
                open_bins[fit] = (free - b, use)
    return out + [(use, 1) for _, use in open_bins]


def pack(docs: DataFrame, file: str, length: int = LENGTH, end: int = END, bin_size: int = BIN) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, file, length, end), "pieces").withColumn("bin", F.ceil(F.col("length") / bin_size).cast("int"))
    n = cut.count()
    salts = max(16, -(-n // RANKED))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_key", "start"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("bin", "salt").count()
    before = counts.select("bin", "salt", F.sum("count").over(Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("count").alias("n")).collect()}  # at most length / bin_size rows
    patterns = plan(histogram, length, bin_size)
    first_of: dict[int, list] = {b: [] for b in histogram}  # (first rank, a copy's share, first sequence)
    sequence, done = 0, dict.fromkeys(histogram, 0)
    for use, copies in patterns:
        for b, k in use.items():
            first_of[b].append((done[b], k, sequence))
            done[b] += k * copies
        sequence += copies

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tables = {b: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for b, rows in first_of.items()}
        for batch in batches:
            bins, ranks = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            made = np.empty(len(bins), np.int64)
            for b in np.unique(bins):
                rows = np.flatnonzero(bins == b)
                first, share, at = tables[int(b)]
                k = np.searchsorted(first, ranks[rows], "right") - 1
                made[rows] = at[k] + (ranks[rows] - first[k]) // share[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(made)], names=[*batch.schema.names[:-2], "sequence_id"])

    order = Window.partitionBy("bin", "salt").orderBy("doc_id", "doc_key", "start")
    joined = salted.join(before, ["bin", "salt"])
    ranked = joined.withColumn("rank", F.row_number().over(order) - 1 + F.coalesce("before", F.lit(0)))
    placed = ranked.select("doc_id", "doc_key", "start", "length", "ids_crc32", "doc_tokens", "bin", "rank").mapInArrow(lean(place), f"{PIECES}, sequence_id long")
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "doc_key", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table

    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))

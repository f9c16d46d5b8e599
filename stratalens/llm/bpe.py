"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut into pre-tokens by the vocabulary's pattern; merges never cross them, so texts
concatenate from pre-tokens exactly. A pre-token is halved down to single bytes, and the encodings of
two halves are joined: a window over the border is re-encoded and grown on both sides until the
tokens outside it are proven stable. The proof is the pair criterion of byte-pair encodings: a token
sequence is the encoding of its bytes exactly when every two neighbouring tokens, encoded alone, give
those same two tokens. Both halves meet it inside, so only the two seams of the window have to be
tested. Windows are re-encoded by merging the pair of lowest rank, leftmost first, as the vocabulary
defines; short halves recur in many pre-tokens and are remembered in bounded memories.
Decoding concatenates the byte strings of the two halves up the same tree.

The operator is a map over documents: no shuffle, no state beyond bounded caches in each worker.

Defined cases: null text is the empty text (0 tokens, decoded to ""); texts of any length are
encoded whole; repeated rows give repeated results; columns of the input are kept, except that
an input column named as an output is replaced.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens, and their most bytes, whose encodings a worker remembers; the memory is emptied when full.
CACHE_ENTRIES, REMEMBERED_BYTES = 400_000, 48
#: Halves of at most so many bytes are remembered, and pairs of tokens: entries of each memory.
HALF, REMEMBERED = 6, 200_000
#: Bytes of a window up to which the next pair to merge is searched in a list; above that a heap is kept.
SHORT = 32
#: Above every rank.
NONE = 1 << 62
#: Ids below which a decoding is concatenated at once.
LEAF_IDS = 8192


def little_endian(ids) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class TreeCodec:
    """Encodes and decodes byte strings by the ranks of one vocabulary file."""

    def __init__(self, ranks_file: str, pattern: str):
        import regex

        with open(ranks_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = regex.compile(pattern)
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.table[rank] = piece
        self._cache: dict[str, bytes] = {}
        #: Joins made, and windows that had to grow.
        self.joins = self.grown = 0
        self._halves: dict[bytes, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The encoding by definition: of all neighbouring parts that are a token together, the pair of
        lowest rank merges, the leftmost of equal ones first. Long pieces keep their pairs in a heap."""
        n, ranks = len(piece), self.ranks
        if n <= SHORT:
            parts = [piece[k : k + 1] for k in range(n)]
            found = [ranks.get(piece[k : k + 2], NONE) for k in range(n - 1)]
            while found and (least := min(found)) != NONE:
                k = found.index(least)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del found[k]
                if k < len(found):
                    found[k] = ranks.get(parts[k] + parts[k + 1], NONE)
                if k:
                    found[k - 1] = ranks.get(parts[k - 1] + parts[k], NONE)
            return tuple([ranks[x] for x in parts])
        end = [*range(1, n + 1), n]  # of the part that starts here; 0 for places inside a part
        before = [*range(-1, n)]
        pair = lambda i: ranks.get(piece[i : end[end[i]]]) if end[i] < n else None
        waiting = [(r, i, end[i], i + 2) for i in range(n - 1) if (r := pair(i)) is not None]
        heapify(waiting)
        while waiting:
            _, i, middle, last = heappop(waiting)
            if end[i] != middle or middle >= n or end[middle] != last:
                continue  # one of the parts has merged since
            end[i], end[middle] = last, 0
            before[last] = i
            for k in (before[i], i):
                if k >= 0 and end[k] < n and (r := pair(k)) is not None:
                    heappush(waiting, (r, k, end[k], end[end[k]]))
        found, i = [], 0
        while i < n:
            found.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(found)

    def pair(self, left: int, right: int) -> tuple[int, ...]:
        """The encoding of the bytes of two tokens: the two themselves, where they are stable side by side."""
        made = self._pairs.get((left, right))
        if made is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            made = self._pairs[left, right] = self.merged(self.table[left] + self.table[right])
        return made

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of ``a`` followed by those of ``b``, both encodings themselves."""
        self.joins += 1
        window, i, j = self.pair(a[-1], b[0]), 1, 1  # the last token of one and the first of the other
        if window == (a[-1], b[0]):
            return a + b  # no neighbours are new but stable ones
        while True:
            left_ok = i == len(a) or len(self.pair(a[-i - 1], window[0])) == 2 and self.pair(a[-i - 1], window[0])[0] == a[-i - 1]
            right_ok = j == len(b) or len(self.pair(window[-1], b[j])) == 2 and self.pair(window[-1], b[j])[1] == b[j]
            if left_ok and right_ok:
                return a[: len(a) - i] + window + b[j:]
            self.grown += 1
            i, j = i if left_ok else min(2 * i, len(a)), j if right_ok else min(2 * j, len(b))
            window = self.merged(b"".join(map(self.table.__getitem__, a[len(a) - i :] + b[:j])))

    def tree(self, piece: bytes) -> tuple[int, ...]:
        """Encodes halves down to single bytes and joins them on the way up."""
        size = len(piece)
        if size <= 1:
            return (self.ranks[piece],) if size else ()
        if size > HALF:
            return self.join(self.tree(piece[: size // 2]), self.tree(piece[size // 2 :]))
        made = self._halves.get(piece)
        if made is None:
            if len(self._halves) >= REMEMBERED:
                self._halves.clear()
            made = self._halves[piece] = self.join(self.tree(piece[: size // 2]), self.tree(piece[size // 2 :]))
        return made

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = little_endian(self.tree(raw))
        if len(raw) <= REMEMBERED_BYTES:
            if len(self._cache) >= CACHE_ENTRIES:
                self._cache.clear()
            self._cache[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, new = self._cache.get, self.encode_piece
        return b"".join([known(p) or new(p) for p in self.pieces.findall(text)]) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        import numpy as np

        def concat(x: list[int]) -> bytes:
            if len(x) <= LEAF_IDS:
                return b"".join(map(self.table.__getitem__, x))
            return concat(x[: len(x) // 2]) + concat(x[len(x) // 2 :])

        return concat(np.frombuffer(ids, "<u4").tolist()) if ids else b""


_codecs: dict[tuple[str, str], TreeCodec] = {}


def codec(ranks_file: str, pattern: str) -> TreeCodec:
    """One codec per worker process."""
    if (key := (ranks_file, pattern)) not in _codecs:
        _codecs[key] = TreeCodec(*key)
    return _codecs[key]


def _mapped(df: DataFrame, source: str, added: list[T.StructField], rows, ranks_file: str, pattern: str) -> DataFrame:
    """Adds columns made from ``source``; batches are cut again so that long texts stay bounded."""
    names = {f.name.lower() for f in added}
    kept = [c for c in df.columns if c.lower() not in names or c == source]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(source)
    keep = [i for i, c in enumerate(kept) if c.lower() not in names]
    schema = T.StructType([df.schema.fields[i] for i in keep] + added)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(ranks_file, pattern)
        kinds = {"long": pa.int64(), "binary": pa.binary()}
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                made = rows(own, batch.column(at).to_pylist())
                arrays = [batch.column(i) for i in keep] + [pa.array(v, kinds["long" if f.dataType.typeName() == "long" else "binary"]) for f, v in zip(added, made, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``; drops nothing."""

    def rows(own: TreeCodec, texts: list) -> list[list]:
        made = [own.encode(t) for t in texts]
        return [made, [len(x) // 4 for x in made]]

    return _mapped(df, text, [T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())], rows, ranks_file, pattern)


def decode(df: DataFrame, ranks_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that ``ids`` stand for. Ids outside the vocabulary raise an error."""
    return _mapped(df, ids, [T.StructField(decoded, T.BinaryType())], lambda own, x: [[own.decode(i) for i in x]], ranks_file, pattern)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table

    files = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, *files).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
    decoded = decode(encoded, *files)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

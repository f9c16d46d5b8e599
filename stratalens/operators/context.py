"""Context statistics: conditional entropy of bytes given the bytes or fields before them.

k-grams are counted within Arrow batches, as one or two 64-bit words, so that a shuffle carries one row
for each different k-gram of some megabytes of text, not one row for each byte. Where only the number of
different k-grams counts, they travel as pieces of text instead: neighbours that share their smallest m-gram
go to one bucket together, so a k-gram costs a few bytes, not a row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.placement import spread

#: Bytes of text whose k-grams are counted together in a task.
COUNTED = 4 << 20
#: Buckets that k-grams are dealt to, bytes of the m-grams that deal them, and bytes of a bucket that is sorted at once.
BUCKETS, DEALT_BY, SORTED = 4096, 5, 16 << 20
#: Stands behind each piece of text in a bucket; no UTF-8 text has it.
END = 255


def _pieces(batches: Iterator, k: int) -> Iterator[list[bytes]]:
    """Texts of some megabytes together; pieces of a long text overlap by k - 1 bytes."""
    held, size = [], 0
    for batch in batches:
        for t in batch.column(0):
            raw = (t.as_py() or "").encode()
            for at in range(0, max(len(raw), 1), COUNTED):
                held.append(raw[at : at + COUNTED + k - 1])
                size += len(held[-1])
                if size >= COUNTED:
                    yield held
                    held, size = [], 0
    yield held


def gram_counts(df: DataFrame, text: str, k: int) -> DataFrame:
    """(high, low, c): how often each k-gram of bytes (k up to 16) occurs within texts. ``low`` holds its last
    eight bytes, ``high`` those before them, as numbers; null and shorter texts have none."""
    if not 1 <= k <= 16:
        raise ValueError("k must be from 1 to 16")

    def counted(texts: list[bytes]):
        import numpy as np
        import pyarrow as pa

        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data) - k + 1
        if n <= 0:
            return None
        ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
        inside = np.flatnonzero(np.arange(n) + k <= ends[:n])
        part = lambda first, last: np.bitwise_or.reduce([data[i : i + n].astype(np.uint64) << np.uint64(8 * (last - 1 - i)) for i in range(first, last)])[inside]
        low = part(max(0, k - 8), k)
        if k <= 8:
            low, c = np.unique(low, return_counts=True)
            high = np.zeros(len(low), np.uint64)
        else:
            high = part(0, k - 8)
            order = np.lexsort((low, high))
            low, high = low[order], high[order]
            first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(low)])
            low, high, c = low[first], high[first], np.diff(np.append(first, len(low)))
        return pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(c.astype(np.int64))], names=["high", "low", "c"])

    def run(batches: Iterator) -> Iterator:
        return (made for texts in _pieces(batches, k) if (made := counted(texts)) is not None)

    grams = spread(df.select(F.col(text).cast("string"))).mapInArrow(run, "high long, low long, c long")
    return grams.groupBy("high", "low").agg(F.sum("c").alias("c"))


def byte_rows(df: DataFrame, text: str, k: int) -> DataFrame:
    """(ctx, byte, c): how often each byte stands behind each context of k bytes (k up to 7), as numbers."""
    grams = gram_counts(df, text, k + 1)
    return grams.select(F.shiftright("low", 8).alias("ctx"), F.col("low").bitwiseAND(255).alias("byte"), "c")


def entropy(rows: DataFrame) -> DataFrame:
    """Bits per byte of (ctx, byte) rows, which count once or ``c`` times; counts are pre-aggregated."""
    c = rows if "c" in rows.columns else rows.groupBy("ctx", "byte").agg(F.count("*").alias("c"))
    # sum of -c log2(c / t) = sum over contexts of t log2 t, less sum of c log2 c
    per = c.groupBy("ctx").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    total = per.agg(F.count("*").alias("n_contexts"), F.sum("t").alias("n_bytes"), F.sum(F.col("t") * F.log2("t") - F.col("s")).alias("bits"))
    return total.select("n_contexts", "n_bytes", F.round(F.col("bits") / F.col("n_bytes"), 6).alias("bits_per_byte"))


def _words(data, k: int):
    """(high, low): the k-grams (k up to 16) of an array of bytes as numbers, the last eight bytes in ``low``."""
    import numpy as np

    n = len(data) - k + 1
    high, low = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        word = high if i < k - 8 else low
        word <<= np.uint64(8)
        word |= data[i : i + n]
    return high, low


def _mixed(high, low):
    import numpy as np

    h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sorted(high, low, inside):
    """(positions of ``inside`` by a hash of their k-gram and in order, whether the hash differs from the one before,
    and whether it is equal but the k-gram differs)."""
    import numpy as np

    bits = np.uint64(int(len(low)).bit_length())
    key = np.sort((_mixed(high, low)[inside] >> bits << bits) | inside.astype(np.uint64))
    i = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    key >>= bits
    new, mixed = np.append(True, key[1:] != key[:-1]), np.zeros(len(i), bool)
    same = np.flatnonzero(~new)
    x, y = i[same], i[same - 1]
    mixed[same] = (low[x] != low[y]) | (high[x] != high[y])
    return i, new, mixed


def _first_seen(high, low, inside):
    """Positions of ``inside`` in order without those whose k-gram stands before; a rare one may stay."""
    import numpy as np

    i, new, mixed = _sorted(high, low, inside)
    return np.sort(i[new | mixed])


def _packed(texts: list[bytes], k: int) -> tuple[int, list[tuple[int, int, bytes]]]:
    """How many k-grams texts have, and (bucket, size, compressed pieces) that hold each different one."""
    import numpy as np

    data = np.frombuffer(b"".join(texts), np.uint8)
    n, lengths = max(len(data) - k + 1, 0), [len(t) for t in texts]
    inside = np.flatnonzero(np.arange(n) + k <= np.repeat(np.cumsum(lengths), lengths)[:n])
    return len(inside), _dealt(data, inside, k, max(1, min(DEALT_BY, k - 2)), BUCKETS)


def _dealt(data, inside, k: int, m: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """The k-grams at ``inside`` as (bucket, size, compressed pieces); the smallest m-gram of each names its bucket."""
    import numpy as np
    import pyarrow as pa

    if not len(inside):
        return []
    at = _first_seen(*_words(data, k), inside)
    least, width = _mixed(*_words(data, m)), 1
    while width < k - m + 1:
        step = min(width, k - m + 1 - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    bucket = (least[at] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)).astype(np.int64) % buckets
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (bucket[1:] != bucket[:-1])]))
    begin, size, bucket = at[first], at[np.append(first[1:], len(at)) - 1] + k - at[first] + 1, bucket[first]
    order = np.argsort(bucket, kind="stable")
    begin, size, bucket = begin[order], size[order], bucket[order]
    to = np.cumsum(size) - size
    out = np.append(data, np.uint8(END))[np.arange(size.sum()) + np.repeat(begin - to, size)]
    out[to + size - 1] = END
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    codec, cut = pa.Codec("zstd"), np.append(to[edge], len(out))
    return [(int(b), int(z - a), codec.compress(out[a:z].tobytes(), asbytes=True)) for b, a, z in zip(bucket[edge], cut[:-1], cut[1:], strict=True)]


def _unpacked(held: list[tuple[int, bytes]], k: int) -> Iterator:
    """(data, positions of its k-grams) of the pieces of a bucket, some megabytes together; ``held`` is emptied."""
    import numpy as np
    import pyarrow as pa

    codec, raw, size = pa.Codec("zstd"), [], 0
    while held:
        own, packed = held.pop()
        raw.append(codec.decompress(packed, decompressed_size=own, asbytes=True))
        size += own
        if size >= COUNTED or not held:
            data = np.frombuffer(b"".join(raw), np.uint8)
            ends = np.cumsum(np.append(0, data == END))
            yield data, np.flatnonzero(ends[k:] == ends[:-k])
            raw, size = [], 0


def _different(held: list[tuple[int, bytes]], k: int, m: int) -> int:
    """How many different k-grams the pieces of a bucket have that m-grams dealt; a large one is dealt again by
    longer m-grams. ``held`` is emptied."""
    import numpy as np

    if (whole := sum(size for size, _ in held)) > SORTED and m < k:
        m, parts = min(m + 3, k), {}
        for data, inside in _unpacked(held, k):
            for part, size, packed in _dealt(data, inside, k, m, 1 + 2 * whole // SORTED):
                parts.setdefault(part, []).append((size, packed))
        return sum(_different(part, k, m) for part in parts.values())
    high, low = (np.concatenate(x) for x in zip(*((h[i], w[i]) for data, i in _unpacked(held, k) for h, w in [_words(data, k)]), strict=True))
    if not len(low):
        return 0
    i, new, mixed = _sorted(high, low, np.arange(len(low)))
    if not mixed.any():
        return int(new.sum())
    group = np.cumsum(new)  # those of one hash with several k-grams are counted one by one
    several = np.unique(group[mixed])
    own = i[np.isin(group, several)]
    return int(new.sum()) - len(several) + len(set(zip(high[own].tolist(), low[own].tolist(), strict=True)))


def repeat_coverage(df: DataFrame, order: str, text: str, k: int) -> DataFrame:
    """How many k-grams (k up to 16) of all texts have occurred before. The first occurrence of each is the
    only one that has not, so counting distinct k-grams replaces a sort of all positions."""
    if not 1 <= k <= 16:
        raise ValueError("k must be from 1 to 16")
    m = max(1, min(DEALT_BY, k - 2))

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts in _pieces(batches, k):
            n, made = _packed(texts, k)
            if made:
                bucket, size, packed = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([n] + [0] * (len(made) - 1), pa.int64()), pa.array(size, pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "n", "size", "packed"])

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, held, n, total = None, [], 0, 0
        for batch in batches:
            for bucket, grams, size, packed in zip(*(batch.column(i) for i in range(4)), strict=True):
                if bucket.as_py() != own:
                    total += _different(held, k, m) if held else 0
                    own, held = bucket.as_py(), []
                held.append((size.as_py(), packed.as_py()))
                n += grams.as_py()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total + _different(held, k, m)], pa.int64())], names=["n", "different"])

    dealt = spread(df.select(F.col(text).cast("string"))).mapInArrow(deal, "bucket int, n long, size long, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    made = dealt.mapInArrow(count, "n long, different long").agg(F.sum("n").alias("n_grams"), F.sum("different").alias("n_distinct"))
    return made.select("n_grams", (F.col("n_grams") - F.col("n_distinct")).alias("n_repeats"))


def field_bytes(cells: DataFrame, field: str, value: str, by: str, most: int = 31) -> DataFrame:
    """(ctx, byte) of every byte of token rows. The context is the field with the byte's position in
    its token (``by='position'``, up to ``most``) or with the byte before it (``by='previous'``)."""

    def rows(b: Column) -> Column:
        byte = lambda p: F.hex(F.substring(b, p, F.lit(1)))
        second = lambda p: F.least(p - 1, F.lit(most)).cast("string") if by == "position" else F.when(p > 1, byte(p - 1)).otherwise("")
        return F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda p: F.struct(second(p).alias("s"), byte(p).alias("byte")))

    bound = F.element_at(F.transform(F.array(F.encode(F.col(value), "utf-8")), rows), 1)
    out = cells.filter(F.octet_length(value) > 0).select(field, F.explode(bound).alias("x"))
    return out.select(F.concat_ws(":", F.col(field).cast("string"), F.col("x.s")).alias("ctx"), "x.byte")

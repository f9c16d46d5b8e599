"""Match models over byte streams: earlier occurrences of k-grams, recent candidates, and rides.

A stream is one row's text; positions count its bytes, so streams spread over tasks. Candidates are
windows over (stream, k-gram). Distances back and rides are Arrow scans, whose memory is bounded by one
stream and a batch: k-grams of a stream are numbered and sorted within it, so none is shuffled.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..plans.placement import spread

#: Candidates that are looked at, bytes compared backwards, first confidence at most.
CANDIDATES, BACK, FRESH = 8, 64, 8
#: Rides that a task holds before it hands them on.
HELD = 1 << 16


def gram_positions(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, p, gram) for every count p of bytes that ends a k-gram; null texts have none."""
    grams = lambda b: F.transform(F.sequence(F.lit(k), F.octet_length(b)), lambda p: F.struct(p.alias("p"), F.substring(b, p - k + 1, F.lit(k)).alias("gram")))
    bound = F.element_at(F.transform(F.array(F.encode(F.col(text), "utf-8")), grams), 1)
    return df.filter(F.octet_length(text) >= k).select(key, F.explode(bound).alias("x")).select(key, "x.p", "x.gram")


def gram_numbers(data: bytes, k: int):
    """A number for each k-gram of ``data`` in order; equal numbers are equal k-grams, whatever k is."""
    import numpy as np

    raw, width = np.frombuffer(data, np.uint8), min(k, 8)
    n = len(raw) - width + 1
    if len(raw) < k:
        return np.zeros(0, np.uint64)
    numbers = np.bitwise_or.reduce([raw[i : i + n].astype(np.uint64) << np.uint64(8 * (width - 1 - i)) for i in range(width)])
    while width < k:  # two k-grams that overlap or touch make a longer one
        step = min(width, k - width)
        known, rank = np.unique(numbers, return_inverse=True)
        numbers = rank[:-step].astype(np.uint64) * np.uint64(len(known)) + rank[step:].astype(np.uint64)
        width += step
    return numbers


def distances(data: bytes, k: int) -> tuple[int, int, int]:
    """Positions of a stream, those whose k-gram occurred before, and the sum of distances back."""
    import numpy as np

    numbers = gram_numbers(data, k)
    if not len(numbers):
        return 0, 0, 0
    order = np.argsort(numbers, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(numbers[order]) != 0]))
    last = np.append(first[1:], len(order)) - 1
    # distances between the neighbours of a k-gram add up to that of its last position to its first
    return len(order), len(order) - len(first), int((order[last] - order[first]).sum())


def previous(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Of each stream: positions, those whose k-gram occurred before, and the sum of distances back. Rows of
    one key are one stream with their positions together; keys of one row need no shuffle of positions."""
    again = df.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("rows")).filter("rows > 1").select("again")
    if again.isEmpty():
        return _scanned(df, key, text, k)
    same = F.col(key).eqNullSafe(F.col("again"))
    return _scanned(df.join(again, same, "left_anti"), key, text, k).unionByName(_together(df.join(again, same, "left_semi"), key, text, k))


def _scanned(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    names = ["n_positions", "n_found", "total_distance"]
    schema = StructType([df.schema[key]])
    for name in names:
        schema = schema.add(name, LongType())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = [(i, *distances((t.as_py() or "").encode(), k)) for i, t in enumerate(batch.column(1))]
            made = [x for x in made if x[1]]
            index, *columns = zip(*made, strict=True) if made else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], names=[key, *names])

    return spread(df.select(key, F.col(text).cast("string"))).mapInArrow(run, schema)


def _together(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    w = Window.partitionBy(key, "gram").orderBy("p")
    rows = gram_positions(df, key, text, k).withColumn("d", (F.col("p") - F.lag("p").over(w)).cast("bigint"))
    return rows.groupBy(key).agg(F.count("*").alias("n_positions"), F.count("d").alias("n_found"), F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("total_distance"))


def candidates(df: DataFrame, key: str, text: str, k: int, most: int = CANDIDATES) -> DataFrame:
    """(key, p, found): the ``most`` latest earlier positions of the same k-gram, oldest first."""
    w = Window.partitionBy(key, "gram").orderBy("p").rowsBetween(-most, -1)
    return gram_positions(df, key, text, k).select(key, "p", F.collect_list("p").over(w).alias("found")).filter(F.size("found") > 0)


class Ride:
    """Follows an earlier occurrence while bytes agree; searches only when nothing is followed."""

    def __init__(self, k: int):
        self.k, self.seen, self.source, self.confidence, self.back = k, {}, None, 0, 0

    def push(self, data: bytearray) -> bool:
        """Takes note of the last byte of ``data``; true when a new ride starts behind it."""
        n = len(data)
        if self.source is not None and data[self.source] == data[-1]:
            self.source, self.confidence = self.source + 1, self.confidence + 1
        else:
            self.source, self.confidence = None, 0
        if n < self.k:
            return False
        before = self.seen.setdefault(bytes(data[-self.k :]), deque(maxlen=CANDIDATES))
        starts = self.source is None and bool(before)
        if starts:  # the longest agreement backwards, and of equal ones the latest
            self.back, self.source = max((agreement(data, c, n), c) for c in before)
            self.confidence = min(self.back, FRESH)
        before.append(n)
        return starts


def agreement(data: bytearray, a: int, b: int, most: int = BACK) -> int:
    """How many bytes before position a equal those before position b."""
    n = 0
    while n < min(a, most) and data[a - 1 - n] == data[b - 1 - n]:
        n += 1
    return n


def rides_of(data: bytes, k: int) -> list[tuple[int, int, int, int]]:
    """(start, source, bytes that agreed backwards, bytes ridden) of every ride of a stream. Only where a k-gram
    occurred before can a ride start, and nothing is looked up on a ride, so that bytes between are passed over."""
    import numpy as np

    numbers, found, at = gram_numbers(data, k), [], 0
    if len(numbers) < 2:
        return found
    order = np.argsort(numbers, kind="stable")  # positions of a k-gram lie together, in order
    edge = np.append(True, np.diff(numbers[order]) != 0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    begin = np.maximum.accumulate(np.where(edge, np.arange(len(order)), 0))[rank]
    again = np.flatnonzero(begin < rank)
    starts, froms, tos = (array("q", x.astype(np.int64).tobytes()) for x in (again + k, np.maximum(begin, rank - CANDIDATES)[again], rank[again]))
    ends = order + k
    del numbers, edge, rank, begin, again
    while at < len(starts):
        n = starts[at]
        back, source = max((_back(data, c, n), c) for c in ends[froms[at] : tos[at]].tolist())
        ridden = _ahead(data, source, n)
        found.append((n, source, back, ridden))
        at = bisect_left(starts, n + ridden + 1, at + 1)  # the byte behind a ride is known before the next starts
    return found


def _back(data: bytes, a: int, b: int) -> int:
    """``agreement`` of two positions, by the lowest byte that differs."""
    most = min(a, BACK)
    x = int.from_bytes(data[a - most : a]) ^ int.from_bytes(data[b - most : b])
    return ((x & -x).bit_length() - 1) // 8 if x else most


def _ahead(data: bytes, a: int, b: int) -> int:
    """How many bytes from position a on equal those from position b on; a lies before b."""
    n, step = 0, 16
    while (own := data[b + n : b + n + step]) and data[a + n : a + n + len(own)] == own:
        n, step = n + len(own), min(2 * step, 1 << 16)
    if own:
        x = int.from_bytes(data[a + n : a + n + len(own)], "little") ^ int.from_bytes(own, "little")
        n += ((x & -x).bit_length() - 1) // 8
    return n


def rides(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, start, source, back, ridden) of all rides of all streams; null text has none."""

    def made(held: list):
        import numpy as np
        import pyarrow as pa

        own, rows = np.repeat(np.arange(len(held)), [len(r) for _, r in held]), np.concatenate([r for _, r in held])
        columns = [pa.array([i for i, _ in held], pa.int64()).take(pa.array(own)), *(pa.array(np.ascontiguousarray(rows[:, j])) for j in range(4))]
        return pa.RecordBatch.from_arrays(columns, names=["stream_id", "start", "source", "back", "ridden"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        held, size = [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                if found := rides_of((t.as_py() or "").encode(), k):
                    held.append((i.as_py(), np.array(found, np.int64)))
                    size += len(found)
                if size >= HELD:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    return spread(df.select(F.col(key).cast("long"), F.col(text).cast("string"))).mapInArrow(run, "stream_id long, start long, source long, back long, ridden long").withColumnRenamed("stream_id", key)

"""A context-mixing back end for blocks, and the code length it gives without writing anything.

Integer arithmetic throughout: adaptive bit probabilities of byte contexts of orders 0 to 4 and of two
contexts of structure (field with place and string state; field with column or depth and the byte before),
the votes of two rides (short and long k-grams) and the vote of the digits that a numeric field predicts are
mixed in the logistic domain, with weights chosen by the byte before. A range coder with carries turns probabilities into bytes. A bit loop in
Python is slow, so this back end is for research on ratios; ``blocks`` uses LZMA by default.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detect import sniff
from ..operators.matches import Ride
from .fields import TRACKERS

#: Orders of contexts, k-grams of rides, learning rates, and 16.16 fixed point.
ORDERS, GRAMS, CELL_SHIFT, LEARN, ONE = 5, (6, 16), 4, 7, 1 << 16
TABLES = ORDERS + 2
INPUTS = TABLES + len(GRAMS) + 1
STRETCH = [max(-2047, min(2047, round(256 * math.log(max(p, 0.5) / (4096 - p))))) for p in range(4096)]
SQUASH = [max(1, min(4095, round(4096 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)]
#: Cost of an event of probability p / 4096, in 1 / 65,536 bit.
COST = [0] + [round(-math.log2(p / 4096) * ONE) for p in range(1, 4097)]


class Model:
    """Predicts the next bit of a stream and learns it; encoder and decoder start from the same one."""

    def __init__(self, mode: str = "generic"):
        self.data, self.node, self.depth = bytearray(), 1, 0
        self.cells: list[dict] = [{} for _ in range(TABLES)]
        self.place = TRACKERS.get(mode, TRACKERS["generic"])()
        self.weights: dict[int, list[int]] = {}
        self.rides = [Ride(k) for k in GRAMS]
        self._bind()

    def _bind(self) -> None:
        d, at = self.data, self.place
        keys = [bytes(d[len(d) - k :]) if len(d) >= k else None for k in range(ORDERS)]
        keys += [(at.field, at.place, at.quoted), (at.field, at.axis, d[-1] if d else None)]
        self.tables = [cells.setdefault(k, {}) for k, cells in zip(keys, self.cells, strict=True)]
        self.digit = at.digit()
        self.mix = self.weights.setdefault(d[-1] if d else 0, [ONE // INPUTS] * INPUTS)

    def predict(self) -> int:
        """The probability of a one, of 4096."""
        votes = [STRETCH[min(t.get(self.node, 2048), 4095)] for t in self.tables]
        for r in self.rides:
            vote = 0
            if r.source is not None:
                expected = self.data[r.source] | 256
                if expected >> (8 - self.depth) == self.node:
                    size = STRETCH[2048 + 2047 * r.confidence // (r.confidence + 1)]
                    vote = size if expected >> (7 - self.depth) & 1 else -size
            votes.append(vote)
        vote = 0
        if self.digit is not None and (self.digit | 256) >> (8 - self.depth) == self.node:
            size = STRETCH[2048 + 2047 * self.place.count // (self.place.count + 1)]
            vote = size if self.digit >> (7 - self.depth) & 1 else -size
        self.votes = [*votes, vote]
        votes = self.votes
        total = sum(w * v for w, v in zip(self.mix, votes, strict=True)) >> 16
        self.p = SQUASH[max(-2047, min(2047, total)) + 2047]
        return self.p

    def learn(self, bit: int) -> None:
        error = ((bit << 12) - self.p) * LEARN
        mix = self.mix
        for i, v in enumerate(self.votes):
            mix[i] += v * error >> 16
        for t in self.tables:
            cell = t.get(self.node, 2048)
            t[self.node] = cell + ((bit << 12) - cell >> CELL_SHIFT)
        self.node, self.depth = self.node << 1 | bit, self.depth + 1
        if self.depth == 8:
            self.data.append(self.node & 255)
            self.node, self.depth = 1, 0
            for r in self.rides:
                r.push(self.data)
            self.place.push(self.data[-1])
            self._bind()


def bits_of(data: bytes) -> Iterator[int]:
    return (byte >> i & 1 for byte in data for i in range(7, -1, -1))


def code_length(data: bytes, mode: str = "generic") -> int:
    """The ideal length of a stream in 1 / 65,536 bit."""
    model, total = Model(mode), 0
    for bit in bits_of(data):
        p = model.predict()
        total += COST[p if bit else 4096 - p]
        model.learn(bit)
    return total


def encode(data: bytes, mode: str = "generic") -> bytes:
    model, out, low, span = Model(mode), bytearray(), 0, (1 << 32) - 1
    for bit in bits_of(data):
        share = (span >> 12) * model.predict()
        model.learn(bit)
        low, span = (low, share) if bit else (low + share, span - share)
        if low >> 32:  # a carry runs into what is written
            at = len(out) - 1
            while out[at] == 255:
                out[at] = 0
                at -= 1
            out[at] += 1
            low &= (1 << 32) - 1
        while span < 1 << 24:
            out.append(low >> 24)
            low, span = low << 8 & (1 << 32) - 1, span << 8
    # one value inside the last interval: its low end rounded up to the bytes that matter
    if low + (1 << 24) - 1 >> 32:
        at = len(out) - 1
        while out[at] == 255:
            out[at] = 0
            at -= 1
        out[at] += 1
        return bytes(out) + bytes(4)
    return bytes(out) + bytes([low + (1 << 24) - 1 >> 24, 0, 0, 0])


def decode(payload: bytes, size: int, mode: str = "generic") -> bytes:
    """The first ``size`` bytes of the stream; a payload that ends early is read on as zeros."""
    model, at, span = Model(mode), 4, (1 << 32) - 1
    code = int.from_bytes(payload[:4].ljust(4, b"\0"), "big")
    for _ in range(8 * size):
        share = (span >> 12) * model.predict()
        bit = int(code < share)
        if bit:
            span = share
        else:
            code, span = code - share, span - share
        model.learn(bit)
        while span < 1 << 24:
            code = (code << 8 | (payload[at] if at < len(payload) else 0)) & (1 << 32) - 1
            at, span = at + 1, span << 8
    return bytes(model.data)


def mixed_lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, ideal_bits, packed_bytes, ok) of every stream, by its mode: estimate, real size, round trip."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, t, mode in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (t or "").encode()
                packed = encode(raw, mode)
                rows.append({"stream_id": k, "n_bytes": len(raw), "ideal_bits": code_length(raw, mode) / ONE, "packed_bytes": len(packed), "ok": decode(packed, len(raw), mode) == raw})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("stream_id", pa.int64()), ("n_bytes", pa.int64()), ("ideal_bits", pa.float64()), ("packed_bytes", pa.int64()), ("ok", pa.bool_())]))

    spread = df.select(F.col(key).cast("long"), text, sniff(F.col(text))).repartition(df.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, "stream_id long, n_bytes long, ideal_bits double, packed_bytes long, ok boolean").withColumnRenamed("stream_id", key)


def adaptive_cost(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, n_bits, cost) in 1 / 65,536 bit of order-k adaptive probabilities alone, one stream a row.

    A cell (stream, context, bits of the byte so far) changes only by its own bits, so cells are
    folded independently: one group for each, its bits in order.
    """

    def bits(b: Column) -> Column:
        at = lambda p: F.conv(F.hex(F.substring(b, p, F.lit(1))), 16, 10).cast("int") + 256
        context = lambda p: F.when(p > k, F.hex(F.substring(b, p - k, F.lit(k)))).otherwise("")
        return F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda p: F.struct(p.alias("p"), context(p).alias("ctx"), at(p).alias("v")))

    bound = F.element_at(F.transform(F.array(F.encode(F.col(text), "utf-8")), bits), 1)
    rows = df.filter(F.octet_length(text) > 0).select(key, F.explode(bound).alias("x"))
    rows = rows.select(key, "x.*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    node, bit = F.expr("shiftright(v, 8 - i)").alias("node"), F.expr("shiftright(v, 7 - i) & 1").alias("bit")
    cells = rows.select(key, "ctx", node, "p", bit).groupBy(key, "ctx", "node").agg(F.array_sort(F.collect_list(F.struct("p", "bit"))).alias("seen"))

    def step(s: Column, x: Column) -> Column:
        held = F.greatest(F.lit(1), F.least(F.lit(4095), s["p"]))
        right = F.when(x["bit"] == 1, held).otherwise(4096 - held)
        cost = F.round(-F.log2(right / 4096.0) * ONE).cast("bigint")
        return F.struct((s["p"] + F.shiftright(x["bit"] * 4096 - s["p"], CELL_SHIFT)).cast("int").alias("p"), (s["cost"] + cost).alias("cost"))

    start = F.struct(F.lit(2048).cast("int").alias("p"), F.lit(0).cast("bigint").alias("cost"))
    folded = cells.select(key, F.size("seen").alias("n"), F.aggregate("seen", start, step)["cost"].alias("cost"))
    return folded.groupBy(key).agg(F.sum("n").cast("bigint").alias("n_bits"), F.sum("cost").cast("bigint").alias("cost"))

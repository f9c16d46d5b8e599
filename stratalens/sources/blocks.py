"""Block container: independently decodable, checksummed blocks with their header as columns.

Back ends: ``structure`` takes lines apart into columns and never makes a block more than a byte larger
than ``lzma`` does, which is LZMA alone; ``mix`` is the context mixer, for small data only.
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.placement import spread
from . import mixing, structure

VERSION, BLOCK_BYTES = 1, 1 << 20
BLOCKS = "stream_id long, block_no int, mode string, version int, back_end string, orig_len long, crc32 long, payload binary"
BACK_ENDS = {
    "structure": (structure.encode, lambda payload, size, mode: structure.decode(payload, size)),
    "lzma": (lambda data, mode: structure.pack(data), lambda payload, size, mode: structure.unpack(payload, size)),
    "mix": (mixing.encode, mixing.decode),
}


def sized(back_end: str, part: bytes, mode: str) -> tuple[bytes, int]:
    """The payload of a block, and the bytes that LZMA alone makes of it."""
    if back_end == "structure":
        return structure.encode_sized(part, mode)
    payload = BACK_ENDS[back_end][0](part, mode)
    return payload, len(payload if back_end == "lzma" else structure.pack(part))


def _with(kinds: str, df: DataFrame, names: list[str]) -> StructType:
    schema = StructType.fromDDL(kinds)
    for name in names:
        schema = schema.add(name, df.schema[name].dataType)
    return schema


def compress_blocks(df: DataFrame, key: str, data: str, block_bytes: int = BLOCK_BYTES, back_end: str = "structure", carry: list[str] | None = None, plain: bool = False) -> DataFrame:
    """Cuts the bytes of each row into blocks and compresses each; ``df`` has (key, data, mode). Blocks are
    cut at line ends where there are some. Rows are dealt evenly, so that one large file is many tasks; rows
    with columns to ``carry``, which go to each block, stay where they are. ``plain`` adds the bytes that LZMA alone
    makes of a block."""
    made, carry, own = BACK_ENDS[back_end][0], carry or [], ", plain long" if plain else ""

    def cuts(raw: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(raw) or not at:
            end = at + block_bytes
            if end < len(raw) and (line := raw.rfind(b"\n", at, end)) >= at + block_bytes // 2:
                end = line + 1
            yield raw[at:end]
            if end >= len(raw):
                return
            at = end

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [("stream_id", pa.int64()), ("block_no", pa.int32()), ("mode", pa.string()), ("version", pa.int32()), ("back_end", pa.string()), ("orig_len", pa.int64()), ("crc32", pa.int64()), ("payload", pa.binary()), *[("plain", pa.int64())] * plain]
        for batch in batches:
            rows, held = [], 0
            if carry and len(kinds) < 8 + plain + len(carry):
                kinds += [(c, batch.schema.field(3 + i).type) for i, c in enumerate(carry)]
            schema = pa.schema(kinds)
            for k, raw, mode, *more in zip(*batch.columns, strict=True):
                for no, part in enumerate(cuts(raw.as_py() or b"")):
                    payload, alone = sized(back_end, part, mode.as_py()) if plain else (made(part, mode.as_py()), None)
                    row = {"stream_id": k.as_py(), "block_no": no, "mode": mode.as_py(), "version": VERSION, "back_end": back_end, "orig_len": len(part), "crc32": zlib.crc32(part), "payload": payload, "plain": alone}
                    rows.append(row | {c: x.as_py() for c, x in zip(carry, more, strict=True)})
                    held += len(rows[-1]["payload"])
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = df.select(F.col(key).cast("long"), F.col(data).cast("binary"), "mode", *carry)
    return (rows if carry else spread(rows)).mapInArrow(run, _with(BLOCKS + own, df, carry))


def valid_header(version: Column, mode: Column, orig_len: Column, block_bytes: int = BLOCK_BYTES) -> Column:
    """Checked before anything is allocated or decoded."""
    return F.coalesce((version == VERSION) & mode.isin("generic", "json", "csv", "sql", "xml") & orig_len.between(0, block_bytes), F.lit(False))


def decompress_blocks(blocks: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(stream_id, block_no, data, ok): a block with a bad header, payload or checksum is not ok. Columns to
    ``carry`` stay beside them."""
    carry = carry or []

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, held = [], 0
            kinds = pa.schema([("stream_id", pa.int64()), ("block_no", pa.int32()), ("data", pa.binary()), ("ok", pa.bool_()), *((c, batch.schema.field(8 + i).type) for i, c in enumerate(carry))])
            for row in zip(*batch.columns, strict=True):
                k, no, good, mode, back_end, size, crc, payload, *more = (x.as_py() for x in row)
                data = None
                if good:
                    try:
                        data = BACK_ENDS[back_end][1](payload or b"", size, mode)
                    except (lzma.LZMAError, ValueError, struct.error, IndexError, StopIteration, OverflowError):
                        data = None
                ok = data is not None and len(data) == size and zlib.crc32(data) == crc
                rows.append({"stream_id": k, "block_no": no, "data": data if ok else None, "ok": ok} | dict(zip(carry, more, strict=True)))
                held += len(data or b"")
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    good = valid_header(F.col("version"), F.col("mode"), F.col("orig_len")) & F.col("back_end").isin(*BACK_ENDS)
    checked = blocks.select("stream_id", "block_no", good, "mode", "back_end", "orig_len", "crc32", "payload", *carry)
    return checked.mapInArrow(run, _with("stream_id long, block_no int, data binary, ok boolean", blocks, carry))


def streams_of(decoded: DataFrame, *more: Column) -> DataFrame:
    """(stream_id, n_bytes, ok, sha256) of the streams that blocks were cut from; a stream is one row's bytes. ``more``
    are aggregates over the blocks of a stream."""
    parts = F.array_sort(F.collect_list(F.struct("block_no", "data")))
    whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, F.coalesce(x["data"], F.lit(b""))))
    return decoded.groupBy("stream_id").agg(F.sum(F.octet_length("data")).cast("bigint").alias("n_bytes"), F.min("ok").alias("ok"), F.sha2(whole, 256).alias("sha256"), *more)

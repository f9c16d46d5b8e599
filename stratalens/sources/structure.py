"""A lossless codec of text blocks that takes lines apart into columns.

A line becomes a template (what its lines have in common) and values; the values of a place in a template
are a column. Integer columns are written as the best of their text, fixed-width numbers, differences of
first or second order, or differences to the integer column before them in the line; columns of few
different values are written as those values and numbers of them. Streams are compressed
one by one by LZMA, and a block is kept whole where that is smaller. Only integers in their one shortest
spelling become numbers, so ``007`` and ``-0`` stay text and every block comes back byte by byte.
"""

from __future__ import annotations

import lzma
import re
import struct

#: What is a value in a line of each mode; CSV lines are cut at commas.
VALUES = {
    "json": re.compile(rb'(?<=[:,\[\s])(?:-?\d+(?:\.\d+)?|"(?:[^"\\]|\\.)*"(?!\s*:))'),
    "sql": re.compile(rb"-?\d+(?:\.\d+)?|'(?:[^'\\]|\\.)*'"),
    "xml": re.compile(rb'(?<=>)[^<>]+(?=<)|(?<==")[^"]*(?=")'),
    "csv": re.compile(rb"[^,]+"),
}
INTEGER = re.compile(rb"(?:0|-?[1-9]\d{0,17})\Z")
#: Templates of a block at most, and lines for each of them at least; a block with more is kept whole.
TEMPLATES, LINES = 256, 8
MARK = b"\0"
#: First bytes of payloads.
PLAIN, COLUMNS = b"P", b"C"

TEXT, FIXED, FIRST, SECOND, ACROSS, NAMED = range(6)


def _filters(size: int) -> list[dict]:
    """No larger dictionary than the data: the encoder's memory follows the block."""
    return [{"id": lzma.FILTER_LZMA2, "preset": 9 | lzma.PRESET_EXTREME, "dict_size": max(4096, size)}]


def pack(data: bytes) -> bytes:
    return lzma.compress(data, lzma.FORMAT_RAW, filters=_filters(len(data))) if data else b""


def unpack(data: bytes, size: int) -> bytes:
    if not size:
        return b""
    out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_filters(size)).decompress(data, max_length=size + 1)
    if len(out) != size:
        raise ValueError("a stream of another size than its header says")
    return out


def _planes(values) -> bytes:
    """Fixed width, as narrow as the values allow: the bytes of one place of all values lie together."""
    import numpy as np

    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or -(1 << 8 * w - 1) <= values.min() and values.max() < 1 << 8 * w - 1)
    return bytes([width]) + values.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(data: bytes):
    import numpy as np

    width = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T).view(f"<i{width}").ravel().astype(np.int64)


def _column(cells: list[bytes], left) -> tuple[int, bytes, object]:
    """The kind and bytes of a column, and its integers if it has them; ``left`` has those before it."""
    import numpy as np

    made = [(TEXT, b"\n".join(cells))]
    if len(names := dict.fromkeys(cells)) <= 256:
        number = {c: i for i, c in enumerate(names)}
        made.append((NAMED, struct.pack("<I", len(names)) + b"\n".join(names) + b"\n" + bytes([number[c] for c in cells])))
    whole = all(map(INTEGER.match, cells))
    v = np.array([int(c) for c in cells], np.int64) if whole else None
    if whole:
        made += [(FIXED, _planes(v)), (FIRST, _planes(np.diff(v, prepend=0))), (SECOND, _planes(np.diff(v, n=2, prepend=[0, 0])))]
    if whole and left is not None:
        made.append((ACROSS, _planes(v - left)))
    kind, data = min(made, key=lambda x: len(lzma.compress(x[1], lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 1}])))
    return kind, data, v


def _cells(kind: int, data: bytes, left) -> tuple[list[bytes], object]:
    import numpy as np

    if kind in (TEXT, NAMED):
        cells = data.split(b"\n")
        if kind == NAMED:
            names = data[4:].split(b"\n", struct.unpack_from("<I", data)[0])
            cells = [names[i] for i in names.pop()]
        return cells, np.array([int(c) for c in cells], np.int64) if all(map(INTEGER.match, cells)) else None
    v = _from_planes(data)
    if kind in (FIRST, SECOND):
        for _ in range(kind - FIXED):
            v = np.cumsum(v)
    elif kind == ACROSS:
        v = v + left
    return [b"%d" % x for x in v.tolist()], v


def streams(block: bytes, mode: str) -> list[tuple[int, bytes]] | None:
    """The streams of a block: templates, the template of each line, then all columns; None to keep it whole."""
    import numpy as np

    pattern = VALUES.get(mode)
    if pattern is None or MARK in block:
        return None
    known: dict[bytes, int] = {}
    columns: list[list[list[bytes]]] = []
    of_line = []
    for line in block.split(b"\n"):
        template = pattern.sub(MARK, line)
        t = known.setdefault(template, len(known))
        if t == len(columns):
            if t == TEMPLATES:
                return None
            columns.append([[] for _ in range(template.count(MARK))])
        of_line.append(t)
        for column, cell in zip(columns[t], pattern.findall(line), strict=True):
            column.append(cell)
    if len(known) * LINES > len(of_line):
        return None
    out = [(TEXT, b"\n".join(known)), (FIXED, _planes(np.array(of_line, np.int64)))]
    for own in columns:
        left = None
        for cells in own:
            kind, data, v = _column(cells, left)
            out.append((kind, data))
            left = left if v is None else v
    return out


def encode(block: bytes, mode: str) -> bytes:
    """The payload of a block, at most one byte larger than LZMA alone makes it."""
    return encode_sized(block, mode)[0]


def encode_sized(block: bytes, mode: str) -> tuple[bytes, int]:
    """The payload of a block, and the bytes that LZMA alone makes of it, which is run once for both."""
    whole = PLAIN + pack(block)
    made = streams(block, mode)
    if made is None:
        return whole, len(whole) - 1
    packed = [(kind, len(data), pack(data)) for kind, data in made]
    head = struct.pack("<I", len(packed)) + b"".join(struct.pack("<BII", kind, size, len(p)) for kind, size, p in packed)
    taken = COLUMNS + head + b"".join(p for _, _, p in packed)
    return min(taken, whole, key=len), len(whole) - 1


def decode(payload: bytes, size: int) -> bytes:
    """The block of ``size`` bytes; a payload that cannot be one raises ValueError, LZMAError or struct.error."""
    if payload[:1] == PLAIN:
        return unpack(payload[1:], size)
    if payload[:1] != COLUMNS:
        raise ValueError("not a payload")
    (count,) = struct.unpack_from("<I", payload, 1)
    if count * 9 > len(payload):
        raise ValueError("more streams than bytes")
    at, made = 5 + 9 * count, []
    for i in range(count):
        kind, own, length = struct.unpack_from("<BII", payload, 5 + 9 * i)
        if own > 9 * size + 64:
            raise ValueError("a stream larger than its block")
        made.append((kind, unpack(payload[at : at + length], own)))
        at += length
    templates, of_line = made[0][1].split(b"\n"), _from_planes(made[1][1]).tolist()
    columns, k = [], 2
    for template in templates:
        own, left = [], None
        for kind, data in made[k : k + template.count(MARK)]:
            cells, v = _cells(kind, data, left)
            left = left if v is None else v
            own.append(iter(cells))
        k += len(own)
        columns.append(own)
    parts = [t.split(MARK) for t in templates]
    lines = []
    for t in of_line:
        line = [parts[t][0]]
        for cells, after in zip(columns[t], parts[t][1:], strict=True):
            line += [next(cells), after]
        lines.append(b"".join(line))
    return b"\n".join(lines)

"""Suffix-array dedup: removes every byte covered by a ``width``-byte string that also starts elsewhere.

The suffix order is sparse: of all suffixes only those at minimizers are kept, positions whose
``core``-byte fingerprint is the smallest in some window. Equal windows of ``width`` bytes choose
the same minimizers at the same offsets, so every repeated window has a kept suffix on each side
and nothing is lost. The steps:

1. Kept suffixes are counted by core fingerprint (pre-aggregated); single ones cannot repeat.
2. Suffixes of shared cores whose whole context agrees (``width`` bytes to the right, the window's
   slack to the left) are one string that counts as many, so equal copies are moved and compared once.
3. Each task sorts its strings into a run, front-codes it (bytes shared with the string before are
   dropped) and cuts it by ranges of the core. Runs are exchanged and merged by loser trees that
   compare from the known common prefix on; the merge yields the common-prefix array. The order is
   by the core's fingerprint, then by the bytes behind the core: cores never have to be moved.
4. Window offsets repeat where strings share enough to the right (common prefixes of the merged
   order) and to the left (those of the reversed order), or where one counts as many. A core with
   more than ``HOT`` different contexts would not fit one merge, and ranges of its tails would not do,
   since windows with few bytes behind the core pair all of them; the windows of such cores are
   counted by 128-bit fingerprints instead, which pre-aggregates, with equal results.
5. Repeated offsets become byte intervals, which are sorted by text and joined where they meet.

Passages of words are found by the same steps on ``word_marks``, where each word is eight letters and
``width`` bytes are ``width // MARK`` words; suffixes are kept at whole words only. Words are read in the same pass as
the bytes, so texts are moved once for both and a task needs one Python worker.

Texts are bytes of UTF-8 and matches never cross texts; what is judged is the input, not what is
left. Defined cases: null text is empty; texts shorter than ``width`` keep everything; repeated
rows repeat each other's windows, so they are emptied where long enough; equal ids with different
texts stay apart; rows without an id are treated like any other; further columns are not returned;
empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, let, materialise, release, salted_join

#: Bytes of a repeated string, and of the core that selects suffixes; their difference is the slack.
WIDTH, CORE = 400, 300
#: Letters that stand for a word in ``word_marks``; ``WIDTH`` of them are a passage of 50 words, with the spaces
#: between them ``LEAST`` bytes or more.
MARK, LEAST = 8, 2 * (WIDTH // 8) - 1
#: Different contexts of one core that are merged in one task; the windows of cores with more are counted.
HOT = 4096
#: Suffixes that one merge is meant to hold.
MERGED = 200_000
#: Cores are the least fingerprints of their windows, so nearly all lie in one end of the range: times ``SPREAD``
#: modulo 2**64, which its inverse undoes, they fill it, and ranges of them are parts of like size.
SPREAD = 0x9E3779B97F4A7C15
UNSPREAD = pow(SPREAD, -1, 2**64)

#: Ends a tail in the sorted strings. No byte of UTF-8 is as large, so a tail that the end of its text
#: cuts short comes behind all that extend it, never between two of them, whatever its left bytes are.
END = b"\xff"

#: ``place`` is a suffix's position with the bytes of context to its left and right, of 12 bits each.
SAMPLES = "core long, context long, doc_id long, row_key long, place long"


def least_of_windows(h, offsets, span: int, several: int):
    """Positions whose fingerprint is the least of ``several`` neighbours in some window of ``span`` units that lies in
    one text. Their upper halves are compared; of equal ones all are kept, so equal windows keep equal positions."""
    import numpy as np

    def sliding(x, f):
        """f over neighbours, by doubling."""
        size = 1
        while 2 * size <= several:
            x = f(x[:-size], x[size:])
            size *= 2
        return f(x[: len(x) - (several - size)], x[several - size :]) if several > size else x

    key = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    least = sliding(key, np.minimum)  # by the window's start
    edges = np.zeros(int(offsets[-1]) + 1, np.int32)
    np.add.at(edges, np.maximum(offsets[1:] - span + 1, offsets[:-1]), 1)
    np.add.at(edges, offsets[1:], -1)
    least[np.cumsum(edges)[: len(least)] > 0] = 0  # such windows do not fit
    padded = np.zeros(len(least) + 2 * (several - 1), np.uint32)
    padded[several - 1 : several - 1 + len(least)] = least
    return np.flatnonzero(sliding(padded, np.maximum) == key)


def kept_suffixes(data, offsets, width: int, core: int, prefix=None, cores_only: bool = False):
    """Rows and positions of the minimizers of a batch of texts, with core and context fingerprints; their cores alone
    with ``cores_only``."""
    import numpy as np

    from .bytehash import Prefix

    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none if cores_only else (none,) * 6
    prefix = prefix or Prefix(data)
    h = prefix.all_of(core)
    at = least_of_windows(h, offsets, width, width - core + 1)
    cores = h[at].view(np.int64)
    return cores if cores_only else _placed(prefix, offsets, at, cores, width - core, width)


def _placed(prefix, offsets, at, cores, slack: int, width: int):
    import numpy as np

    from .bytehash import mix

    rows = np.searchsorted(offsets, at, "right") - 1
    left = np.minimum(slack, at - offsets[rows])
    right = np.minimum(width, offsets[rows + 1] - at)
    context = mix(prefix.of(at - left, at + right) + left.astype(np.uint64) * np.uint64(1000003) + right.astype(np.uint64))
    return rows, at - offsets[rows], cores, context.view(np.int64), left, right


def kept_words(data, offsets, width: int, core: int, prefix, cores_only: bool = False):
    """The same for the texts' words, of ``MARK`` letters each, at whole words only: a core has the words that
    ``core`` letters reach into. A passage begins and ends with whole words, so none is lost."""
    import numpy as np

    from .bytehash import Prefix

    span, known = width // MARK, -(-core // MARK)
    starts, ends, first = word_bounds(data, offsets)
    none = np.zeros(0, np.int64)
    if len(starts) < span:
        return none if cores_only else (none,) * 6
    words = Prefix(prefix.of(starts, ends), values=True)
    h = words.all_of(known)
    at = least_of_windows(h, first, span, span - known + 1)
    cores = h[at].view(np.int64)
    if cores_only:
        return cores
    rows, pos, cores, context, left, right = _placed(words, first, at, cores, (width - core) // MARK, span)
    return rows, pos * MARK, cores, context, left * MARK, right * MARK


def word_bounds(data, offsets):
    """Starts and ends of the words, parted by white space, of a batch of texts, and each text's first word."""
    import numpy as np

    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_marks(column):
    """Of a text column ``MARK`` letters for each word, its fingerprint's last 48 bits, without white space, and the
    offsets of its rows: equal windows of these are equal passages of words."""
    import numpy as np

    from .bytehash import Prefix, bytes_of

    letters = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
    shifts = np.arange(0, 6 * MARK, 6, dtype=np.uint64)
    data, offsets = bytes_of(column)
    starts, ends, first = word_bounds(data, offsets)
    marks = letters[((Prefix(data).of(starts, ends)[:, None] >> shifts) & np.uint64(63)).astype(np.uint8)]
    return marks.reshape(-1), (first * MARK).astype(np.int64)


def _even(key: str = "row_key"):
    return F.shiftleft(F.shiftright(key, 1), 1)


def samples(docs: DataFrame, width: int, core: int, words: bool = False, cores_only: bool = False) -> DataFrame:
    """One row for each kept suffix of (doc_id, text, row_key); with ``words`` also of the texts' marks, whose
    ``row_key`` is the odd one above the text's even one. ``cores_only`` is for counting: only the cores are made."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .bytehash import Prefix, bytes_of, slices

        for whole in batches:
            for batch in slices(whole, 1):
                data, offsets = bytes_of(batch.column(1))
                prefix = Prefix(data)
                made = [find(data, offsets, width, core, prefix, cores_only) for find in ((kept_suffixes, kept_words) if words else (kept_suffixes,))]
                if cores_only:
                    columns = [np.concatenate(made)]
                else:
                    own = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2)]
                    rows, pos, h, c, left, right = (np.concatenate(x) for x in zip(*made, strict=True))
                    odd = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
                    columns = [h, c, own[0][rows], own[1][rows] | odd, pos << 24 | left << 12 | right]
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    if words and width % MARK:
        raise ValueError(f"passages need a width of whole words, of {MARK} letters each")
    schema = "core long" if cores_only else SAMPLES
    names = [field.split()[0] for field in schema.split(", ")]
    return docs.select("doc_id", "text", "row_key").mapInArrow(lean(run), schema)


def front_code(run: list[bytes]) -> bytes:
    """A sorted run: of each string the bytes shared with the one before, the rest's length, the rest."""
    out, last = [], b""
    for s in run:
        shared = common(last, s, 0)
        out += [shared.to_bytes(2, "little"), (len(s) - shared).to_bytes(2, "little"), s[shared:]]
        last = s
    return b"".join(out)


def decode_front(block: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a front-coded run and what each shares with the one before."""
    at, last = 0, b""
    while at < len(block):
        shared, rest = int.from_bytes(block[at : at + 2], "little"), int.from_bytes(block[at + 2 : at + 4], "little")
        last = last[:shared] + block[at + 4 : at + 4 + rest]
        yield last, shared
        at += 4 + rest


def common(a: bytes, b: bytes, start: int) -> int:
    """The length of the common prefix, of which ``start`` bytes are known."""
    end = min(len(a), len(b))
    x, y = a[start:end], b[start:end]
    if x == y:
        return end
    return end - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)  # whole bytes from the first difference on


class LoserTree:
    """Merges sorted runs. Each contender knows what it shares with the last winner, so a match
    compares two such lengths first and touches bytes only where they are equal, from there on."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.runs = runs + [iter(())] * (self.size - len(runs))
        self.heads = [next(r, None) for r in self.runs]
        self.known = [0] * self.size  # of each run's head: bytes shared with the last winner
        self.losers = [-1] * self.size
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._match(node, self._play(2 * node), self._play(2 * node + 1))

    def _match(self, node: int, a: int, b: int) -> int:
        """The smaller of two contenders; the loser stays at the node with what it shares with the winner."""
        if self.heads[a] is None or self.heads[b] is None:
            win, lose = (b, a) if self.heads[a] is None else (a, b)
        elif self.known[a] != self.known[b]:
            win, lose = (a, b) if self.known[a] > self.known[b] else (b, a)
        else:
            x, y = self.heads[a][0], self.heads[b][0]
            shared = common(x, y, self.known[a])
            smaller = shared == len(x) or shared < len(y) and x[shared] < y[shared]
            win, lose = (a, b) if smaller else (b, a)
            self.known[lose] = shared
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[bytes, int]]:
        """The merged strings and what each shares with the one before."""
        while self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run][0], self.known[run]
            following = next(self.runs[run], None)
            self.heads[run] = following
            self.known[run] = following[1] if following else 0
            node, win = (run + self.size) // 2, run
            while node:
                win = self._match(node, win, self.losers[node])
                node //= 2
            self.winner = win


def repeated_offsets(entries: list[tuple[bytes, int]], width: int, core: int):
    """Of merged suffixes (core, tail, left, context in one string) the repeated window offsets.

    A string is 8 bytes of core, the bytes behind the core, ``END``, then left bytes and what ``TRAILER`` says, which begins
    with 1 for a string that counts as many; ``entries`` has them in order with common prefixes. Returns a boolean
    matrix by string and offset.
    """
    import numpy as np

    slack = width - core
    n = len(entries)
    trailer = np.frombuffer(b"".join([s[-13:] for s, _ in entries]), TRAILER)
    right, left, many = trailer["right"].astype(np.int64), trailer["left"].astype(np.int64), trailer["many"].astype(np.int64)
    shared = np.array([x for _, x in entries]) - 8  # with the one before; negative: another core
    new = shared < 0
    new[0] = True
    cores = np.flatnonzero(new)
    sizes = np.diff(np.append(cores, n))
    offsets = np.arange(slack + 1)
    # all windows of a string that counts as many
    found = (many[:, None] > 0) & (offsets >= slack - right[:, None]) & (offsets <= left[:, None])
    # others are compared with those of their core
    of = np.repeat(np.arange(len(cores)), sizes)
    open_ = np.flatnonzero(((sizes > 1) & (np.add.reduceat(1 - many, cores) > 0))[of])
    m = len(open_)
    if not m:
        return found
    many, right, left, of = many[open_], right[open_], left[open_], of[open_]
    shared = np.where(new[open_], -1, np.minimum(shared[open_], right))
    shared[1:] = np.minimum(shared[1:], right[:-1])
    lefts = []  # of each the core's number, then its left bytes, nearest first
    for k, r, w, c in zip(open_.tolist(), right.tolist(), left.tolist(), of.tolist(), strict=True):
        s = entries[k][0]
        lefts.append(c.to_bytes(4) + s[9 + r : 9 + r + w][::-1])
    order = sorted(range(m), key=lefts.__getitem__)
    by_left = [lefts[k] for k in order]
    shared_left = np.array([-1, *(common(a, b, 0) - 4 for a, b in zip(by_left, by_left[1:], strict=False))])
    order = np.array(order)
    left_class = np.empty(m, np.int64)
    for o in range(slack + 1):
        need = slack - o  # bytes behind the core that the window takes
        valid = np.flatnonzero((right >= need) & (left >= o))
        if not len(valid):
            continue
        right_class = np.cumsum(shared < need) if need else np.cumsum(shared < 0)
        left_class[order] = np.cumsum(shared_left < o) if o else np.cumsum(shared_left < 0)
        key = right_class[valid] * (m + 1) + left_class[valid]
        by = np.argsort(key)
        first = np.flatnonzero(np.diff(key[by], prepend=-1))
        count = np.add.reduceat(1 + many[valid][by], first)
        found[open_[valid[by]], o] = np.repeat(count > 1, np.diff(np.append(first, len(by))))
    return found


def runs_of(offsets):
    """Runs of sorted offsets, bound by ``let``, as (low, high)."""
    low = F.filter(offsets, lambda o, i: (i == 0) | (F.get(offsets, i - 1) < o - 1))
    high = F.filter(offsets, lambda o, i: (i == F.size(offsets) - 1) | (F.get(offsets, i + 1) > o + 1))
    return F.zip_with(low, high, lambda a, b: F.struct(a.alias("low"), b.alias("high")))


#: Runs of repeated offsets of a context that ``n`` suffixes have.
SPANS = "core long, context long, n long, low int, high int"
#: What stands at the end of a sorted string; before it, ``n``.
TRAILER = [("many", "u1"), ("context", "<i8"), ("right", "<u2"), ("left", "<u2")]


def as_strings(texts, reps, core: int, parts: int):
    """Of a batch of texts and the kept suffixes that stand for contexts (core, context, n, hot, place, odd) the strings:
    parts and strings to be merged, and rows (core, context, n, step, tail, before) of hot cores, whose windows lie
    ``step`` letters apart."""
    import numpy as np

    flat = reps.flatten()
    of = {name: flat.field(k).to_numpy(zero_copy_only=False) for k, name in enumerate(x.name for x in flat.type)}
    counts = np.diff(reps.offsets.to_numpy())
    place = of["place"]
    pos, left, right = place >> 24, (place >> 12) & 4095, place & 4095
    trailer = np.zeros(len(place), [("n", "<i8"), *TRAILER])
    trailer["n"], trailer["many"], trailer["context"], trailer["right"], trailer["left"] = of["n"], of["n"] > 1, of["context"], right - core, left
    key = of["core"].view(np.uint64) * np.uint64(SPREAD)  # ranges of these are ranges of strings
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).tolist()
    heads, ends = key.astype(">u8").tobytes(), trailer.tobytes()
    hot, odd, size = of["hot"].tolist(), of["odd"].tolist(), trailer.dtype.itemsize
    low, mid, high = (pos - left).tolist(), pos.tolist(), (pos + right).tolist()
    run, rows, k = [], [], 0
    for row, count in enumerate(counts.tolist()):
        if not count:
            continue
        own, marks = texts[row].as_py().encode(), None
        for k in range(k, k + count):
            raw = own
            if odd[k]:
                if marks is None:
                    marks = word_marks(texts.slice(row, 1))[0].tobytes()
                raw = marks
            p = mid[k]
            tail, before = raw[p + core : high[k]], raw[low[k] : p]
            if hot[k]:
                rows.append((int(of["core"][k]), int(of["context"][k]), int(of["n"][k]), MARK if odd[k] else 1, tail, before))
            else:
                run.append((part[k], b"".join((heads[8 * k : 8 * k + 8], tail, END, before, ends[size * k : size * k + size]))))
        k += 1
    return run, rows


RUNS = "part int, run binary, core long, context long, n long, step int, tail binary, before binary"


def make_runs(docs: DataFrame, core: int, parts: int) -> DataFrame:
    """Sorted, front-coded runs of the strings of (text, row_key, reps), one for each part; strings of hot cores as rows."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("part", pa.int32()), ("run", pa.binary()), *[(x, pa.int64()) for x in ("core", "context", "n")], ("step", pa.int32()), ("tail", pa.binary()), ("before", pa.binary())])
        held: dict[int, list[bytes]] = {}
        size, last = 0, None

        def coded() -> Iterator:
            found, total = [], 0
            for part, run in held.items():
                run.sort()
                found.append((part, front_code(run)))
                run.clear()
                total += len(found[-1][1])
                if total > 8 << 20:
                    yield batch_of(found)
                    found, total = [], 0
            if found:
                yield batch_of(found)
            held.clear()

        def batch_of(found):
            none = [pa.nulls(len(found), f.type) for f in list(kinds)[2:]]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary()), *none], schema=kinds)

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                keys = batch.column(1).to_numpy(zero_copy_only=False)
                # repeated rows lie together; one of them gives the strings
                fresh = np.flatnonzero(keys != np.concatenate([[~keys[0] if last is None else last], keys[:-1]]))
                last = keys[-1]
                batch = batch.take(pa.array(fresh))
                if not batch.num_rows:
                    continue
                run, rows = as_strings(batch.column(0), batch.column(2), core, parts)
                for part, s in run:
                    held.setdefault(part, []).append(s)
                    size += len(s)
                for k in range(0, len(rows), 20_000):
                    some = list(zip(*rows[k : k + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(some[0]), f.type) for f in list(kinds)[:2]] + [pa.array(x, f.type) for x, f in zip(some, list(kinds)[2:], strict=True)], schema=kinds)
                if size > 64 << 20:  # a run fits in memory
                    yield from coded()
                    size = 0
        yield from coded()

    return docs.select("text", "row_key", "reps").mapInArrow(lean(run), RUNS)


def by_merge(runs: DataFrame, width: int, core: int, parts: int) -> DataFrame:
    """Repeated offsets of mixed cores by front-coded runs and loser trees."""

    def merge(key, runs):
        import numpy as np
        import pandas as pd

        made: list[list] = [[], [], [], [], []]
        group: list[tuple[bytes, int]] = []

        def settle() -> None:
            if group:
                found = np.zeros((len(group), width - core + 3), np.int8)
                found[:, 1:-1] = repeated_offsets(group, width, core)
                edge = np.diff(found, axis=1)
                row, low = np.nonzero(edge > 0)
                high = np.nonzero(edge < 0)[1] - 1
                end = np.frombuffer(b"".join([s[-21:] for s, _ in group]), [("n", "<i8"), *TRAILER])[row]
                own = np.frombuffer(b"".join([s[:8] for s, _ in group]), ">u8")[row].astype(np.uint64) * np.uint64(UNSPREAD)
                for column, values in zip(made, (own.view(np.int64), end["context"], end["n"], low, high), strict=True):
                    column.append(values)
            group.clear()

        last = None
        for s, shared in LoserTree([decode_front(r) for r in runs.run]):
            if s == last:  # of a repeated row
                continue
            last = s
            if shared < 8 and len(group) > 8192:  # whole cores only
                settle()
            group.append((s, shared))
        settle()
        release()
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
        return pd.DataFrame({name: np.concatenate([np.zeros(0, kind), *x]).astype(kind) for name, kind, x in zip(("core", "context", "n", "low", "high"), kinds, made, strict=True)})

    return runs.select("part", "run").repartition(parts, "part").groupBy("part").applyInPandas(merge, SPANS)


def by_windows(strings: DataFrame, width: int, core: int) -> DataFrame:
    """The same for hot cores: fingerprints of their windows are counted."""
    slack = width - core

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for h, c, n, step, tail, left in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names), strict=True):
                for o in range(max(0, slack - len(tail)), len(left) + 1, step):
                    window = left[len(left) - o :] + tail[: slack - o]
                    rows.append({"core": h, "context": c, "n": n, "step": step, "o": o, "w": hashlib.blake2b(window, digest_size=16).digest()})
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    import pyarrow as pa

    names = ["core", "context", "n", "step", "tail", "before"]
    kinds = pa.schema([("core", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("step", pa.int32()), ("o", pa.int32()), ("w", pa.binary())])
    windows = strings.select(*names).mapInArrow(lean(run), "core long, context long, n long, step int, o int, w binary")
    shared = materialise(windows.groupBy("core", "o", "w").agg(F.sum("n").alias("n")).filter("n > 1"), "suffix-windows")
    found = salted_join(windows.withColumnRenamed("n", "own"), shared, ["core", "o", "w"], ["context"])
    steps = found.groupBy("core", "context").agg(F.first("own").alias("n"), F.first("step").alias("step"), F.collect_set((F.col("o") / F.col("step")).cast("int")).alias("o"))
    spans = steps.withColumn("spans", let(F.array_sort("o"), runs_of))
    return spans.select("core", "context", "n", "step", F.inline("spans")).select("core", "context", "n", *[(F.col(x) * F.col("step")).alias(x) for x in ("low", "high")])


def with_side(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Joins a stored table by row. It grows with the texts, so both sides are shuffled at any size."""
    return docs.join(side.hint("shuffle_merge"), ["doc_id", "row_key"], how)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``row_key``, an even hash of id and text, by which rows without an id are told apart as well; their
    ``doc_id`` becomes 0 here."""
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    return docs.withColumn("row_key", key).withColumn("row_key", _even()).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))


def united(covers: DataFrame) -> DataFrame:
    """The ranges (doc_id, row_key, odd, start, end), joined where they meet: shuffled and sorted by row, then read once."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rest = [np.zeros(0, np.int64)] * 5  # the range that the next batch may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, key, odd, start, end = (np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, batch.columns, strict=True))
            row = np.ones(len(doc), bool)
            row[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (odd[1:] != odd[:-1])
            reach = np.maximum.accumulate((np.cumsum(row) << 33) + end) & ((1 << 33) - 1)  # of the row's ranges so far
            new = row.copy()
            new[1:] |= start[1:] > reach[:-1]
            first = np.flatnonzero(new)
            found = [doc[first], key[first], odd[first], start[first], reach[np.append(first[1:], len(doc)) - 1]]
            rest = [x[-1:] for x in found]
            if len(first) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in found], names=names)
        if len(rest[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rest], names=names)

    names = ["doc_id", "row_key", "odd", "start", "end"]
    ordered = covers.select(*names).repartition("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key", "odd", "start")
    return ordered.mapInArrow(lean(run), ", ".join(f"{x} long" for x in names))


def repeated_intervals(docs: DataFrame, width: int = WIDTH, core: int = CORE, hot: int = HOT, words: bool = False) -> DataFrame:
    """(doc_id, row_key, intervals) of (doc_id, text, row_key): byte ranges to remove, apart from each other; with
    ``words`` also ``passages``, the same ranges of the texts' marks."""
    cores = materialise(samples(docs, width, core, words, cores_only=True).groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-cores")
    shared = materialise(salted_join(samples(docs, width, core, words), cores, ["core"], ["doc_id", "row_key", "place"]), "suffix-shared")
    discard(cores)
    contexts = materialise(shared.groupBy("core", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_key", "place")).alias("rep")), "suffix-contexts")
    # at most one core for each `hot` contexts, so they can be broadcast
    many = materialise(contexts.groupBy("core").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("core", F.lit(True).alias("hot")), "suffix-hot")
    wanted = contexts.join(F.broadcast(many), "core", "left").select("core", "context", "n", F.coalesce("hot", F.lit(False)).alias("hot"), "rep.*")
    odd = F.col("row_key").bitwiseAND(F.lit(1)) == 1
    wanted = wanted.withColumn("odd", odd).withColumn("row_key", _even())
    by_row = materialise(wanted.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("core", "context", "n", "hot", "place", "odd")).alias("reps")), "suffix-reps")
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-contexts.count() // MERGED))
    runs = materialise(make_runs(with_side(docs, by_row, "inner"), core, parts), "suffix-runs")
    for stored in (contexts, many, by_row):
        discard(stored)
    spans = by_merge(runs.filter("part is not null"), width, core, parts).unionByName(by_windows(runs.filter("part is null"), width, core))
    judged = materialise(spans, "suffix-judged")
    discard(runs)
    found = salted_join(shared, judged, ["core", "context"], ["doc_id", "row_key", "place"])
    # windows from pos - high to pos - low, each of `width` bytes, cover one interval
    pos = F.shiftright("place", 24)
    covers = found.select("doc_id", _even().alias("row_key"), odd.cast("long").alias("odd"), (pos - F.col("high")).alias("start"), (pos - F.col("low") + width).alias("end"))
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    of = lambda kind, name: F.array_sort(F.collect_list(F.when(F.col("odd") == kind, span))).alias(name)
    return united(covers).groupBy("doc_id", "row_key").agg(of(0, "intervals"), *([of(1, "passages")] if words else []))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def words_cut(raw: bytes, marked) -> list[tuple[int, int]]:
    """Byte ranges of the passages whose marks are given: from a first word to a last one."""
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    whole = ((-(-start // MARK), end // MARK) for start, end in merged(marked))
    return [(words[a][0], words[b - 1][1]) for a, b in whole if a < b]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside merged spans."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at:start])
        at = end
    return b"".join([*kept, raw[at:]])


def dedup(docs: DataFrame, width: int = WIDTH, core: int = CORE, hot: int = HOT, passages: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, n_cut, text) of (doc_id, text): the kept bytes, and as text what is
    left without the signs that a cut goes through. With ``passages`` the text, and ``n_cut``, the bytes that went from
    it, are also without passages of ``width // MARK`` words or more that stand elsewhere, whatever their bytes."""
    docs = keyed(docs.select(F.col("doc_id").alias("own_id"), "doc_id", "text"))
    least = min(width, 2 * (width // MARK) - 1) if passages else width
    narrow = docs.filter(F.octet_length("text") >= least).select("doc_id", "text", "row_key")
    intervals = materialise(repeated_intervals(narrow, width, core, hot, passages), "suffix-intervals")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("n_cut", pa.int64()), ("text", pa.string())])
        ends = lambda spans: [(s["start"], s["end"]) for s in spans or ()]
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                rows = []
                for doc_id, text, found, marked in zip(*(whole.column(i).slice(k, 512).to_pylist() for i in range(4)), strict=True):
                    raw = (text or "").encode()
                    spans = merged(ends(found))
                    left = without(raw, spans)
                    rest = without(raw, merged(spans + words_cut(raw, ends(marked)))) if marked else left
                    rows.append({"doc_id": doc_id, "n_bytes": len(raw), "n_removed": len(raw) - len(left), "n_spans": len(spans), "kept": left, "n_cut": len(raw) - len(rest), "text": None if text is None else rest.decode("utf-8", "ignore")})
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    marked = F.col("passages") if passages else F.lit(None).cast("array<struct<start int, end int>>")
    joined = with_side(docs, intervals, "left").select(F.col("own_id").cast("long").alias("doc_id"), "text", "intervals", marked.alias("passages"))
    return joined.mapInArrow(lean(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_cut long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    out = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), passages=True)
    # the digests are of strings of WIDTH bytes alone; beside them, the real output: the text that is left when passages
    # of 50 words or more go as well, and whether anything went
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_cut") > 0).cast("int").alias("cut"), "n_cut", "text")

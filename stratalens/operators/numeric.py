"""Numeric models over an explicit row order: extrapolation, confidence, cross-column copies.

Rows need a unique order key within a field; in extrapolation a repeated one is an error. The hit counter has 256 states,
so a stretch of a field's history acts as a map of 256 bytes, whatever came before it. Histories are cut
into stretches by ranges of the order, each stretch becomes such a map in constant memory, and the maps of
a field are composed: a field that holds most rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The cap of a hit counter and the least confidence of a cross-column prediction.
CAP, LEAST_CROSS = 255, 2


def with_prediction(df: DataFrame, field: str, order: str, value: str) -> DataFrame:
    """Adds ``pred`` (last + delta) and ``hit``; untracked (null) values are skipped, not breaks."""
    w = Window.partitionBy(field).orderBy(order)
    p1, p2 = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    pred = F.when(p1.isNull(), None).when(p2.isNull(), p1).otherwise(2 * p1 - p2)
    return df.filter(F.col(value).isNotNull()).withColumn("pred", pred).withColumn("hit", F.col(value) == F.col("pred"))


class Stretch:
    """A stretch of one field's values: the ends of the values, and what its hits do to each counter."""

    def __init__(self):
        import numpy as np

        self.n = self.hits = 0
        self.first: list[int] = []
        self.last: list[int] = []
        self.states = np.arange(CAP + 1)

    def add(self, values) -> None:
        import numpy as np

        self.first += [int(v) for v in values[: 2 - len(self.first)]]
        known = np.concatenate([np.array(self.last, np.int64), values])
        if len(known) > 2:  # those that have two values before them in the stretch
            hit = known[2:] == 2 * known[1:-1] - known[:-2]
            self.hits += int(hit.sum())
            edge = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1], [True]]))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                self.states = np.minimum(self.states + (b - a), CAP) if hit[a] else self.states >> min(int(b - a), 8)
        self.n += len(values)
        self.last = [int(v) for v in known[-2:]]


def follow(n: int, hits: int, counter: int, known: list[int], stretch) -> tuple[int, int, int, list[int]]:
    """Values, hits, counter and the last values of a field behind a stretch (n, hits, first, last, states), from
    those before it."""
    for v in stretch.first:
        hit = bool(known) and v == (known[-1] if len(known) == 1 else 2 * known[-1] - known[-2])
        if known:
            hits, counter = hits + hit, min(counter + 1, CAP) if hit else counter // 2
        known = [*known[-1:], int(v)]
    known = [int(v) for v in stretch.last] if stretch.n > 1 else known
    return n + int(stretch.n), hits + int(stretch.hits), int(stretch.states[counter]), known


STRETCHES = "field string, part int, n long, hits long, first array<long>, last array<long>, states binary"


def extrapolation(df: DataFrame, field: str, order: str, value: str) -> DataFrame:
    """(field, n_values, n_hits, final_hits): values, those that ``last + delta`` predicts, and the final counter.

    Null values are untracked: they are skipped, and no break. Equal order keys within a field are an error.
    """
    kind = df.schema[field].dataType
    rows = df.filter(F.col(value).isNotNull()).select(F.col(field).cast("string").alias("field"), F.col(order).alias("o"), F.col(value).cast("long").alias("v"))
    dealt = rows.repartitionByRange("field", "o").sortWithinPartitions("field", "o").select("field", "v", (F.xxhash64("o")).alias("h"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, done, own, stretch, before = TaskContext.get().partitionId(), [], None, None, None

        def close() -> None:
            done.append((own, part, stretch.n, stretch.hits, stretch.first, stretch.last, stretch.states.astype(np.uint8).tobytes()))

        for batch in batches:
            fields, v, h = batch.column(0).dictionary_encode(null_encoding="encode"), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            names, codes = fields.dictionary.to_pylist(), fields.indices.to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]])) if len(codes) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if stretch is None or names[codes[a]] != own:
                    if stretch is not None:
                        close()
                    own, stretch, before = names[codes[a]], Stretch(), None
                keys = h[a:b] if before is None else np.concatenate([[before], h[a:b]])
                if (keys[1:] == keys[:-1]).any():
                    raise ValueError(f"equal order keys in field {own!r}")
                before = h[b - 1]
                stretch.add(v[a:b])
        if stretch is not None:
            close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 7
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in STRETCHES.split(", ")])

    def settle(key, stretches):
        import pandas as pd

        n, hits, counter, known = 0, 0, 0, []
        for stretch in stretches.sort_values("part").itertuples():
            n, hits, counter, known = follow(n, hits, counter, known, stretch)
        return pd.DataFrame({"field": [key[0]], "n_values": [n], "n_hits": [hits], "final_hits": [counter]})

    # a field has one stretch in a partition at most, so groups are as small as there are partitions
    out = dealt.mapInArrow(run, STRETCHES).groupBy("field").applyInPandas(settle, "field string, n_values long, n_hits long, final_hits long")
    return out.select(F.col("field").cast(kind).alias(field), "n_values", "n_hits", "final_hits")


def confidence(count: Column) -> Column:
    """12-bit probability that grows with the number of confirmations."""
    return (2048 + F.floor(2047 * count / (count + 1))).cast("bigint")


def digit_prefix(df: DataFrame, field: str, order: str, value: str) -> DataFrame:
    """How many digits of a value its prediction gets right before the first wrong one."""
    p = with_prediction(df.select(field, order, value), field, order, value).filter(F.col("pred").isNotNull())
    a, b = F.col(value).cast("string"), F.col("pred").cast("string")
    n = F.least(F.length(a), F.length(b))
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    right = F.size(F.filter(places, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return p.select(field, order, F.col(value).alias("value"), "pred", right.cast("bigint").alias("digits_right"))


class CrossStretch:
    """A stretch of a column's history as a map of the state (source, offset, hits) before it.

    A row sets the state where the state before does not fit it, unless all columns to the left are null or
    unequal there: such a row halves the hits. Of the states before a stretch only those whose source and offset
    fit one of its first eight rows, or one up to the first that sets a state, can gain a hit before their hits
    are gone: these are followed for each count of hits, all others at once. States that become equal are followed
    as one; hits meet at the cap, at halvings and at rows that set a state.
    """

    HEAD = 8  # halvings after which no hits are left

    def __init__(self, column: int):
        self.column, self.n, self.head, self.waiting, self.live = column, 0, [], True, None

    def sets(self, row: tuple) -> tuple[int, int, int] | None:
        """The state behind a row that the state before does not fit; None where half its hits stay."""
        for i in range(self.column):
            if row[i] == row[-1]:
                return i, 0, 1
        if not self.column or row[self.column - 1] is None:
            return None
        return self.column - 1, row[-1] - row[self.column - 1], 1

    def step(self, state: tuple[int, int, int], row: tuple) -> tuple[int, int, int]:
        src, off, hits = state
        if hits and src >= 0 and row[src] is not None and row[src] + off == row[-1]:
            return src, off, hits + 1 if hits < CAP else CAP
        return self.sets(row) or (src, off, hits >> 1)

    def add(self, row: tuple) -> None:
        """Takes a row: the columns to the left, then the column's own value, which is not null."""
        self.n += 1
        if self.live is not None:
            self._move(row)
            return
        self.head.append(row)
        if len(self.head) == self.HEAD or self.sets(row):
            self._start()

    def _start(self) -> None:
        pairs = dict.fromkeys((i, row[-1] - row[i]) for row in self.head for i in range(self.column) if row[i] is not None)
        self.live = {(*p, hits): [(*p, hits)] for p in pairs for hits in range(CAP + 1)}
        for row in self.head:
            self._move(row)

    def _move(self, row: tuple) -> None:
        if len(self.live) == 1 and not self.waiting:
            ((state, own),) = self.live.items()
            self.live = {self.step(state, row): own}
            return
        moved: dict[tuple, list] = {}
        for state, own in self.live.items():
            to = self.step(state, row)
            moved[to] = moved[to] + own if to in moved else own
        if self.waiting and (to := self.sets(row)):  # all states that fit none of the rows until here
            self.waiting = False
            moved[to] = [*moved.get(to, []), None]
        self.live = moved

    def ends(self) -> tuple[int, dict]:
        """Rows, and the state behind the stretch by the one before it; None stands for all others, and where it
        is absent, a row halves their hits."""
        if self.live is None:
            self._start()
        return self.n, {before: state for state, own in self.live.items() for before in own}


def follow_cross(state: tuple[int, int, int], n: int, ends: dict) -> tuple[int, int, int]:
    """The state behind a stretch from the one before it."""
    return ends.get(state) or ends.get(None) or (*state[:2], state[2] >> min(n, CrossStretch.HEAD))


def cross_column(df: DataFrame, field: str, order: list[str], columns: list[str], column: int) -> DataFrame:
    """(field, source, offset_value, hits): of each field, the folded state of one column of a row from the columns
    to its left. Histories are cut into stretches like those of ``extrapolation``; equal order keys are in order
    of their values."""
    kind = df.schema[field].dataType
    whole = {c: df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in columns}
    values = {c if whole[c] else f"_v{i}": F.col(c).cast("long") for i, c in enumerate(columns[: column + 1])}
    rows = df.select(field, *dict.fromkeys([*order, *(c for c in columns[: column + 1] if whole[c])]), *(v.alias(name) for name, v in values.items() if name not in columns))
    dealt = rows.repartitionByRange(field, *order).sortWithinPartitions(field, *order, *values)
    dealt = dealt.select(F.col(field).cast("string"), *(F.col(name).cast("long") for name in values))

    def run(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa
        from pyspark import TaskContext

        part, done, own, stretch = TaskContext.get().partitionId(), [], None, None
        for batch in batches:
            for name, *row in zip(*(batch.column(i).to_pylist() for i in range(column + 2)), strict=True):
                if stretch is None or name != own:
                    if stretch is not None:
                        done.append((own, part, pickle.dumps(stretch.ends())))
                    own, stretch = name, CrossStretch(column)
                if row[-1] is not None:
                    stretch.add(row)
        if stretch is not None:
            done.append((own, part, pickle.dumps(stretch.ends())))
        columns = list(zip(*done, strict=True)) if done else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.binary()], strict=True)], names=["field", "part", "ends"])

    def settle(key, stretches):
        import pickle

        import pandas as pd

        state = (-1, 0, 0)
        for packed in stretches.sort_values("part")["ends"]:
            n, ends = pickle.loads(packed)
            state = follow_cross(state, n, ends)
        return pd.DataFrame({"field": [key[0]], "source": [state[0]], "offset_value": [state[1]], "hits": [state[2]]})

    out = dealt.mapInArrow(run, "field string, part int, ends binary").groupBy("field").applyInPandas(settle, "field string, source long, offset_value long, hits long")
    return out.select(F.col("field").cast(kind).alias(field), "source", "offset_value", "hits")


def choice(hits: Column, cross_hits: Column, seen: Column) -> Column:
    """Which hypothesis predicts: ties go to extrapolation."""
    return F.when((cross_hits >= LEAST_CROSS) & (~seen | (cross_hits > hits)), "cross").when(seen, "extrapolate").otherwise("none")

"""N-gram Jaccard join with a count-vector R-tree.

A document is its set of word shingles. Tokens (shingle fingerprints) are hashed into groups; the
group counts are a point, and the sum of coordinate minima of two points bounds the overlap of their
sets from above. A point has a group for every ``LOAD`` tokens, rounded up to a power of two, so it bounds
large sets as well as small ones; the larger of two points is folded onto the smaller.
R-trees over the points find the pairs whose bound reaches what the Jaccard threshold needs, and
surviving pairs are verified on the sets themselves.

Which documents share a tree follows from the prefix principle, so no pair is lost: in one order
of all tokens (frequent ones, as counted over all documents, come last, the others by fingerprint), two
similar sets share a token among their first ``n - needed + 1``. Each such token is a block. Tokens
share counters, so a rare one may come last too; any order gives the same links.

1. Equal sets collapse to one node (pre-aggregated), which links their documents.
2. Of each block the smallest node is the centre; all others are tested against it: size, bound, then
   verification. These stars connect most of a large group by linear work.
3. Blocks that still hold several components are indexed by R-trees, which give the pairs across
   components; the largest component of a block and the others are cut into bounded parts that
   meet two by two, so a hot block is many tasks, and pairs within a component, which change
   nothing, are never made.

Defined cases: null or wordless text has an empty set and no link; fewer words than a shingle are
one shingle; repeated rows and rows of one id are rows of their own, linked by their texts alone; a
component is named by its smallest id, so rows without an id never name one while another row of it
has an id (else the name is null); an empty table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialise, release, salted_join, stored_step
from .components import components

#: Tokens for each group of a point, at most, and the least and the most groups: powers of two.
LOAD, LEAST_GROUPS, MOST_GROUPS = 4, 512, 8192
#: Groups left when those of a point are folded for the R-tree: no more than ``LEAST_GROUPS``.
COARSE = 128
#: Documents, about, of a block's largest component, or of its others, that meet in one R-tree.
CHUNK = 2000
#: Tokens that at least so many of so many documents share are frequent, if ``LEAST`` documents share them.
FREQUENT, LEAST = (3, 5000), 3
#: Counters of tokens, and those that are summed together: powers of two. All rare tokens of a corpus add to a
#: counter a small part of what is frequent, at any size.
COUNTERS, SUMMED = 1 << 22, 1 << 14
#: Children of an R-tree node.
FANOUT = 8
#: Bytes of points that are compared at once, and rows whose R-trees are built together, about.
AT_ONCE, GATHERED = 8 << 20, 16384


class Threshold:
    """A Jaccard threshold as percent, in integers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, size: int) -> int:
        """Tokens among which a set of ``size`` shares one with every similar set."""
        return size - -(-self.percent * size // 100) + 1

    def needed(self, a, b):
        """The least overlap of similar sets of these sizes; works on arrays."""
        return -(-(self.percent * (a + b)) // (100 + self.percent))


def shingle_sets(data, offsets, words: int):
    """For each text of a batch its sorted distinct shingle fingerprints (uint64)."""
    import numpy as np

    from .bytehash import MIX1, MIX2, Prefix, mix

    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (lower == 32) | ((lower >= 9) & (lower <= 13))
    inside = ~space
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    prefix = Prefix(lower)
    w = prefix.of(starts, ends)
    first = np.searchsorted(starts, offsets)
    n = len(w)
    whole = np.zeros(n, np.uint64)
    if n >= words:
        for k in range(words):
            whole[: n - words + 1] += w[k : n - words + 1 + k] * np.uint64((int(MIX1) * (2 * k + 1) + int(MIX2)) % 2**64)
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mix(h * MIX2 + w[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def groups_of(sizes):
    """Groups of the points of sets of these sizes (an array)."""
    import numpy as np

    wanted = np.maximum(np.asarray(sizes, np.int64), 1) / LOAD
    return np.clip(2 ** np.ceil(np.log2(wanted)), LEAST_GROUPS, MOST_GROUPS).astype(np.int64)


def point_of(s) -> bytes:
    """The group counts of a set as bytes: one for each group, or four where a count needs them."""
    import numpy as np

    groups = int(groups_of(len(s)))
    counts = np.bincount((s >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def folded(points: list[bytes], sizes, groups: int):
    """The matrix of the points of sets of these sizes, folded to ``groups`` groups."""
    import numpy as np

    own = groups_of(sizes)
    kind = own * 2 + (np.array([len(p) for p in points]) == own)
    out = np.empty((len(points), groups), np.uint32)
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        counts = np.frombuffer(b"".join([points[i] for i in at]), "u1" if k & 1 else "<u4").reshape(len(at), -1, groups)
        if len(at) == len(points) and counts.shape[1] == 1:
            return counts[:, 0]
        out[at] = counts.sum(1, dtype=np.uint32)
    return out


def overlap_bounds(points: list[bytes], sizes, i, j):
    """For pairs of positions the sum of coordinate minima, in the groups of the smaller point."""
    import numpy as np

    level = np.minimum(groups_of(sizes)[i], groups_of(sizes)[j])
    out = np.zeros(len(i), np.int64)
    for groups in np.unique(level):
        at = np.flatnonzero(level == groups)
        for part in (at[k : k + AT_ONCE // int(groups) // 4] for k in range(0, len(at), AT_ONCE // int(groups) // 4)):
            rows, where = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
            table = folded([points[r] for r in rows], sizes[rows], int(groups))
            out[part] = np.minimum(table[where[: len(part)]], table[where[len(part) :]]).sum(1, dtype=np.int64)
    return out


def prefix_keys(s, size: int, frequent):
    """The first ``size`` tokens of a sorted set, with frequent ones (bits of their counters) last."""
    import numpy as np

    if not len(frequent):
        return s[:size]
    at = s & np.uint64(COUNTERS - 1)
    often = (frequent[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return np.concatenate([s[~often], s[often]])[:size]


def frequent_tokens(docs: DataFrame, words: int):
    """A bit for each of ``COUNTERS`` counters, by a token's last bits: set where the documents that hold its tokens
    are as many as ``FREQUENT`` says. All tokens of all documents are counted; empty where there are none."""
    import numpy as np

    least = max(LEAST, -(-docs.count() * FREQUENT[0] // FREQUENT[1]))
    kinds = "chunk int, counts binary"

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .bytehash import bytes_of, slices

        held = np.zeros(COUNTERS, np.uint32)
        for whole in batches:
            for batch in slices(whole, 0):
                for s in shingle_sets(*bytes_of(batch.column(0)), words):
                    np.add.at(held, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        for k in range(0, COUNTERS, SUMMED):
            at = np.flatnonzero(held[k : k + SUMMED])
            if len(at):
                packed = at.astype("<u2").tobytes() + held[k + at].astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k // SUMMED], pa.int32()), pa.array([packed], pa.binary())], names=["chunk", "counts"])

    def total(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for chunk, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(packed) // 6
                sums.setdefault(chunk, np.zeros(SUMMED, np.int64))[np.frombuffer(packed, "<u2", n)] += np.frombuffer(packed, "<u4", n, 2 * n)
        for chunk, sum_of in sums.items():
            flags = np.packbits(sum_of >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([flags], pa.binary())], names=["chunk", "counts"])

    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with stored_step(docs.sparkSession):
        rows = docs.select("text").mapInArrow(lean(count), kinds).repartition(parts, "chunk").mapInArrow(lean(total), kinds).collect()
    out = np.zeros((COUNTERS // SUMMED, SUMMED // 8) if rows else 0, np.uint8)
    for chunk, flags in rows:
        out[chunk] = np.frombuffer(flags, np.uint8)
    return out.reshape(-1)


SKETCH = "doc_id long, row_key long, n long, h1 long, h2 long, point binary, keys binary"


def fingerprints(sets):
    """Two fingerprints of each set."""
    import numpy as np

    from .bytehash import mix

    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return one, np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)


def sketches(docs: DataFrame, words: int, limit: Threshold, frequent) -> DataFrame:
    """Of each document: set size, two fingerprints of the set, its point, and its block keys."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .bytehash import bytes_of, slices

        for whole in batches:
            for batch in slices(whole, 1):
                sets = shingle_sets(*bytes_of(batch.column(1)), words)
                keys = [prefix_keys(s, limit.prefix(len(s)), frequent).tobytes() if len(s) else b"" for s in sets]
                made = [pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, fingerprints(sets)), pa.array(map(point_of, sets), pa.binary()), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["doc_id", "row_key", "n", "h1", "h2", "point", "keys"])

    return docs.select("doc_id", "text", "row_key").mapInArrow(lean(run), SKETCH)


def unpacked(reps: DataFrame) -> DataFrame:
    """(key, node, size) from packed keys."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                packed = batch.column(2).to_pylist()
                many = [len(p) // 8 for p in packed]
                node, size = (np.repeat(batch.column(i).to_numpy(), many) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(node), pa.array(size)], names=["key", "node", "size"])

    return reps.select("node", "n", "keys").mapInArrow(lean(run), "key long, node long, size long")


class RForest:
    """R-trees over the points of blocks, one for each group, packed: neighbours in size and in the most
    spread coordinates share a node; a node has the largest value of each coordinate and the sizes below
    it. ``groups`` ascend. All trees are built and searched level by level together."""

    def __init__(self, counts, sizes, groups):
        import numpy as np

        self.counts, self.sizes, self.groups = counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32), sizes, groups
        spread = np.argsort(-self.counts.var(0))[:3] if len(counts) else []
        alike = (np.log(np.maximum(sizes, 1)) * 8).astype(np.int64)
        self.order = np.lexsort([*[self.counts[:, d] for d in spread], alike, groups])
        own = groups[self.order]
        self.levels = [(self.counts[self.order], sizes[self.order], sizes[self.order], None)]
        while len(starts := np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])) < len(own):
            place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
            cut = np.flatnonzero(place % FANOUT == 0)
            top, low, high, _ = self.levels[-1]
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.append(cut, len(own))))
            own = own[cut]
        self.roots = own

    def search(self, rows, limit: Threshold):
        """Pairs (i, j) of each of ``rows`` and the members of its group whose bound on the overlap reaches
        what similarity needs."""
        import numpy as np

        found = [self._search(rows[k : k + 256], limit) for k in range(0, len(rows), 256)]
        return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))

    def _search(self, i, limit: Threshold):
        import numpy as np

        node = np.searchsorted(self.roots, self.groups[i])
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, first = self.levels[depth]
            size = self.sizes[i]
            nearest = np.clip(size, low[node], high[node])  # no member is closer in size
            keep = np.flatnonzero((nearest * 100 >= limit.percent * size) & (size * 100 >= limit.percent * nearest))
            i, node, size = i[keep], node[keep], size[keep]
            least = limit.needed(size, np.maximum(low[node], -(-limit.percent * size // 100)))
            step = AT_ONCE // 4 // top.shape[1]
            bound = [np.minimum(top[node[k : k + step]], self.counts[i[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step)]
            good = np.concatenate(bound or [np.zeros(0, np.int64)]) >= least
            i, node = i[good], node[good]
            if depth:
                many = first[node + 1] - first[node]
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                i, node = np.repeat(i, many), np.repeat(first[node], many) + within
        return i, self.order[node]


def bounded(pairs: DataFrame, reps: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs (a, b) whose points allow enough overlap."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"p_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for t in (whole.slice(k, 8192) for whole in batches for k in range(0, whole.num_rows, 8192)):
            col = lambda c: t.column(t.schema.get_field_index(c))  # noqa: B023, E731
            sizes, first = np.concatenate([col("n_a").to_numpy(), col("n_b").to_numpy()]), np.arange(t.num_rows)
            bound = overlap_bounds(col("p_a").to_pylist() + col("p_b").to_pylist(), sizes, first, first + t.num_rows)
            keep = pa.array(bound >= limit.needed(sizes[first], sizes[first + t.num_rows]))
            yield pa.RecordBatch.from_arrays([col("a").filter(keep), col("b").filter(keep)], names=["a", "b"])

    return sized.mapInArrow(lean(run), "a long, b long")


def set_values(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, value) of the nodes in ``pairs``: the bytes of their sets, read from one of their texts."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct()
    wanted = nodes.join(reps.select("node", "rep_key", "n", "h1", "h2"), "node").withColumnRenamed("rep_key", "row_key")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .bytehash import bytes_of, slices

        last = None  # repeated rows lie together
        for whole in batches:
            for batch in slices(whole, 0):
                sets = shingle_sets(*bytes_of(batch.column(0)), words)
                one, two = fingerprints(sets)
                node, n, h1, h2 = (batch.column(i).to_numpy() for i in range(1, 5))
                own = (one == h1) & (two == h2) & (np.array([len(s) for s in sets]) == n)
                own &= node != np.concatenate([[node[0] - 1 if last is None else last], node[:-1]])
                last = node[-1]
                keep = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["node", "value"])

    found = docs.join(wanted.hint("shuffle_merge"), "row_key").select("text", "node", "n", "h1", "h2")
    return materialise(found.mapInArrow(lean(run), "node long, value binary"), "set-values")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, limit: Threshold) -> DataFrame:
    """Stored pairs of nodes whose sets are similar enough, by the sets themselves."""
    values = set_values(pairs, reps, docs, words)
    side = lambda x: values.select(F.col("node").alias(x), F.col("value").alias(f"v_{x}"))

    def similar(x, y) -> bool:
        import numpy as np

        if len(x) > len(y):
            x, y = y, x
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
        return both > 0 and 100 * both >= limit.percent * (len(x) + len(y) - both)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                t = whole.slice(k, 256)
                read = lambda c: (np.frombuffer(x.as_buffer(), "<u8") for x in t.column(t.schema.get_field_index(c)))  # noqa: B023, E731
                keep = pa.array([similar(x, y) for x, y in zip(read("v_a"), read("v_b"), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([t.column(t.schema.get_field_index(c)).filter(keep) for c in ("a", "b")], names=["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    out = materialise(joined.mapInArrow(lean(run), "a long, b long").distinct(), "similar-pairs")
    discard(values)
    return out


def across(blocks: DataFrame, reps: DataFrame, limit: Threshold) -> DataFrame:
    """Candidate pairs across components, by R-trees over the blocks (key, node, component)."""
    sizes = blocks.groupBy("key", "component").count()
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("most"), (F.sum("count") - F.max("count")).alias("others"))
    parts_of = lambda c: F.greatest(F.ceil(F.col(c) / CHUNK), F.lit(1)).cast("int")
    placed = blocks.join(main, "key").withColumn("chunks", parts_of("most")).withColumn("buckets", parts_of("others")).withColumn("in_main", F.col("component") == F.col("main"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("chunks")).otherwise(F.col("buckets"))).cast("int"))
    # tasks of a block: each chunk of the largest component with each bucket of the others, then each two buckets
    count, every = F.col("buckets"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_others = F.transform(every("buckets"), lambda g: F.col("own") * count + g)
    with_main = F.transform(every("chunks"), lambda c: c * count + F.col("own"))
    two = F.transform(F.filter(every("buckets"), lambda g: g != F.col("own")), lambda g: (F.col("chunks") + F.least(g, F.col("own"))) * count + F.greatest(g, F.col("own")))
    placed = placed.withColumn("chunk", F.explode(F.when(F.col("in_main"), with_others).otherwise(F.concat(with_main, two))))
    placed = placed.withColumn("first", F.col("chunk") < count).withColumn("two", F.col("chunk") >= F.col("chunks") * count)
    placed = placed.join(reps.select("node", "n", "point"), "node").select("key", "chunk", "node", "component", "in_main", "own", "first", "two", "n", "point")

    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def settle(t):
            col = lambda c: t.column(c).to_numpy()
            points, sizes = t.column("point").to_pylist(), col("n")
            counts = folded(points, sizes, COARSE)
            node, comp, main, first = col("node"), col("component"), col("in_main"), col("first")
            own, two = col("own"), col("two")
            edge = np.flatnonzero(np.concatenate([[True], (col("key")[1:] != col("key")[:-1]) | (col("chunk")[1:] != col("chunk")[:-1]), [True]]))
            groups = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            # one side at least is outside the largest component
            i, j = RForest(counts, sizes, groups).search(np.flatnonzero(~main), limit)
            keep = main[j] | (node[j] < node[i])
            i, j = i[keep], j[keep]
            keep = (comp[i] != comp[j]) & (main[i] | main[j] | np.where(two[i], own[i] != own[j], first[i]))
            i, j = i[keep], j[keep]
            keep = overlap_bounds(points, sizes, i, j) >= limit.needed(sizes[i], sizes[j])  # finer than in the tree
            i, j = i[keep], j[keep]
            pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            last = held.slice(held.num_rows - 1)
            key, chunk = last.column("key")[0].as_py(), last.column("chunk")[0].as_py()
            own = (held.column("key").to_numpy() == key) & (held.column("chunk").to_numpy() == chunk)
            cut = int(np.argmax(own))  # rows are sorted: the last group begins here
            if cut >= GATHERED:
                yield settle(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
                release()
        if held is not None and held.num_rows:
            yield settle(held.combine_chunks())

    parts = max(8, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.repartition(parts, "key", "chunk").sortWithinPartitions("key", "chunk", "node")
    return dealt.mapInArrow(lean(search), "a long, b long").distinct()


def join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, row_key, n_shingles, set_id, component_id, first) of every row of (doc_id, text).

    ``row_key`` is a hash of id and text, ``set_id`` a number of the row's set (null: empty), and ``first``
    is true for one row of each component (and its repetitions) and for every row without a set.
    """
    limit = Threshold(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    made = materialise(sketches(docs, words, limit, frequent_tokens(docs, words)), "sketches")
    # a set has one point and the same keys wherever it occurs, so any row gives them
    rep = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_key"))
    classes = made.filter("n > 0").groupBy("n", "h1", "h2").agg(rep.alias("rep"), F.count("*").alias("copies"), F.any_value("point").alias("point"), F.any_value("keys").alias("keys"))
    # nodes are numbered in the order of their smallest ids, so that centres are the documents others were copied from, as far as ids tell
    order = ["rep.no_id", "rep.doc_id", "rep.row_key"]
    classes = classes.repartitionByRange(*order).sortWithinPartitions(*order)
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "n", "h1", "h2", F.col("rep.doc_id").alias("rep_id"), F.col("rep.row_key").alias("rep_key"), "copies", "point", "keys"), "set-classes")
    side = classes.select("node", F.col("n").alias("size"), "h1", "h2", F.col("copies").alias("n"))
    members = salted_join(made.filter("n > 0").select("doc_id", "row_key", F.col("n").alias("size"), "h1", "h2"), side, ["size", "h1", "h2"], ["doc_id", "row_key"]).select("doc_id", "row_key", F.col("size").alias("n"), "node")
    wordless = made.filter("n = 0").select("doc_id", "row_key", "n", F.lit(None).cast("long").alias("node"))
    members = materialise(members.unionByName(wordless), "set-members")
    discard(made)
    reps = classes.select("node", "n", "point")
    rows = unpacked(classes)
    centres = rows.groupBy("key").agg(F.min(F.struct("node", "size")).alias("centre"), F.count("*").alias("n")).filter("n > 1")
    centres = materialise(centres, "centres")
    blocks = materialise(salted_join(rows, centres, ["key"], ["node"]), "blocks")
    # sizes alone part many pairs, so points are sent for fewer
    alike = F.least("size", "centre.size") * 100 >= F.greatest("size", "centre.size") * percent
    stars = blocks.filter(F.col("node") != F.col("centre.node")).filter(alike).select(F.col("centre.node").alias("a"), F.col("node").alias("b"))
    stars = materialise(stars.distinct(), "stars")
    near = materialise(bounded(stars, reps, limit), "star-pairs")
    links = verified(near, classes, docs, words, limit)
    found = materialise(components(links), "components")
    named = blocks.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    named = materialise(named, "named-blocks")
    open_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low <> high").select("key", "n")
    open_blocks = materialise(salted_join(named, materialise(open_keys, "open-keys"), ["key"], ["node"]), "open-blocks")
    rest = materialise(across(open_blocks, reps, limit).join(stars, ["a", "b"], "left_anti"), "cross-pairs")
    more = verified(rest, classes, docs, words, limit)
    found = materialise(components(links.unionByName(more)), "components")
    for stored in (centres, blocks, stars, near, named, open_blocks, rest):
        discard(stored)
    of_set = classes.select("node", "rep_id", "rep_key", F.col("copies").alias("n")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    name = F.min(F.struct(F.isnull("rep_id").alias("no_id"), F.col("rep_id").alias("doc_id"), F.col("rep_key").alias("row_key")))
    names = of_set.groupBy("component").agg(name.alias("first"), F.count("*").alias("n"))
    named = salted_join(of_set.select("node", "component", F.col("n").alias("copies")), materialise(names, "names"), ["component"], ["node"])
    named = materialise(named.select("node", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("first_key"), F.col("copies").alias("n")), "named-sets")
    linked = salted_join(members.filter("node is not null").withColumnRenamed("n", "size"), named, ["node"], ["doc_id", "row_key"])
    linked = linked.select("doc_id", "row_key", F.col("size").alias("n_shingles"), F.col("node").alias("set_id"), "component_id", (F.col("row_key") == F.col("first_key")).alias("first"))
    alone = members.filter("node is null").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("node").alias("set_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return linked.unionByName(alone)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return join(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90).select("doc_id", "n_shingles", "component_id")

"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Vectors are cut into blocks of bounded size. A block keeps one list per dimension, sorted by the
component; a query reads its lists step by step from the end that gives the larger contribution.
What has been read of a vector gives a lower bound (unread parts contribute at least the far end of
their list) and an upper bound (at most the value at the list's frontier). Vectors whose upper bound
is below the k-th best lower bound go. Bounds stop when no more vectors are left than k or one step
of a list, and the final scores are resolved by reading on for these survivors alone.

Every (query block, vector block) pair is one bounded task: each side is repeated once for each
block of the other, as in a blocked scan of a stated query set. So the work is queries times vectors,
which is quadratic where queries are a share of the vectors. There are as many blocks as their sizes
ask for; queries are cut finer where that gives fewer tasks than cores. A block gives at most k rows
per query, and those are merged in a tree of bounded groups.

Defined cases: vectors that are null, hold null or non-finite components, or have a null id take
no part; repeated ids are separate candidates (a query's own id is never its answer, and of equal
rows of one query id one is used); ties go to the smaller id; vectors of another length than a
query's are not its candidates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors in a block, and queries in a block.
BLOCK, QUERIES = 8192, 2048
#: Steps in which a list is read, and queries that read together. Bounds are compared after steps 1, 2,
#: 4 and so on, and after every step from the middle of the lists on, where most vectors go.
STEPS, TOGETHER = 16, 128
#: Partial results of so many blocks are merged in one group.
MERGE = 64


def quantised(vector: Column, factor: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class SortedLists:
    """The lists of one block of vectors: one for each dimension, sorted by the component.

    ``ids`` ascend, so a position among them stands for a vector and ties are in order of ids.
    Queries of a batch share the reading: a step reads the next entries of every list from both
    ends, the upper end for queries with a positive component there, the lower end for the others.
    """

    def __init__(self, ids, x):
        import numpy as np

        self.ids = ids
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32, order="C")  # (dimension, place) -> vector
        self.values = np.take_along_axis(x.T, self.order, axis=1)
        #: Entries of lists read under bounds, entries there are, and vectors whose scores were resolved.
        self.read = self.entries = self.resolved = 0

    def search(self, own, asked, k: int) -> list[list[tuple[int, int]]]:
        """Of each query (its id in ``own``, a row of ``asked``) the k best (score, id), its own id excluded."""
        return [best for a in range(0, len(own), TOGETHER) for best in self._batch(own[a : a + TOGETHER], asked[a : a + TOGETHER], k)]

    def _batch(self, own, asked, k: int):
        import numpy as np

        dims, n = self.order.shape
        ends = np.concatenate([np.maximum(asked, 0), np.minimum(asked, 0)], 1)  # by query and list end
        far = np.concatenate([self.values[:, 0], self.values[:, -1]])
        alive = self.ids != own[:, None]
        least = np.iinfo(np.int64).min // 2 if asked.dtype.kind == "i" else -np.inf
        # lower bounds: what is unread counts as the far end of its list
        lower = np.repeat((ends @ far)[:, None], n, 1)
        # by list end and vector: what a step reads beyond the far end, and whether it is unread
        new, unread = np.zeros((2 * dims, n), asked.dtype), np.ones((2 * dims, n), asked.dtype)
        found: list = [None] * len(own)
        waiting, step, taken, depth = np.arange(len(own)), max(1, -(-n // STEPS)), 0, 0
        few, compared = max(k, step), {2**i for i in range(STEPS)}
        while len(waiting):
            to, taken = min(n, depth + step), taken + 1
            new[:] = 0
            for d in range(dims):
                for at, places in ((d, slice(n - to, n - depth)), (dims + d, slice(depth, to))):
                    ids = self.order[d, places]
                    new[at, ids] = self.values[d, places] - far[at]
                    unread[at, ids] = 0
            lower += ends @ new
            self.read += dims * (to - depth) * len(waiting)
            depth = to
            if depth < n and (2 * depth > n or taken in compared):
                # upper bounds: what is unread counts as the next entry of its list
                upper = (ends * (np.concatenate([self.values[:, n - 1 - depth], self.values[:, depth]]) - far)) @ unread
                upper += lower
                bound = np.where(alive, lower, least)
                bound.partition(max(n - k, 0), axis=1)
                alive &= upper >= bound[:, max(n - k, 0), None]  # ties stay
            done = (alive.sum(1) <= few) | (depth >= n)
            if done.any():
                for j in np.flatnonzero(done):
                    found[waiting[j]] = self._resolved(alive[j], lower[j], asked[waiting[j]], depth, k)
                waiting, lower, alive, ends = waiting[~done], lower[~done], alive[~done], ends[~done]
        self.entries += dims * n * len(own)
        return found

    def _resolved(self, alive, lower, q, depth: int, k: int) -> list[tuple[int, int]]:
        """Final scores: the lists are read on for the survivors alone."""
        import numpy as np

        n = len(self.ids)
        rows = np.flatnonzero(alive)
        self.resolved += len(rows)
        score = lower.copy()
        if depth < n:
            for sign, ids, values, far in ((q > 0, self.order[:, : n - depth], self.values[:, : n - depth], 0), (q < 0, self.order[:, depth:], self.values[:, depth:], -1)):
                d, at = np.nonzero(alive[ids] & sign[:, None])
                np.add.at(score, ids[d, at], (values[d, at] - self.values[d, far]) * q[d])
        top = np.lexsort((self.ids[rows], -score[rows]))[:k]
        return [(int(score[rows[i]]), int(self.ids[rows[i]])) for i in top]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``vectors`` and ``queries`` have (id long, v array<long>). Returns query_id, rank, vec_id, score."""
    n_blocks = max(1, -(-vectors.count() // block))
    n_queries, cores = queries.count(), vectors.sparkSession.sparkContext.defaultParallelism
    n_query_blocks = max(1, -(-n_queries // query_block), min(n_queries, -(-4 * cores // n_blocks)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.groupBy("id").agg(F.min("v").alias("v")).select("id", "v", part(n_query_blocks).alias("qb")).select("*", every(n_blocks).alias("vb"))
    right = vectors.select(F.col("id").alias("vec"), F.col("v").alias("x"), part(n_blocks).alias("vb")).select("*", every(n_query_blocks).alias("qb"))
    schema = "query_id long, vec_id long, score long, vb int"

    def search(pair: tuple, ask, have):
        import numpy as np
        import pandas as pd

        found = []
        sizes = have.x.map(len)
        for size, rows in ask.groupby(ask.v.map(len)) if len(ask) and len(have) else []:
            mine = have[sizes == size].sort_values("vec")
            if not len(mine) or not size:
                found += [(q, int(i), 0) for q in rows.id for i in mine.vec.to_numpy()[mine.vec.to_numpy() != q][:k]]
                continue
            x, asked = np.stack(mine.x.to_numpy()).astype(np.int64), np.stack(rows.v.to_numpy()).astype(np.int64)
            exact = size * float(np.abs(x).max()) * float(np.abs(asked).max()) < 2**52  # then floats hold every sum exactly
            kind = np.float64 if exact else np.int64
            lists = SortedLists(mine.vec.to_numpy(np.int64), x.astype(kind))
            own = rows.id.to_numpy(np.int64)
            found += [(q, i, s) for q, best in zip(own, lists.search(own, asked.astype(kind), k), strict=True) for s, i in best]
        made = pd.DataFrame(found, columns=["query_id", "vec_id", "score"])
        made["vb"] = int(pair[0])
        return made

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(search, schema)
    order = [F.desc("score"), F.asc("vec_id")]
    while n_blocks > MERGE:  # bounded groups, so that no task merges the answers of all blocks
        n_blocks = -(-n_blocks // MERGE)
        found = found.withColumn("vb", F.col("vb") % n_blocks)
        w = Window.partitionBy("query_id", "vb").orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    rows = read_table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.filter(F.col("id") % 100 == 0), k=10)


ORACLE = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS query_id, b.id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

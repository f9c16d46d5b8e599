"""Helpers shared by the training-data operators: shared storage, salting, guarded broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows (one part in so many) is hot: fewer keys than this can be.
HOT_KEYS = 1024
#: Parts that the rows of a hot key are dealt into.
SALTS = 64
#: Bytes of an Arrow batch in stored steps.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the storage all executors share.

    Where that setting is absent and everything runs on one machine (unit tests) a temporary folder
    is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def stored_step(spark: SparkSession) -> Iterator[None]:
    """Settings of a step whose result is stored: Arrow batches of at most ``BATCH_BYTES``, so that rows with
    long values stay bounded in workers, and shuffle files go at its end, since nothing reads them again."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there, so
    the loss of an executor never recomputes what came before."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    with stored_step(spark):
        df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(stored: DataFrame) -> None:
    """Deletes what ``materialise`` stored, once everything that reads it is itself stored."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def salted_join(rows: DataFrame, side: DataFrame, keys: list[str], deal_by: list[str]) -> DataFrame:
    """Inner join of ``rows`` with the stored ``side``, whose column ``n`` counts the rows of a key.

    Rows of hot keys are dealt by ``deal_by`` into ``SALTS`` parts. There are fewer than ``HOT_KEYS``
    hot keys at any size, so the table that marks them can be broadcast.
    """
    total = side.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_KEYS > total
    marks = side.filter(hot).select(*keys, F.lit(True).alias("is_hot")).distinct()
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(*deal_by), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(marks), keys, "left").withColumn("salt", salt).drop("is_hot")
    spread = side.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return dealt.join(spread, [*keys, "salt"]).drop("salt")


def release() -> None:
    """Gives memory that this process has freed back to the system. Spark keeps idle Python workers, each with the
    freed memory of its largest task, and an executor has one for each Python operator that its tasks chain."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` whose worker releases what it has freed when a task ends."""

    def released(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return released


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds ``value`` once and evaluates ``body`` on it.

    A lambda that refers to a column expression evaluates it again for each element; binding it
    as the element of a one-element array makes it a lambda variable, evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of a session at ``BATCH_BYTES`` where it still has Spark's own bound (64 MB), which
    a worker holds several times: for queries and stages whose result the caller runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864", "67108864b"):
        spark.conf.set(key, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries, which run with small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))

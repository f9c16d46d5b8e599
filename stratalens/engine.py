"""The engine object: reads files as bytes, compresses them to block tables, and gives them back."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.detect import sniff
from .sources import blocks

#: Endings of output folders that are named after their input.
PACKED, UNPACKED = ".blocks", ".out"


class Engine:
    """Compress, decompress and bench over files that Spark reads, one stream for each file.

    A file is one row, so files are meant to be of a size that an executor holds; many files spread
    over tasks, and blocks are independent.
    """

    def __init__(self, spark: SparkSession, block_bytes: int = blocks.BLOCK_BYTES, back_end: str = "structure"):
        self.spark, self.block_bytes, self.back_end = spark, block_bytes, back_end

    def read_bytes(self, path: str) -> DataFrame:
        """(stream_id, path, data, mode) of the files at ``path``; a path that is not there raises an error, and
        files without a byte are not read."""
        files = self.spark.read.format("binaryFile").load(path)
        known = F.decode(F.substring("content", 1, 65536), "iso-8859-1")  # one sign for each byte
        return files.select(F.xxhash64("path").alias("stream_id"), "path", F.col("content").alias("data"), sniff(known).alias("mode"))

    def compress(self, path: str, output: str | None = None) -> DataFrame:
        """Writes the blocks of the files at ``path`` to ``output`` and returns their table; what is there is never overwritten."""
        files = self.read_bytes(path)
        made = blocks.compress_blocks(files, "stream_id", "data", self.block_bytes, self.back_end)
        output = output or path.rstrip("/") + PACKED
        made.join(files.select("stream_id", "path"), "stream_id").write.mode("errorifexists").parquet(output)
        return self.spark.read.parquet(output)

    def decompress(self, path: str, output: str | None = None) -> DataFrame:
        """Writes (path, data) of the streams in the block table at ``path`` and returns them; damage raises an error."""
        packed = self.spark.read.parquet(path)
        back = blocks.decompress_blocks(packed)
        bad = F.raise_error(F.concat(F.lit("a damaged block in stream "), F.col("stream_id").cast("string")))
        back = back.withColumn("data", F.when(F.col("ok"), F.col("data")).otherwise(bad))
        parts = F.array_sort(F.collect_list(F.struct("block_no", "data")))
        whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["data"]))
        streams = back.groupBy("stream_id").agg(whole.alias("data"))
        output = output or (path.removesuffix(PACKED) if path.endswith(PACKED) and not self._exists(path.removesuffix(PACKED)) else path + UNPACKED)
        streams.join(packed.select("stream_id", "path").distinct(), "stream_id").select("path", "data").write.mode("errorifexists").parquet(output)
        return self.spark.read.parquet(output)

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def bench(self, path: str, most_bytes: int | None = None) -> dict:
        """Sizes, ratios, seconds and whether every stream came back; ``most_bytes`` truncates each file. The
        ratio of LZMA alone, at its strongest, is from the same run."""
        files = self.read_bytes(path)
        if most_bytes is not None:
            files = files.withColumn("data", F.substring("data", 1, most_bytes))
        sizes, out = {}, {}
        for name in dict.fromkeys((self.back_end, "lzma")):
            began = time.time()
            made = blocks.compress_blocks(files, "stream_id", "data", self.block_bytes, name)
            sizes[name] = made.agg(F.sum("orig_len"), F.sum(F.octet_length("payload"))).first()
            out[f"{name}_seconds"] = round(time.time() - began, 3)
            out[f"{name}_ratio"] = round((sizes[name][0] or 0) / max(sizes[name][1] or 0, 1), 4)
        began = time.time()
        made = blocks.compress_blocks(files, "stream_id", "data", self.block_bytes, self.back_end)
        back = blocks.streams_of(blocks.decompress_blocks(made)).join(files.select("stream_id", F.sha2("data", 256).alias("own")), "stream_id")
        wrong = back.filter(~F.col("ok") | (F.col("sha256") != F.col("own"))).count()
        return {"bytes": sizes[self.back_end][0] or 0, "ok": wrong == 0, "roundtrip_seconds": round(time.time() - began, 3)} | out

"""How rows are placed: helpers that change partitioning only, never rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deals rows evenly where the scan has fewer partitions than there are cores.

    A file of one row group is one task, whatever its size in bytes is cut into. Inputs of many row
    groups already have more partitions than cores and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)

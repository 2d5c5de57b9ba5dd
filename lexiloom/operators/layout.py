"""Spreading inputs that are too few splits to fill the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan of fewer splits than cores before work heavy on CPU.

    A scan with that few splits holds less than one split's bytes per core, so the shuffle is bounded
    by that size and never touches a large input. Meant for plain scans: others would be planned.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

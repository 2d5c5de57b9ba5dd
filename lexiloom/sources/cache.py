"""Prepared sets on disk, found again by what they were made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def input_fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Changes when a file is added, removed or rewritten; reads no content."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
             .select(F.xxhash64("path", "length", "modificationTime").alias("h")))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x")).first()
    return f"{row.n}-{row.x}"


def load_or_build(spark: SparkSession, directory: str, inputs: dict,
                  build: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
    """Read the set made from ``inputs`` (sources and options), or build and save it.

    The folder is named by the inputs, so other options never find a stale set. A folder without a
    marker, as after a job that died while writing, is written again; any other trouble is an error.
    """
    key = hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:32]
    path = f"{directory.rstrip('/')}/{key}"
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(marker):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        if not files.exists(marker):  # some committers write none
            files.create(marker).close()
    return spark.read.parquet(path)

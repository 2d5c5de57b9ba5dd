"""Row-wise operators on a growing folder of files.

Cleaning, rendering, prompts, wrapping, encoding and label masking are column expressions, so they
take a streaming frame as it is. Operators that number all rows are for batch only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T


def open_files(spark: SparkSession, path: str, schema: T.StructType | str,
               source_format: str = "parquet") -> DataFrame:
    return spark.readStream.format(source_format).schema(schema).load(path)


def run_available(rows: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str,
                  progress: str) -> None:
    """Process the files not seen so far, each exactly once, and stop."""
    query = (
        operator(rows).writeStream.format("parquet").option("checkpointLocation", progress)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()

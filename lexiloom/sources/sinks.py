"""Sinks for records, chat rows and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tree import write_one_file


def write_instruction_json(df: DataFrame, path: str) -> None:
    """JSON lines; characters outside ASCII stay as they are."""
    df.select("instruction", "input", "output").write.json(path, ignoreNullFields=False)


def write_instruction_array(df: DataFrame, path: str, order_by: Sequence[str | Column]) -> None:
    """One file on a mount that is one JSON array of the records in order; many tasks write it."""
    record = F.to_json(F.struct("instruction", "input", "output"), {"ignoreNullFields": "false"})
    write_one_file(df.orderBy(*order_by).select(record), path, ",\n", "[\n", "\n]\n")


def write_text_csv(df: DataFrame, path: str) -> None:
    """One ``text`` column with header; line breaks, quotes and empty texts survive."""
    df.select("text").write.csv(path, header=True, escape='"', emptyValue='""', nullValue="\\N")


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text STRING").csv(
        path, header=True, multiLine=True, escape='"', emptyValue="", nullValue="\\N")


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row frame of metrics as JSON."""
    df.coalesce(1).write.json(path)

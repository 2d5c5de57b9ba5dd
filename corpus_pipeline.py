"""From raw documents to a mixed training set: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiloom.llm import decontaminate, lines, mixing, neardup, quality
from lexiloom.storage import write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Whole texts that a Python worker and the JVM beside it hold at once in a stage whose frame the caller runs.
TEXT_BATCH = 1000


def _few_texts(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``TEXT_BATCH`` rows. It stays, since the stage runs later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    if not 0 < before <= TEXT_BATCH:
        spark.conf.set(name, str(TEXT_BATCH))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the compression bands go."""
    _few_texts(spark)
    return quality.filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go, and documents of which nothing is left with them."""
    cut = lines.drop_copied_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five words to a shingle, the first document stays."""
    return neardup.drop_near_duplicates(docs, shingle=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _few_texts(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with how many of their words it takes, repeats counted."""
    return mixing.mix_sources(docs).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
]

#: Compression and edit distance to a part of a text have no SQL form; tests compare each stage with a
#: plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = write_table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

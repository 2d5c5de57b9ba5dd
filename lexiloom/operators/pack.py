"""Joining token lists end to end and cutting them into blocks of one size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import BATCH_ROWS, DEFAULT_BLOCK
from .index import running_sum, with_bucket_index


def resolve_block_size(block_size: int | None, model_max: float) -> int:
    return int(min(block_size or DEFAULT_BLOCK, model_max))


def pack_blocks(df: DataFrame, block_size: int, order_by: Sequence[str | Column],
                batch_rows: int = BATCH_ROWS, columns: Sequence[str] = ("input_ids",)) -> DataFrame:
    """Cut each batch of consecutive rows into full blocks; the rest of a batch is dropped.

    ``columns`` (equal lengths) are cut alike. Rows are shuffled once by order bucket, which numbers
    them and places them in their batch, and their slices once by block; a batch of any size is
    spread over its buckets and blocks.
    """
    first = columns[0]
    numbered = with_bucket_index(df, order_by, "_idx")
    batch = F.floor(F.col("_idx") / batch_rows)
    rows = numbered.select("_bucket", batch.alias("batch_id"), "_idx", *columns).where(F.size(first) > 0)
    size = F.size(first).cast("bigint")
    placed = running_sum(rows, size, "batch_id", "_idx", "_off")
    end = F.col("_off") + size - 1
    full = F.lit(block_size)
    blocks = F.sequence(F.floor(F.col("_off") / full), F.floor(end / full))
    spans = placed.withColumn("block_id", F.explode(blocks))
    block_start = F.col("block_id") * full
    start = F.greatest(block_start - F.col("_off"), F.lit(0)).cast("int")
    stop = F.least(block_start + full - F.col("_off"), size).cast("int")
    slices = spans.select("batch_id", "block_id", F.struct(
        "_idx", *[F.slice(c, start + 1, stop - start).alias(c) for c in columns]).alias("part"))
    gathered = slices.groupBy("batch_id", "block_id").agg(
        F.array_sort(F.collect_list("part")).alias("parts"))
    cut = [F.flatten(F.col(f"parts.{c}")).alias(c) for c in columns]
    return gathered.select("batch_id", "block_id", *cut).where(F.size(first) == block_size)


def with_labels(blocks: DataFrame) -> DataFrame:
    """Add the constant attention mask and the labels, a copy of the ids; both after the shuffle."""
    if "attention_mask" not in blocks.columns:
        ones = F.array_repeat(F.lit(1), F.size("input_ids"))
        blocks = blocks.withColumn("attention_mask", ones)
    return blocks.withColumn("labels", F.col("input_ids"))

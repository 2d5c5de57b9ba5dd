"""Supervised examples with masked labels, and batches padded to their longest row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.fixed import EOS_ID, IGNORE_LABEL


def mask_labels(df: DataFrame, max_len: int | None = None, source: str = "source_ids",
                target: str = "target_ids") -> DataFrame:
    """Source and target ids in one row; the source part is hidden from the loss."""
    ids = F.concat(F.col(source), F.col(target))
    labels = F.concat(F.array_repeat(F.lit(IGNORE_LABEL), F.size(source)), F.col(target))
    if max_len is not None:
        ids, labels = F.slice(ids, 1, max_len), F.slice(labels, 1, max_len)
    others = [c for c in df.columns if c not in (source, target)]
    return df.select(*others, ids.alias("input_ids"), labels.alias("labels"))


def pad_batches(df: DataFrame, pad_id: int = EOS_ID, batch: str = "batch_id") -> DataFrame:
    """Pad every batch to its longest row. The mask hides each pad id, a true final one as well."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    missing = F.col("_longest") - F.size("input_ids")
    return (
        df.withColumn("_longest", longest)
        .withColumn("labels", F.concat("labels", F.array_repeat(F.lit(IGNORE_LABEL), missing)))
        .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), missing)))
        .withColumn("attention_mask", F.transform("input_ids", lambda x: x != pad_id))
        .drop("_longest")
    )

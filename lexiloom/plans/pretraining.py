"""Text rows to packed training blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import BATCH_ROWS
from ..functions.text import wrap_document
from ..operators.encode import encode
from ..operators.pack import pack_blocks, resolve_block_size, with_labels
from ..operators.sampling import split_train_test


def training_blocks(rows: DataFrame, vocab: DataFrame, order_by: Sequence[str | Column],
                    text: str = "text", block_size: int | None = None, model_max: float = 1e30,
                    batch_rows: int = BATCH_ROWS, truncate: bool = False) -> DataFrame:
    """Wrap, encode with both marks, pack. ``truncate`` first cuts each row to the block size."""
    size = resolve_block_size(block_size, model_max)
    tokens = encode(rows.withColumn(text, wrap_document(text)), vocab, text, add_eos=True,
                    max_length=size if truncate else None)
    return with_labels(pack_blocks(tokens, size, order_by, batch_rows))


def split_blocks(blocks: DataFrame, seed: int = 42, exact: bool = False) -> DataFrame:
    """Add ``split`` to packed blocks; a block is known by its batch and number."""
    key = F.concat_ws("-", "batch_id", "block_id")
    return split_train_test(blocks.withColumn("block_key", key), "block_key", seed=seed, exact=exact)

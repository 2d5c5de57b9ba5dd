"""User functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame

from .index import with_row_index
from .sampling import assign_batches


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                batch_rows: int | None = None, order_by: Sequence[str | Column] | None = None
                ) -> DataFrame:
    """Apply ``fn`` to batches; it may return more or fewer rows.

    Without ``batch_rows`` the batches are Arrow's own and nothing is shuffled. With it, batches are
    exactly the consecutive rows of ``order_by``, and no group is larger than ``batch_rows``.
    """
    if batch_rows is None:
        return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema)
    batched = assign_batches(with_row_index(df, order_by, "_idx"), batch_rows, index="_idx")

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        ordered = batch.sort_values("_idx", ignore_index=True)
        return fn(ordered.drop(columns=["_idx", "batch_id"]))

    return batched.groupBy("batch_id").applyInPandas(one, schema)


def collate_batches(df: DataFrame, collate: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                    batch: str = "batch_id") -> DataFrame:
    """Apply a user's collation function to each assigned batch."""
    return df.groupBy(batch).applyInPandas(collate, schema)

"""Instruction records to padded supervised batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..functions.fixed import EOS_ID
from ..operators.dialogue import build_prompt
from ..operators.encode import encode
from ..operators.supervised import mask_labels, pad_batches
from ..operators.sampling import assign_batches


def supervised_examples(records: DataFrame, vocab: DataFrame, max_len: int | None = None,
                        list_output: str = "repr") -> DataFrame:
    """Prompt, encode, mask: a narrow job over the records.

    The begin mark goes on the source only; the target ends with the literal end mark.
    """
    prompts = build_prompt(records, list_output)
    both = encode(encode(prompts, vocab, "source", "source_ids"), vocab, "target", "target_ids",
                  add_bos=False)
    return mask_labels(both.drop("source", "target"), max_len)


def padded_batches(examples: DataFrame, batch_rows: int, order_by: Sequence[str | Column],
                   pad_id: int = EOS_ID) -> DataFrame:
    return pad_batches(assign_batches(examples, batch_rows, order_by), pad_id)

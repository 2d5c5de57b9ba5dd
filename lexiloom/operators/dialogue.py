"""Dialogues and maths records as chat text, instruction records and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.fixed import (ANSWER_LABEL, DIALOGUE_INSTRUCTION, EOS, EQUATION_LABEL, PROMPT_HEAD,
                               PROMPT_TAIL)
from ..functions.text import col, python_list_text

_TURNS_PER_CHUNK = 256


def gather_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn",
                 text: str = "text") -> DataFrame:
    """Long table -> one ``utterances`` array per conversation, in turn order.

    Turns are first gathered in chunks, so a conversation with very many turns is put together by
    many tasks and only its finished chunks meet.
    """
    chunk = F.floor(F.col(turn) / _TURNS_PER_CHUNK)
    chunks = df.groupBy(conversation, chunk.alias("_chunk")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(text).alias("u"))))
        .alias("_turns"))
    ordered = F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("_chunk", "_turns"))), lambda c: c["_turns"]))
    whole = chunks.groupBy(conversation).agg(ordered.alias("_turns"))
    return whole.select(conversation, F.transform("_turns", lambda t: t["u"]).alias("utterances"))


def chat_text(utterances: str | Column) -> Column:
    """Even positions speak as Human, odd ones as Assistant."""
    def say(u: Column, i: Column) -> Column:
        speaker = F.when(i % 2 == 0, "Human").otherwise("Assistant")
        return F.concat(F.lit("<s>"), speaker, F.lit(": "), u, F.lit("\n</s>"))

    return F.array_join(F.transform(col(utterances), say), "")


def render_chat(df: DataFrame, utterances: str = "utterances") -> DataFrame:
    return df.withColumn("text", chat_text(utterances)).drop(utterances)


def dialogue_to_instruction(df: DataFrame, utterances: str = "utterances") -> DataFrame:
    """First utterance is the input, the rest the output; empty dialogues give no record."""
    u = F.col(utterances)
    return (
        df.where(F.size(u) > 0)
        .withColumn("instruction", F.lit(DIALOGUE_INSTRUCTION))
        .withColumn("input", F.get(u, F.lit(0)))
        .withColumn("output", F.slice(u, F.lit(2), F.size(u)))
        .drop(utterances)
    )


def _without_maths(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("original_text", "equation", "ans")]


def math_to_instruction(df: DataFrame) -> DataFrame:
    return df.select(
        *_without_maths(df),
        F.col("original_text").alias("instruction"),
        F.concat(F.lit(EQUATION_LABEL + ":"), "equation").alias("input"),
        F.concat(F.lit(ANSWER_LABEL), "ans").alias("output"),
    )


def math_to_chat(df: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("<s>Human: "), "original_text", F.lit("</s><s>Assistant: " + EQUATION_LABEL),
        "equation", F.lit(ANSWER_LABEL + "\n"), "ans", F.lit("</s>"))
    return df.select(*_without_maths(df), text.alias("text"))


def build_prompt(df: DataFrame, list_output: str = "repr") -> DataFrame:
    """Instruction records -> ``source`` and ``target``.

    A list in ``output`` is written as Python shows a list (``repr``) or line by line (``join``).
    """
    question = F.when(
        F.col("input").isNotNull() & (F.col("input") != ""),
        F.concat("instruction", F.lit("\n"), "input"),
    ).otherwise(F.col("instruction"))
    answer = F.col("output")
    if isinstance(df.schema["output"].dataType, T.ArrayType):
        if list_output not in ("repr", "join"):
            raise ValueError(f"list_output must be repr or join, not {list_output}")
        answer = python_list_text(answer) if list_output == "repr" else F.array_join(answer, "\n")
    others = [c for c in df.columns if c not in ("instruction", "input", "output")]
    return df.select(
        *others,
        F.concat(F.lit(PROMPT_HEAD), question, F.lit(PROMPT_TAIL)).alias("source"),
        F.concat(F.coalesce(answer, F.lit("None")), F.lit(EOS)).alias("target"),
    )

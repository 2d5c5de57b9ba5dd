"""Corpus statistics, perplexity and step counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import explode_words


def corpus_stats(df: DataFrame, by: list[str] = ["source"], text: str = "text",
                 stages: dict[str, Column] | None = None) -> DataFrame:
    """Files, bytes and characters per group; sums combine on the map side.

    ``stages`` names versions of the text. They are measured in one scan and told apart by ``stage``.
    """
    versions = {"": F.col(text)} if stages is None else stages
    sizes = F.explode(F.array(*[
        F.struct(F.lit(name).alias("stage"), F.octet_length(c).alias("bytes"), F.length(c).alias("chars"))
        for name, c in versions.items()])).alias("size")
    rows = df.select(*by, sizes).select(*by, "size.*")
    keys = by if stages is None else ["stage", *by]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("bytes").cast("bigint").alias("n_bytes"),
        F.min("chars").cast("bigint").alias("min_chars"),
        F.max("chars").cast("bigint").alias("max_chars"),
        F.round(F.sum("chars") / F.count(F.lit(1)), 4).alias("avg_chars"),
    )


def perplexity(df: DataFrame, loss: str = "loss", by: list[str] | None = None) -> DataFrame:
    """``exp(mean loss)``; beyond the range of a double it is infinite."""
    return df.groupBy(*(by or [])).agg(
        F.avg(loss).alias("eval_loss"), F.exp(F.avg(loss)).alias("perplexity"))


def unigram_loss(df: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """Loss of every group under word frequencies of the whole set: ``by, eval_loss, n_words``.

    Words are counted per group first, so a frequent word is one row per group before it moves.
    """
    counts = explode_words(df, text, [by]).groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    per_word = F.sum("n").over(Window.partitionBy("word"))
    with_word = counts.withColumn("word_n", per_word)
    grouped = with_word.groupBy(by).agg(
        F.sum("n").alias("n_words"), F.sum(F.col("n") * F.log("word_n")).alias("log_sum"))
    # One row per group from here on.
    total = F.sum("n_words").over(Window.partitionBy())
    return grouped.select(by, "n_words", (F.log(total) - F.col("log_sum") / F.col("n_words"))
                          .alias("eval_loss"))


def planned_steps(df: DataFrame, epochs: float, batch_rows: int, replicas: int = 1) -> DataFrame:
    steps = F.floor(F.count(F.lit(1)) * F.lit(epochs) / F.lit(batch_rows) / F.lit(replicas))
    return df.agg(steps.cast("bigint").alias("max_steps"))


def metrics_row(**parts: DataFrame) -> DataFrame:
    """One row of named metrics out of one-value frames (each a global aggregate)."""
    rows = [
        part.toDF("value").select(F.lit(name).alias("metric"), F.col("value").cast("double"))
        for name, part in parts.items()
    ]
    return reduce(DataFrame.union, rows).groupBy().pivot("metric", list(parts)).agg(F.first("value"))

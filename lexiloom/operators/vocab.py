"""Vocabulary tables: counting words and characters, merging, reporting.

A vocabulary is a table ``id BIGINT, piece STRING, score FLOAT, origin STRING``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.fixed import CHARACTER_COVERAGE, HEAD_LINES, SPECIALS, WORD_MARK
from ..functions.text import explode_words
from ..storage import write_table
from .index import with_row_index

VOCAB_SCHEMA = "id BIGINT, piece STRING, score FLOAT, origin STRING"


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct words with counts. Partial sums make a frequent word one row per task."""
    return explode_words(df, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def char_counts(counts: DataFrame) -> DataFrame:
    """Characters of the marked words. Works on distinct words, not on the text."""
    marked = F.concat(F.lit(WORD_MARK), "word")
    chars = counts.select(F.explode(F.split(marked, "")).alias("ch"), "n")
    return chars.groupBy("ch").agg(F.sum("n").alias("n"))


def alphabet(counts: DataFrame, coverage: float = CHARACTER_COVERAGE) -> DataFrame:
    """``ch, n, kept``: the most frequent characters until their share reaches ``coverage``.

    The running sum sees one row per distinct character, at most the size of Unicode.
    """
    chars = char_counts(counts)
    before = Window.orderBy(F.desc("n"), "ch").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("n").over(before), F.lit(0)) / F.sum("n").over(Window.partitionBy())
    return chars.select("ch", "n", (share < coverage).alias("kept"))


def word_vocab(counts: DataFrame) -> DataFrame:
    """Words as a vocabulary, the most frequent first. Give the counts as a written table."""
    ranked = with_row_index(counts, [-F.col("n"), "word"], "id")
    return ranked.select("id", F.col("word").alias("piece"),
                         (-F.col("id")).cast("float").alias("score"),
                         F.lit("words").alias("origin"))


def merge_vocab(base: DataFrame, new: DataFrame) -> DataFrame:
    """Append the new pieces the base lacks, in their order, with score 0; the base is unchanged."""
    first_id = base.agg(F.max("id")).first()[0]
    first_id = 0 if first_id is None else first_id + 1
    missing = new.select("id", "piece").join(base.select("piece"), "piece", "left_anti")
    # Numbering reads its input several times; the join runs once.
    numbered = with_row_index(write_table(missing, "new-pieces")[0], ["id"], "_n")
    added = numbered.select(
        (F.col("_n") + first_id).alias("id"), "piece",
        F.lit(0.0).cast("float").alias("score"), F.lit("new").alias("origin"))
    return base.select("id", "piece", "score", F.lit("base").alias("origin")).unionByName(added)


def vocab_head(vocab: DataFrame, lines: int = HEAD_LINES) -> DataFrame:
    return vocab.orderBy("id").limit(lines)


def vocab_report(vocab: DataFrame) -> DataFrame:
    """Size, distinct pieces, special pieces with ids, and pieces by origin."""
    special = F.col("piece").isin(*SPECIALS)
    shown = F.array_sort(F.collect_list(
        F.when(special, F.concat(F.lpad(F.col("id").cast("string"), 10, "0"), F.lit("\t"), "piece"))))
    specials = F.array_join(F.transform(shown, lambda s: F.concat(
        F.substring_index(s, "\t", -1), F.lit("="),
        F.substring_index(s, "\t", 1).cast("bigint").cast("string"))), ",")
    return vocab.agg(
        F.count(F.lit(1)).alias("n_pieces"),
        F.count_distinct("piece").alias("n_distinct"),
        F.count_if(F.col("origin") != "new").alias("n_before"),
        F.count_if(F.col("origin") == "new").alias("n_added"),
        specials.alias("specials"),
    )


def vocab_growth(vocab: DataFrame, base_size: int = 32_000) -> DataFrame:
    """Rows an embedding table of ``base_size`` must grow by."""
    return vocab.agg(F.greatest(F.count(F.lit(1)) - base_size, F.lit(0)).cast("bigint").alias("growth"))

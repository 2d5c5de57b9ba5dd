"""Raw books to a merged vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed import CHARACTER_COVERAGE, OCR_PATTERNS, VOCAB_SIZE
from ..functions.text import clean_text, split_semicolons
from ..operators.bpe import train_bpe
from ..operators.sampling import sample_one_per_dir
from ..operators.vocab import merge_vocab
from ..sources.books import decode_books, scan_books
from ..sources.lines import broadcast_if_small


def clean_books(spark: SparkSession, root: str, patterns: Sequence[str] = OCR_PATTERNS,
                one_per_dir: bool = False, seed: int = 42) -> DataFrame:
    """All books of a tree, or one random file of every directory, decoded and cleaned."""
    if one_per_dir:
        # The draw is among all files of a directory, so it comes before the name filter.
        names = scan_books(spark, root, suffix="").select("path", "dir")
        chosen = sample_one_per_dir(names, "dir", "path", seed).select("path")
        # One path per directory: the files themselves are filtered where they are read.
        books = scan_books(spark, root).join(broadcast_if_small(chosen), "path", "left_semi")
    else:
        books = scan_books(spark, root)
    cleaned = split_semicolons(clean_text("text", patterns))
    return decode_books(books).withColumn("text", cleaned)


def extend_vocabulary(corpus: DataFrame, base: DataFrame, vocab_size: int = VOCAB_SIZE,
                      coverage: float = CHARACTER_COVERAGE) -> DataFrame:
    """Train on the corpus and append the pieces the base lacks."""
    return merge_vocab(base, train_bpe(corpus, vocab_size, coverage))

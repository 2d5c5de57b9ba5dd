"""Samples, splits, shards and file numbering. All seeded, all repeatable."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import REPLICAS, TEST_SHARE
from ..functions.text import col, hash_key, java_pattern
from .index import running_sum, with_bucket_index, with_row_index, with_shuffled_index

_DIGIT_BITS = 16
#: Keys of one hash value that are looked through on the driver; further ones are summed in buckets.
_FIRST_KEYS = 1_000


def sample_one_per_dir(df: DataFrame, directory: str, path: str, seed: int = 42,
                       suffix: str = ".txt") -> DataFrame:
    """One random file per directory, kept only if it has the suffix (there is no second draw).

    ``min_by`` combines on the map side, so a huge directory costs one row per task.
    """
    order = F.struct(hash_key(path, seed), F.col(path))
    picked = df.groupBy(directory).agg(F.min_by(F.struct(*df.columns), order).alias("_row"))
    return picked.select("_row.*").where(F.col(path).endswith(suffix))


def extension(name: str | Column) -> Column:
    """Last extension with its dot; leading dots do not begin one."""
    return F.regexp_extract(col(name), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def number_files(df: DataFrame, directory: str = "dir", file_name: str = "file_name") -> DataFrame:
    """Manifest old name -> new name: files of a directory sorted and numbered from 1."""
    numbered = with_row_index(df, [file_name], "_n", within=[directory])
    new_name = F.concat((F.col("_n") + 1).cast("string"), extension(file_name))
    return numbered.select(directory, file_name, new_name.alias("new_name"))


def rename_by_regex(df: DataFrame, pattern: str, replacement: str = "",
                    path: str = "path") -> DataFrame:
    """Manifest of paths whose file or directory names change. The pattern is a Python regex."""
    rule = java_pattern(pattern)
    parts = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, rule, replacement))
    renamed = df.select(F.col(path).alias("old_path"), F.array_join(parts, "/").alias("new_path"))
    return renamed.where(F.col("old_path") != F.col("new_path"))


def _exact_threshold(df: DataFrame, key: str, seed: int, test_size: float):
    """The (hash, key) pair of the last test row: digit by digit of the hash, then among its keys.

    A histogram has at most 65,536 rows whatever the input, and no row is sorted to find a digit.
    """
    rows = df.select(hash_key(key, seed).alias("h"), F.col(key).alias("k"))
    wanted, prefix = None, 0
    for shift in (_DIGIT_BITS, 0):
        digit = F.shiftright("h", shift)
        histogram = sorted(tuple(r) for r in rows.groupBy(digit.alias("p")).count().collect())
        if wanted is None:
            wanted = math.ceil(test_size * sum(n for _, n in histogram))
            if not wanted:
                return None
        for p, n in histogram:
            if wanted <= n:
                break
            wanted -= n
        rows, prefix = rows.where(digit == p), p
    return prefix, _key_at(rows, wanted)


def _key_at(rows: DataFrame, wanted: int):
    """The key ``k`` of the row at the place ``wanted``, counted from 1. Equal keys are one row here."""
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    before = 0
    for k, n in keys.orderBy("k").limit(_FIRST_KEYS).collect():
        before += n
        if wanted <= before:
            return k
    indexed = with_bucket_index(keys.withColumn("all", F.lit(0)), ["k"], within=["all"])
    summed = running_sum(indexed, F.col("n"), "all", "idx", "before")
    return summed.where((F.col("before") < wanted) & (F.col("before") + F.col("n") >= wanted)).first()["k"]


def split_train_test(df: DataFrame, key: str, test_size: float = TEST_SHARE, seed: int = 42,
                     exact: bool = False) -> DataFrame:
    """Add ``split``. Both forms are a narrow expression on the rows.

    ``exact`` first finds the border so that the test set has ``ceil(test_size * n)`` rows.
    """
    hashed = hash_key(key, seed)
    if not exact:
        is_test = hashed < F.lit(int(test_size * 2**32))
    else:
        border = _exact_threshold(df, key, seed, test_size)
        if border is None:
            return df.withColumn("split", F.lit("train"))
        last_hash, last_key = border
        first_keys = F.col(key).isNull() if last_key is None else F.col(key).isNull() | (F.col(key) <= last_key)
        is_test = (hashed < last_hash) | ((hashed == last_hash) & first_keys)
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a repeatable random order (a range-partitioned sort)."""
    return df.orderBy(hash_key(key, seed), key)


def assign_shards(df: DataFrame, key: str, n: int = REPLICAS, seed: int = 42,
                  even: bool = False) -> DataFrame:
    """Deal shuffled rows round-robin to ``n`` shards.

    ``even`` deals the first rows once more so that every shard has the same number of rows.
    """
    indexed = with_shuffled_index(df, key, seed)
    if even:
        total = df.count()
        if total:
            copies = F.sequence(F.col("idx"), F.lit(math.ceil(total / n) * n - 1), F.lit(total))
            indexed = indexed.withColumn("idx", F.explode(copies))
    return indexed.withColumn("shard", F.pmod("idx", F.lit(n)).cast("int"))


def assign_batches(df: DataFrame, batch_rows: int, order_by: Sequence[str | Column] | None = None,
                   index: str | None = None) -> DataFrame:
    """Consecutive rows of the order, ``batch_rows`` at a time; reuses an index column if given."""
    indexed = df if index else with_row_index(df, order_by)
    return indexed.withColumn("batch_id", F.floor(F.col(index or "idx") / batch_rows))


def sample_count(df: DataFrame, cap: int | None = None) -> DataFrame:
    """The reported number of training rows; the data itself is never cut."""
    n = F.count(F.lit(1))
    return df.agg((F.least(n, F.lit(cap)) if cap is not None else n).cast("bigint").alias("train_samples"))

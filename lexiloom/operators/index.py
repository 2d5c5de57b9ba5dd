"""Dense row numbers over a total order, without ever putting all rows into one task.

Rows go to range buckets of the order, each bucket is numbered by itself, and a table of at most
one row per bucket carries the counts of the buckets before it. Every step is a function of the
data alone, so a recomputed task gives the same numbers. The order must be total: end it with a
unique column. The input is read four times, three of them with the order columns only; write it to a
table first if these are costly to compute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import col, hash_key

_BUCKETS_PER_PARTITION = 4
_MAX_BUCKETS = 16_384
_SAMPLES_PER_BUCKET = 30
_ROWS_PER_BUCKET = 500
_COMPILED_BORDERS = 64


def bucket_count(df: DataFrame) -> int:
    """Follows the cluster's own shuffle setting; bounds every per-bucket table."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(_MAX_BUCKETS, partitions * _BUCKETS_PER_PARTITION))


def _key(keys: Sequence[Column]) -> Column:
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])


def range_bucket(df: DataFrame, keys: Sequence[Column]) -> Column:
    """Bucket number from sampled borders. The sample steers balance only, never the result."""
    rows = df.select(_key(keys).alias("key"))
    total = rows.count()
    n_buckets = min(bucket_count(df), 2 + total // _ROWS_PER_BUCKET)
    wanted = n_buckets * _SAMPLES_PER_BUCKET
    sample = rows if total <= wanted else rows.sample(fraction=wanted / total, seed=7)
    picked = [r.j for r in sample.orderBy("key").select(F.to_json("key").alias("j")).collect()]
    borders = [picked[len(picked) * i // n_buckets] for i in range(1, n_buckets)] if picked else []
    if not borders:
        return F.lit(0)
    key_type = rows.schema["key"].dataType.simpleString()
    literal = F.from_json(F.lit("[" + ",".join(borders) + "]"), f"array<{key_type}>")
    return _borders_below(_key(keys), literal, len(borders))


def _borders_below(key: Column, borders: Column, n: int) -> Column:
    """How many of the ``n`` sorted borders are not above the key, by binary search."""
    if n <= _COMPILED_BORDERS:
        def between(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(F.get(borders, F.lit(middle)) <= key, between(middle + 1, high)).otherwise(
                between(low, middle))

        return between(0, n)
    step, steps = 1 << (n.bit_length() - 1), []
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda below, s: F.when(F.get(borders, below + s - 1) <= key, below + s).otherwise(below),
    )


def hash_bucket(df: DataFrame, hashed: Column) -> Column:
    """Bucket for an order that begins with a 32-bit hash: even by itself, no sample needed."""
    return F.shiftright(hashed * F.lit(bucket_count(df)), 32).cast("int")


def carried_totals(totals: DataFrame, bucket: str, within: Sequence[str], value: str) -> DataFrame:
    """What earlier buckets hold of each group, for the groups that go on from one to the next.

    A bucket goes on with at most one group, so at most one row per bucket is left.
    """
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    summed = totals.withColumn("_before", F.sum(value).over(before))
    return summed.where(F.col("_before") > 0).select(bucket, *within, "_before")


def _add_carried(rows: DataFrame, carried: DataFrame, bucket: str, within: Sequence[str]) -> DataFrame:
    renamed = carried.toDF("_cb", *[f"_c{i}" for i in range(len(within))], "_before")
    match = F.col(bucket) == F.col("_cb")
    for i, c in enumerate(within):
        match = match & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    joined = rows.join(F.broadcast(renamed), match, "left")
    return joined.withColumn("_before", F.coalesce("_before", F.lit(0)))


def with_bucket_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "idx",
                      within: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """As ``with_row_index``, with the bucket kept in ``_bucket``; rows stay partitioned by it."""
    keys = [F.col(c) for c in within] + [col(c) for c in order_by]
    bucketed = df.withColumn("_bucket", range_bucket(df, keys) if bucket is None else bucket)
    counts = bucketed.groupBy("_bucket", *within).agg(F.count(F.lit(1)).alias("_n"))
    local = Window.partitionBy("_bucket", *within).orderBy(*keys[len(within):])
    numbered = bucketed.withColumn("_local", F.row_number().over(local))
    joined = _add_carried(numbered, carried_totals(counts, "_bucket", within, "_n"), "_bucket", within)
    index = (F.col("_local") - 1 + F.col("_before")).cast("bigint")
    return joined.select(*df.columns, "_bucket", index.alias(name))


def with_row_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "idx",
                   within: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Add a 0-based number by ``order_by``, restarted in every ``within`` group.

    A hot group is spread over as many buckets as it fills.
    """
    return with_bucket_index(df, order_by, name, within, bucket).drop("_bucket")


def running_sum(rows: DataFrame, value: Column, group: str, order: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, for rows that carry ``_bucket``.

    Summed inside each bucket, plus what earlier buckets hold of the group: a group of any size is
    spread over its buckets, and rows do not move.
    """
    before = Window.partitionBy("_bucket", group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = rows.groupBy("_bucket", group).agg(F.sum(value).alias("_n"))
    summed = rows.withColumn("_local", F.coalesce(F.sum(value).over(before), F.lit(0)))
    joined = _add_carried(summed, carried_totals(totals, "_bucket", [group], "_n"), "_bucket", [group])
    return joined.select(*rows.columns, (F.col("_local") + F.col("_before")).alias(name))


def with_shuffled_index(df: DataFrame, key: str, seed: int = 42, name: str = "idx") -> DataFrame:
    """Number rows in the repeatable random order given by the hash of a unique key."""
    hashed = hash_key(key, seed)
    return with_row_index(df, [hashed, key], name, bucket=hash_bucket(df, hashed))

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import hash_key
from lexiloom.operators import batch, index, sampling, sets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_equals_sort(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_003).alias("k"), F.col("id").alias("v"))
    got = index.with_row_index(df, ["k"]).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(5_000))
    assert [r.k for r in got] == sorted(r.k for r in got)


@pytest.mark.parametrize("n", [1, 2, 5, 15, 16, 31, 64])
def test_both_searches_count_the_borders_below(spark, monkeypatch, n):
    borders = sorted(random.Random(n).choices(range(100), k=n))
    literal = F.array(*[F.struct(F.lit(b).cast("bigint").alias("k0")) for b in borders])
    key = F.struct((F.col("id") - 1).alias("k0"))
    df = spark.range(103)
    for compiled in (64, 0):
        monkeypatch.setattr(index, "_COMPILED_BORDERS", compiled)
        got = df.select((F.col("id") - 1).alias("k"), index._borders_below(key, literal, n).alias("b"))
        assert all(r.b == bisect.bisect_right(borders, r.k) for r in got.collect())


def test_index_equals_sort_with_many_borders(spark, monkeypatch):
    monkeypatch.setattr(index, "_COMPILED_BORDERS", 0)
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_003).alias("k"))
    assert [r.idx for r in index.with_row_index(df, ["k"]).orderBy("k").collect()] == list(range(5_000))


def test_index_of_strings_nulls_and_descending(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), ("é", 4), ("b", 5)], "s string, id int")
    got = index.with_row_index(df, ["s", -F.col("id")]).orderBy("idx").collect()
    assert [r.id for r in got] == [1, 3, 5, 2, 4]
    assert index.with_row_index(df.limit(0), ["s"]).count() == 0


def test_numbers_restart_in_groups_and_a_hot_group_is_split(spark):
    df = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 500).cast("string")))
        .alias("g"), F.lpad(F.col("id").cast("string"), 6, "0").alias("name"))
    got = index.with_row_index(df, ["name"], within=["g"])
    wrong = got.join(
        df.selectExpr("g", "name", "row_number() over (partition by g order by name) - 1 as want"),
        ["g", "name"]).where("idx != want")
    assert wrong.count() == 0 and got.count() == 9_000
    keys = [F.col("g"), F.col("name")]
    buckets = df.withColumn("b", index.range_bucket(df, keys)).where("g = 'hot'")
    assert buckets.select("b").distinct().count() >= 4


def test_row_data_never_meets_in_one_partition(spark):
    df = spark.range(1_000).withColumn("payload", F.lit("x"))
    single = [p for p in plan(index.with_row_index(df, ["id"])).splitlines() if "SinglePartition" in p]
    assert len(single) == 1  # the table of bucket counts
    assert "NestedLoop" not in plan(index.with_row_index(spark.range(3), ["id"]))


def test_hash_order_is_repeatable(spark):
    df = spark.range(3_000)
    first = {r.id: r.idx for r in index.with_shuffled_index(df, "id").collect()}
    again = {r.id: r.idx for r in index.with_shuffled_index(df.repartition(7), "id").collect()}
    assert first == again and sorted(first.values()) == list(range(3_000))
    assert [first[r.id] for r in sampling.shuffle_rows(df, "id").collect()] == list(range(3_000))


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(11)
    exact = {r["split"]: r.n_rows for r in sets.set_sizes(
        sampling.split_train_test(df, "id", exact=True)).collect()}
    assert exact == {"test": 2, "train": 9}
    hashed = sampling.split_train_test(spark.range(5_000), "id")
    assert hashed.count() == 5_000
    assert abs(hashed.where("split = 'test'").count() - 500) < 100


@pytest.mark.parametrize("first", [0, 3, 1000])
def test_exact_border_among_equal_hashes(spark, monkeypatch, first):
    """Keys of one hash, repeated and null ones too, are split in their order, on the driver or in buckets."""
    monkeypatch.setattr(sampling, "_FIRST_KEYS", first)
    monkeypatch.setattr(sampling, "hash_key", lambda key, seed=42: F.when(F.col(key) > 50, 7 << 16).otherwise(
        F.lit(9)).cast("bigint"))
    keys = [None, None] + [i % 53 for i in range(200)] + [30] * 70
    df = spark.createDataFrame([(k,) for k in keys], "id int")
    order = sorted(keys, key=lambda k: (9 if k is None or k <= 50 else 7 << 16, k is not None, k or 0))
    for share in (0.003, 0.2, 0.45, 0.6, 0.99, 1.0):
        border = order[math.ceil(share * len(order)) - 1]
        place = max(i for i, k in enumerate(order) if k == border)  # equal keys share their fate
        test = [r.id for r in sampling.split_train_test(df, "id", share, exact=True).where("split = 'test'").collect()]
        assert sorted(test, key=str) == sorted(order[:place + 1], key=str)


@pytest.mark.parametrize("n", [1, 10, 30, 997])
def test_exact_split_takes_the_lowest_hashes(spark, n):
    df = spark.range(n)
    ranked = [r.id for r in df.orderBy(hash_key("id"), "id").collect()]
    test = {r.id for r in sampling.split_train_test(df, "id", exact=True).where("split = 'test'").collect()}
    assert test == set(ranked[:math.ceil(0.1 * n)])
    assert sampling.split_train_test(df.limit(0), "id", exact=True).count() == 0


def test_even_shards_repeat_the_first_rows(spark):
    got = sampling.assign_shards(spark.range(10), "id", n=4, even=True)
    sizes = {r.shard: r["count"] for r in got.groupBy("shard").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 3, 3: 3}
    tiny = sampling.assign_shards(spark.range(3), "id", n=8, even=True)
    assert sorted(r.shard for r in tiny.collect()) == list(range(8))


def test_one_file_per_directory(spark):
    rows = [("a", "a/1.md"), ("b", "b/1.txt"), ("b", "b/2.txt"), ("c", "c/1.txt")]
    df = spark.createDataFrame(rows, "dir string, path string")
    got = [(r.dir, r.path) for r in sampling.sample_one_per_dir(df, "dir", "path").collect()]
    assert {d for d, _ in got} == {"b", "c"} and len(got) == 2


def test_numbered_files(spark):
    names = ["1.txt", "10.txt", "2.txt", ".hid", "a.b.c", "plain", "..x.y"]
    df = spark.createDataFrame([("d", n) for n in names], "dir string, file_name string")
    got = {r.file_name: r.new_name for r in sampling.number_files(df).collect()}
    assert got == {"..x.y": "1.y", ".hid": "2", "1.txt": "3.txt", "10.txt": "4.txt", "2.txt": "5.txt",
                   "a.b.c": "6.c", "plain": "7"}


def test_rename_covers_directories(spark):
    df = spark.createDataFrame([("a&b/[c].txt",), ("plain/x.txt",)], "path string")
    got = sampling.rename_by_regex(df, r"[\&\[\&\]]+").collect()
    assert [(r.old_path, r.new_path) for r in got] == [("a&b/[c].txt", "ab/c.txt")]


def test_batches_and_user_functions(spark):
    df = spark.range(25).withColumn("v", F.col("id") * 2)
    got = sampling.assign_batches(df, 10, ["id"]).groupBy("batch_id").count()
    assert {r.batch_id: r["count"] for r in got.collect()} == {0: 10, 1: 10, 2: 5}
    doubled = batch.map_batches(df, lambda b: b.loc[b.index.repeat(2)], "id long, v long")
    assert doubled.count() == 50
    firsts = batch.map_batches(df, lambda b: b.head(1), "id long, v long", batch_rows=10, order_by=["id"])
    assert sorted(r.id for r in firsts.collect()) == [0, 10, 20]


def test_sample_count(spark):
    assert sampling.sample_count(spark.range(7), 5).first()[0] == 5
    assert sampling.sample_count(spark.range(7)).first()[0] == 7

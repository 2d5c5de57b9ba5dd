import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import bpe, pack, stats, supervised
from lexiloom.plans import pretraining, tuning


def frame(spark, lengths):
    token, rows = 0, []
    for i, n in enumerate(lengths):
        rows.append((i, list(range(token, token + n))))
        token += n
    return spark.createDataFrame(rows, "id long, input_ids array<int>")


def expected(lengths, block, batch_rows):
    token, out = 0, []
    for b in range(0, len(lengths), batch_rows):
        flat = []
        for n in lengths[b:b + batch_rows]:
            flat += range(token, token + n)
            token += n
        out += [(b // batch_rows, k, flat[k * block:(k + 1) * block]) for k in range(len(flat) // block)]
    return out


def blocks_of(df):
    return [(r.batch_id, r.block_id, r.input_ids) for r in df.orderBy("batch_id", "block_id").collect()]


@pytest.mark.parametrize("lengths, block, rows", [
    ([3, 2, 4, 3], 4, 3), ([0, 9, 0, 1], 4, 10), ([25], 4, 10), ([1] * 9, 4, 100), ([4, 4], 4, 1),
])
def test_small_packings(spark, lengths, block, rows):
    got = blocks_of(pack.pack_blocks(frame(spark, lengths), block, ["id"], rows))
    assert got == expected(lengths, block, rows)


def test_random_packing_keeps_tokens(spark):
    rng = random.Random(3)
    lengths = [rng.choice([0, 1, 5, 40, 300]) for _ in range(400)]
    got = blocks_of(pack.pack_blocks(frame(spark, lengths), 32, ["id"], 50))
    assert got == expected(lengths, 32, 50)


def test_columns_are_cut_alike(spark):
    df = frame(spark, [3, 6, 2]).withColumn("other", F.transform("input_ids", lambda x: -x))
    rows = pack.with_labels(pack.pack_blocks(df, 4, ["id"], 10, ["input_ids", "other"])).collect()
    assert len(rows) == 2
    for r in rows:
        assert r.other == [-x for x in r.input_ids] and r.labels == r.input_ids
        assert r.attention_mask == [1] * 4


def test_one_batch_is_spread_and_tokens_are_made_once(spark):
    rng = random.Random(5)
    lengths = [rng.choice([0, 1, 7, 90]) for _ in range(3_000)]
    packed = pack.pack_blocks(frame(spark, lengths).repartition(3), 16, ["id"], 100_000)
    assert blocks_of(packed) == expected(lengths, 16, 100_000)
    packed.collect()
    plan = packed._jdf.queryExecution().executedPlan().toString()
    # The sizes per bucket come from the same shuffled rows as the slices.
    assert "ReusedExchange" in plan.split("== Initial Plan")[0]


def test_block_size():
    assert pack.resolve_block_size(None, 1e30) == 1024
    assert pack.resolve_block_size(4096, 1e30) == 4096
    assert pack.resolve_block_size(4096, 512) == pack.resolve_block_size(None, 512) == 512


def test_masked_labels(spark):
    df = spark.createDataFrame([(1, [7, 8, 9], [1, 2, 3, 4]), (2, [7] * 6, [1])],
                               "id int, source_ids array<int>, target_ids array<int>")
    rows = {r.id: r for r in supervised.mask_labels(df, 5).collect()}
    assert rows[1].input_ids == [7, 8, 9, 1, 2] and rows[1].labels == [-100, -100, -100, 1, 2]
    assert rows[2].labels == [-100] * 5
    whole = {r.id: r for r in supervised.mask_labels(df).collect()}
    assert all(len(r.input_ids) == len(r.labels) for r in whole.values())
    assert len(whole[2].labels) == 7


def test_padding(spark):
    df = spark.createDataFrame([(0, [1, 5, 2], [1, 5, 2]), (0, [1, 2], [1, 2]), (1, [1], [1])],
                               "batch_id long, input_ids array<int>, labels array<int>")
    rows = supervised.pad_batches(df).orderBy("batch_id", F.desc("labels")).collect()
    got = {(r.batch_id, tuple(r.input_ids)): (r.labels, r.attention_mask) for r in rows}
    assert got[0, (1, 5, 2)] == ([1, 5, 2], [True, True, False])
    assert got[0, (1, 2, 2)] == ([1, 2, -100], [True, False, False])
    assert got[1, (1,)] == ([1], [True])


def test_perplexity(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 710.0)], "split string, loss double")
    got = {r["split"]: r.perplexity for r in stats.perplexity(df, by=["split"]).collect()}
    assert got == {"a": 1.0, "b": float("inf")}
    assert stats.planned_steps(spark.range(100), 3, 8).first().max_steps == 37
    assert stats.planned_steps(spark.range(100), 3, 8, 8).first().max_steps == 4


def test_text_to_blocks(spark):
    df = spark.createDataFrame([(i, "the cat sat on the mat " * (i + 1)) for i in range(20)],
                               "id long, text string")
    vocab = bpe.train_bpe(df, coverage=1.0, n_merged=10)
    blocks = pretraining.training_blocks(df, vocab, ["id"], block_size=16, batch_rows=8)
    rows = blocks.collect()
    assert rows and all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 16 for r in rows)
    split = pretraining.split_blocks(blocks, exact=True)
    assert split.where("split = 'test'").count() == -(-len(rows) // 10)
    cut = pretraining.training_blocks(df, vocab, ["id"], block_size=16, batch_rows=8, truncate=True)
    assert cut.count() < len(rows)


def test_records_to_batches(spark):
    records = spark.createDataFrame(
        [(i, "say", "x" * i, ["a", "b"]) for i in range(6)],
        "id long, instruction string, input string, output array<string>")
    vocab = bpe.train_bpe(spark.createDataFrame([("say x a b",)], "text string"), coverage=1.0, n_merged=2)
    ex = tuning.supervised_examples(records, vocab)
    for r in ex.collect():
        assert len(r.input_ids) == len(r.labels)
        assert r.input_ids[0] == 1 and r.input_ids[-1] == 2 and r.labels[-1] == 2 and r.labels[0] == -100
    padded = tuning.padded_batches(ex, 4, ["id"]).collect()
    widths = {r.batch_id: {len(x.input_ids) for x in padded if x.batch_id == r.batch_id} for r in padded}
    assert set(widths) == {0, 1} and all(len(w) == 1 for w in widths.values())

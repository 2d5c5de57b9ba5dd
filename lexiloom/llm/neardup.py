"""Near duplicates by HyperMinHash registers.

A text's set of word shingles is hashed; the leading bits of a hash choose a register, and a register
keeps of its smallest hash the count of leading zeros and some mantissa bits. Texts that agree on all
registers of a band are compared: first by the registers, corrected for chance collisions, then by
their whole sets. Equal sets are one class from the start, so exact copies are never compared.

Classes of a bucket are not paired with each other. Each is compared with the bucket's centre, and
linked classes become one component. Where a bucket still holds several components, the classes outside
its largest one are compared with all others in blocks inside numpy, and only links leave a block.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import drop_table, write_table
from .components import components
from .words import fresh, mix, utf8, word_hashes

_REGISTER_BITS = 8
REGISTERS = 1 << _REGISTER_BITS
#: Registers per band; 42 bands miss a pair of similarity 0.8 three times in a million.
BAND = 6
BANDS = REGISTERS // BAND
_MANTISSA = 10
_RANK_BITS = 48
#: A pair is verified unless its estimate is this many standard errors below the threshold.
_ERRORS = 4.5
#: Hashes of the sets in a block, and in a block of those outside the largest component.
_MANY_HASHES, _FEW_HASHES = 100_000, 25_000
#: Tables of up to this many (id, class) rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 200_000
_CACHED_SETS = 64
#: Rows that Python gets at once: with a text to sign, with texts to compare, and with two blocks.
_TEXT_BATCH, _BATCH, _BLOCK_BATCH = 1000, 64, 4
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles, A-Z lower-cased; a shorter sequence
    is one shingle, and no words are the empty set."""
    words = word_hashes(utf8(text).lower())
    width = min(k, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[i:len(words) - width + 1 + i])
    return np.unique(out)


def _encode(low: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 48-bit values, plus one so that 0 means empty."""
    length = np.frexp(low.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(_RANK_BITS) - length
    mantissa = ((low << zeros) >> np.uint64(_RANK_BITS - 1 - _MANTISSA)) & np.uint64((1 << _MANTISSA) - 1)
    return ((zeros << np.uint64(_MANTISSA)) | mantissa).astype(np.int64) + 1


def registers(shingles: np.ndarray) -> np.ndarray:
    """One code per register, 0 where no hash fell. Sorted hashes put each smallest one first."""
    starts = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _REGISTER_BITS)
    at = np.searchsorted(shingles, starts)
    full = at < np.append(at[1:], len(shingles))
    out = np.zeros(REGISTERS, np.uint16)
    rest = (shingles[at[full]] << np.uint64(_REGISTER_BITS)) >> np.uint64(64 - _RANK_BITS)
    out[full] = _encode(rest)
    return out


def band_keys(shingles: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit key per band. Empty registers stand in with a smallest hash over the whole set, so that
    two sets agree on any register with the chance of their similarity."""
    values = codes.astype(np.uint64)
    empty = np.flatnonzero(codes == 0)
    step = max(1, (1 << 20) // max(1, len(shingles)))
    for i in range(0, len(empty), step):
        part = empty[i:i + step]
        least = mix(shingles[None, :] ^ _SEEDS[part][:, None]).min(axis=1)
        values[part] = _encode(least >> np.uint64(64 - _RANK_BITS)).astype(np.uint64) + np.uint64(1 << 16)
    rows = values[:BANDS * BAND].reshape(BANDS, BAND)
    keys = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for i in range(BAND):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + rows[:, i])
    return keys


def _collision(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that registers of two sets with ``a`` and ``b`` other hashes each hold the same code.

    Both smallest hashes lie in one cell of width 2^-(zeros+1+mantissa bits); summed over the zeros.
    """
    rate = (a + b)[..., None]
    scale = 2.0 ** -np.arange(1, _RANK_BITS)
    cell = np.exp(-rate * scale) - np.exp(-2 * rate * scale)
    return (a * b / np.maximum(a + b, 1e-9)) * (cell * scale).sum(-1) / (1 << _MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of register rows, without chance collisions, and how many registers it rests on."""
    used = ((a > 0) | (b > 0)).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    chance = used * np.minimum(0.5, _collision(n_a / REGISTERS, n_b / REGISTERS))
    return np.clip((equal - chance) / np.maximum(used - chance, 1e-9), 0, 1), used


def may_be_similar(a, b, n_a, n_b, percent: int) -> np.ndarray:
    wanted = percent / 100
    found, used = estimate(a, b, n_a, n_b)
    error = np.sqrt(wanted * (1 - wanted) / np.maximum(used, 1))
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return (found >= wanted - _ERRORS * error) & sizes


def signatures(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """``id, hash, set, n, codes, bands`` of every row: hashes of the text and of its whole set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch["text"]:
                s = shingle_set(value, k)
                codes = registers(s)
                rows.append((_set_id(s), len(s), codes.tobytes() if len(s) else None,
                             band_keys(s, codes).view(np.int64) if len(s) else None))
            out = pd.DataFrame(rows, columns=["set", "n", "codes", "bands"])
            yield pd.concat([batch[["id", "hash"]].reset_index(drop=True), out], axis=1)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    return rows.mapInPandas(
        sign, f"id {kind}, hash bigint, set bigint, n bigint, codes binary, bands array<bigint>")


def _set_id(shingles: np.ndarray) -> int:
    """64-bit hash of a set from the sums of two independent mixes of its members."""
    sums = np.array([mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64),
                     mix(shingles + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)])
    one, two = mix(sums + np.uint64(len(shingles)))
    return int(mix(np.array([one ^ (two >> np.uint64(1))])).view(np.int64)[0])


def _checked(table: DataFrame) -> DataFrame:
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if small else table


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among ``a, b`` by their whole sets."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: OrderedDict[int, np.ndarray] = OrderedDict()

        def get(i: int, text: str) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(text, k)
                if len(sets) > _CACHED_SETS:
                    sets.popitem(last=False)
            else:
                sets.move_to_end(i)
            return sets[i]

        for batch in batches:
            keep = []
            for a, b, s, t in zip(batch["a"], batch["b"], batch["ta"], batch["tb"]):
                keep.append(_linked(get(a, s), get(b, t), percent))
            yield batch.loc[keep, ["a", "b"]]

    with_texts = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("set").alias("b"), F.col("text").alias("tb")), "b")
    return with_texts.select("a", "b", "ta", "tb").mapInPandas(confirm, "a bigint, b bigint")


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be similar by their registers."""

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), -1)
                        for c in ("ca", "cb"))
                sizes = [batch[c].to_numpy(np.float64) for c in ("na", "nb")]
                yield batch.loc[may_be_similar(a, b, *sizes, percent), ["a", "b"]]

    side = {c: sketches.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("codes").alias(f"c{c}"))
            for c in "ab"}
    rows = pairs.join(side["a"], "a").join(side["b"], "b")
    sized = rows.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "ca", "cb").mapInPandas(likely, "a bigint, b bigint")


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("a").alias("set"), F.col("b").alias("label"))
    return buckets.join(known, "set", "left").withColumn("label", F.coalesce("label", "set"))


def _star(buckets: DataFrame) -> DataFrame:
    """Each class of a bucket with the bucket's centre."""
    centre = buckets.groupBy("key").agg(F.min("set").alias("a"))
    rows = buckets.join(centre, "key").where("a != set")
    return rows.select("a", F.col("set").alias("b")).distinct()


def _open_rows(members: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with the largest one's label.

    A bucket of two needs no look: one of them was the centre.
    """
    counts = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    several = counts.groupBy("key").agg(F.max_by("label", "n").alias("top"), F.sum("n").alias("size"),
                                        F.count("*").alias("labels"))
    wanted = several.where((F.col("labels") > 1) & (F.col("size") > 2)).select("key", "top")
    return members.join(wanted, "key")


def _whole_sets(classes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["set"], batch["text"]):
                s = shingle_set(text, k)
                codes = registers(s)
                rows.append((i, len(s), codes.tobytes(), band_keys(s, codes).tobytes(), s.tobytes()))
            yield pd.DataFrame(rows, columns=["set", "n", "codes", "bands", "hashes"])

    return texts.join(classes, "set", "left_semi").mapInPandas(
        read, "set bigint, n bigint, codes binary, bands binary, hashes binary")


def _left_apart(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket.

    In every bucket the classes outside its largest component meet all others, block against block.
    Registers choose the pairs, the first band that two classes share decides which bucket compares
    them, and their whole sets confirm. One link from a class to a component is enough.
    """
    rows = opened.join(sets, "set")
    sizes = rows.groupBy("key").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("label") != F.col("top"), F.col("n"))).alias("others"))
    sized = rows.join(sizes, "key")

    def blocks(part: DataFrame, total: str, limit: int, name: str) -> DataFrame:
        number = F.pmod(F.xxhash64("set"), F.ceil(F.col(total) / limit)).alias("block")
        items = F.collect_list(F.struct("set", "label", "n", "codes", "bands", "hashes")).alias(name)
        return part.groupBy("key", number).agg(items).drop("block")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unpack(items):
            def rows_of(name, kind):
                return np.frombuffer(b"".join(i[name] for i in items), kind).reshape(len(items), -1)

            return (np.array([i["set"] for i in items]), np.array([i["label"] for i in items]),
                    np.array([i["n"] for i in items], np.float64), rows_of("codes", np.uint16),
                    rows_of("bands", np.int64), [np.frombuffer(i["hashes"], np.uint64) for i in items])

        for batch in batches:
            for key, few, many in zip(batch["key"], batch["few"], batch["many"]):
                s, ls, ns, cs, bs, hs = unpack(few)
                t, lt, nt, ct, bt, ht = unpack(many)
                out = []
                for i in range(len(s)):
                    near = (lt != ls[i]) & may_be_similar(cs[i][None, :], ct, np.full(len(t), ns[i]), nt, percent)
                    met: set[int] = set()
                    for j in np.flatnonzero(near):
                        if lt[j] in met or bs[i][(bs[i] == bt[j]).argmax()] != key:
                            continue
                        if _linked(hs[i], ht[j], percent):
                            met.add(lt[j])
                            out.append((s[i], t[j]))
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    few = blocks(sized.where("label != top"), "others", _FEW_HASHES, "few")
    joined = few.join(blocks(sized, "all", _MANY_HASHES, "many"), "key")
    return joined.select("key", "few", "many").mapInPandas(compare, "a bigint, b bigint")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows with whole texts or blocks go to Python few at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _classified(docs: DataFrame, shingle: int, percent: int, key: str, text: str) -> DataFrame:
    """``id, hash, n, component`` of every row."""
    spark = docs.sparkSession
    with small_batches(spark, _TEXT_BATCH):
        signed, _ = write_table(signatures(docs, shingle, key, text), "neardup-signatures")
    usable = signed.where("n > 0 and id is not null")
    first = usable.groupBy("set").agg(F.min(F.struct("id", "hash")).alias("first"))
    reps, _ = write_table(first.select("set", "first.id", "first.hash"), "neardup-classes")
    chosen = usable.join(reps, ["set", "id", "hash"], "left_semi")
    banded = chosen.select("set", F.explode("bands").alias("key")).distinct()
    shared = banded.groupBy("key").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo != hi")
    buckets, buckets_path = write_table(
        banded.join(shared.select("key"), "key", "left_semi"), "neardup-buckets")
    in_buckets = buckets.select("set").distinct()
    sketches, sketches_path = write_table(
        chosen.select("set", "n", "codes").join(in_buckets, "set", "left_semi").dropDuplicates(["set"]),
        "neardup-sketches")
    wanted = _checked(reps.join(in_buckets, "set", "left_semi"))
    sources = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    texts, texts_path = write_table(sources.where("text is not null").join(wanted, ["id", "hash"])
                                    .select("set", "text").dropDuplicates(["set"]), "neardup-texts")
    with small_batches(spark, _BATCH):
        pairs, pairs_path = write_table(_estimated(_star(buckets), sketches, percent), "neardup-pairs")
        star, star_path = write_table(_verify(pairs, texts, shingle, percent), "neardup-star")
    first, first_path = components(star)
    opened, opened_path = write_table(_open_rows(_labelled(buckets, first)), "neardup-open")
    with small_batches(spark, _BATCH):
        sets, sets_path = write_table(
            _whole_sets(opened.select("set").distinct(), texts, shingle), "neardup-sets")
    with small_batches(spark, _BLOCK_BATCH):
        rest, rest_path = write_table(_left_apart(opened, sets, percent), "neardup-rest")
    labels, _ = components(first.union(rest))
    for path in (buckets_path, sketches_path, texts_path, pairs_path, star_path, first_path, opened_path,
                 sets_path, rest_path):
        drop_table(spark, path)
    roots = _labelled(reps, labels)
    least = roots.groupBy("label").agg(F.min("id").alias("component"))
    of_set = roots.select("set", "label").join(least, "label").select("set", "component")
    columns = ["id", "hash", "n", "component"]
    linked = signed.where("n > 0 and id is not null").join(of_set, "set")
    alone = signed.where("not (n > 0 and id is not null)").withColumn("component", F.col("id"))
    return linked.select(*columns).union(alone.select(*columns))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``<key>, n_shingles, component_id, kept`` for every row of ``docs``.

    Two texts are linked if 100 * intersection is at least ``percent`` * union of their shingle sets.
    ``component_id`` is the smallest key reachable by links. Texts without words (also null) have the
    empty set and are linked with nothing; rows without a key are linked with nothing, have no
    component and are kept. Rows of one key with different texts are nodes of their own under that key.
    Other columns are not looked at.
    """
    found = _classified(docs, shingle, percent, key, text)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                        F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """``docs`` without those whose component has a smaller key; columns as they were.

    Rows that are equal in key and text are one document, of which one row stays.
    """
    # A row of four numbers per document, read three times: written, so that its joins run once.
    found, _ = write_table(_classified(docs, shingle, percent, key, text), "neardup-found")
    id_, hash_ = fresh(docs, "_id"), fresh(docs, "_hash")
    named = docs.withColumn(hash_, F.xxhash64(text))
    out = _checked(found.where("id != component").select(F.col("id").alias(id_), F.col("hash").alias(hash_))
                   .distinct())
    kept = named.join(out, (named[key] == out[id_]) & (named[hash_] == out[hash_]), "left_anti")
    again = found.where("id is not null and id = component").groupBy("id", "hash").agg(
        F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias(id_), F.col("hash").alias(hash_))
    if not again.isEmpty():
        same = (kept[key] == again[id_]) & (kept[hash_] == again[hash_])
        twice = kept.join(again, same, "left_semi").dropDuplicates([key, hash_])
        kept = kept.join(again, same, "left_anti").union(twice)
    return kept.drop(hash_)

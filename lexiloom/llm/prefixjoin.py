"""Jaccard join of n-gram sets by rare-first prefixes.

All sets are sorted by one order of n-grams, the rare ones first. Two sets that are similar enough must then
share an n-gram of their prefixes, the first ``n - ceil(percent * n / 100) + 1`` members. Sets that share one
are candidates if their sizes allow it (length filter) and enough members follow the shared place in
both (positional filter). A pair is verified once: first by a bit per bucket of its sets' hashes, the parity of
the members in it (bitmap filter), then, with the texts read again, by halving what follows around a common member
(suffix filter) and by the whole sets.

* Rarity is the count, over all documents, of the bucket an n-gram's hash falls into, in steps of half an octave;
  within a step the hash decides. Any order gives the same links, so buckets cost nothing but
  candidates; their number is a parameter, and their counts are all that reaches the driver.
* Equal sets are one class from the start, known by 128 bits of hash, so copies are never compared.
* Classes that share a prefix n-gram are not paired with each other: each meets one of the classes in which its
  n-grams stand first. Where that leaves several components, the classes outside the largest are compared, in blocks and
  by size and place only, with those of other components; what passes is verified too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import drop_table, write_table
from .components import components
from .neardup import shingle_set, small_batches
from .words import mix

#: Bits of a hash that choose the bucket of its count.
COUNTER_BITS = 20
_LEVEL_BITS = 6
#: Tables of up to this many rows of three numbers are broadcast, larger ones shuffled.
BROADCAST_ROWS = 200_000
#: Pairs of one set that share a copy of it, and rows of a block where classes of a hot n-gram meet.
_SHARED, _BLOCK = 256, 20_000
#: Pairs of a group up to which it goes with others in one step.
_CROSS = 4096
_TEXT_BATCH, _SET_BATCH, _BLOCK_BATCH = 1000, 64, 64
_MASK = (1 << 64) - 1


def prefix_length(n, percent: int):
    """How many of ``n`` members two sets of the wanted similarity cannot both avoid."""
    return n - -(-percent * n // 100) + 1


def least_overlap(n, m, percent: int):
    """The smallest intersection of sets of ``n`` and ``m`` members that is enough."""
    return -(-percent * (n + m) // (100 + percent))


def rarity(docs: DataFrame, width: int, text: str, bits: int = COUNTER_BITS) -> np.ndarray:
    """A level of 0 to 63 per bucket: half octaves of how many documents' n-grams fall into it."""
    if docs.isEmpty():
        return np.zeros(1 << bits, np.uint64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for value in batch["text"]:
                at, n = np.unique(shingle_set(value, width) >> np.uint64(64 - bits), return_counts=True)
                counts[at.astype(np.int64)] += n
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 1 << 16):
            part = at[i:i + (1 << 16)]
            yield pd.DataFrame({"bucket": part.astype(np.int32), "n": counts[part]})

    summed = docs.select(F.col(text).alias("text")).mapInPandas(count, "bucket int, n bigint").groupBy("bucket").agg(
        F.sum("n").alias("n"))
    level = F.least(F.floor(2 * F.log2("n")), F.lit((1 << _LEVEL_BITS) - 1)).cast("tinyint")
    table = summed.select("bucket", level.alias("level")).toArrow()
    levels = np.zeros(1 << bits, np.uint64)
    levels[table["bucket"].to_numpy()] = table["level"].to_numpy()
    return levels


def ordered_set(text: str | None, width: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's n-grams, and the same as codes sorted by rarity."""
    hashes = shingle_set(text, width)
    bits = len(levels).bit_length() - 1
    top = levels[(hashes >> np.uint64(64 - bits)).astype(np.int64)] << np.uint64(64 - _LEVEL_BITS)
    return hashes, np.sort(top | (hashes >> np.uint64(_LEVEL_BITS)))


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: sums of two mixes of its members."""
    size = np.uint64(len(hashes))
    sums = np.array([mix(hashes ^ np.uint64(0x8CB92BA72F3D8DD7)).sum(dtype=np.uint64) + size,
                     mix(hashes + np.uint64(0xAEF17502108EF2D9)).sum(dtype=np.uint64) ^ size])
    one, two = mix(sums).view(np.int64)
    return int(one), int(two)


def parities(hashes: np.ndarray, percent: int) -> bytes:
    """A bit per bucket of the hashes' low bits: whether an odd number of a set's members falls into it.

    A member that only one of two sets has flips one bit, so sets differ by at least as many members as bits. There are four
    buckets or more for every member by which similar sets of this size may differ: of unlike sets about
    half the bits differ.
    """
    wanted = -(-8 * len(hashes) * (100 - percent) // (100 + percent))
    buckets = 1 << max(6, (wanted - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """A lower bound of how many members only one of two sets has, by their parities. The longer are folded to
    the length of the shorter, which adds up the buckets that meet."""
    if len(x) < len(y):
        x, y = y, x
    a, bits = int.from_bytes(x, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ int.from_bytes(y, "little")).bit_count()


def _signed(docs: DataFrame, width: int, percent: int, key: str, text: str, shared) -> DataFrame:
    """``id, place, hash, s1, s2, n, bits, prefix`` of every row. ``place`` and ``hash`` find its text again."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = shared.value
        for batch in batches:
            rows = []
            for value in batch["text"]:
                hashes, codes = ordered_set(value, width, levels)
                prefix = codes[:prefix_length(len(codes), percent)] if len(codes) else codes
                rows.append((*_fingerprint(hashes), len(hashes), parities(hashes, percent), prefix.view(np.int64)))
            out = pd.DataFrame(rows, columns=["s1", "s2", "n", "bits", "prefix"])
            yield pd.concat([batch[["id", "place", "hash"]].reset_index(drop=True), out], axis=1)

    kind = docs.schema[key].dataType.simpleString()
    return _texts(docs, key, text).mapInPandas(
        sign, f"id {kind}, place bigint, hash bigint, s1 bigint, s2 bigint, n bigint, bits binary, prefix array<bigint>")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.xxhash64(key).alias("place"), F.xxhash64(text).alias("hash"),
                       F.col(text).alias("text"))


def _checked(table: DataFrame) -> DataFrame:
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if small else table


def _apart(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Pairs the length and the positional filter rule out."""
    return (100 * np.minimum(n, m) < percent * np.maximum(n, m)) | (
        np.minimum(n - i, m - j) < least_overlap(n, m, percent))


def _may_link(percent: int) -> str:
    return (f"100 * least(n, m) >= {percent} * greatest(n, m) and "
            f"least(n - i, m - j) >= ceil({percent} * (n + m) / {100 + percent}D)")


def _may_meet(lo: str, hi: str, reach: str, percent: int) -> str:
    """Whether a place can pass the filters with any of those whose sizes and remainders lie in these bounds."""
    return (f"100 * n >= {percent} * {lo} and {percent} * n <= 100 * {hi} and "
            f"least({reach}, n - i) >= ceil({percent} * ({lo} + n) / {100 + percent}D)")


def _unpack(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """``node, label, n, i`` of the members of all lists, and where each list begins and ends."""
    members = lists.values
    return np.array([members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n", "i")],
                    np.int64), lists.offsets.to_numpy().astype(np.int64)


def suffix_distance(x: np.ndarray, y: np.ndarray, limit: int, depth: int = 3) -> int:
    """A lower bound of how many members only one of two sorted sets has; exact once above ``limit`` or not split.

    A member of the middle splits both sets; parts on one side differ by their sizes at least.
    """
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    found = at < len(x) and x[at] == y[middle]
    left, right = (x[:at], y[:middle]), (x[at + found:], y[middle + 1:])
    sides = [abs(len(a) - len(b)) for a, b in (left, right)]
    own = 0 if found else 1
    if sum(sides) + own > limit:
        return sum(sides) + own
    near = suffix_distance(*left, limit - sides[1] - own, depth - 1)
    if near + sides[1] + own > limit:
        return near + sides[1] + own
    return near + own + suffix_distance(*right, limit - near - own, depth - 1)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share enough."""
    n, m = len(x), len(y)
    need = least_overlap(n, m, percent)
    if min(n, m) < need or suffix_distance(x, y, n + m - 2 * need) > n + m - 2 * need:
        return False
    if n > m:
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()) >= need


class _Join:
    """The steps of one join, which share settings and temporary tables."""

    def __init__(self, docs: DataFrame, width: int, percent: int, key: str, text: str):
        self.docs, self.width, self.percent, self.key, self.text = docs, width, percent, key, text
        self.spark = docs.sparkSession
        self.paths: list[str] = []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        written, path = write_table(df, f"join-{label}")
        self.paths.append(path)
        return written

    def shared_places(self, classes: DataFrame) -> DataFrame:
        """``token, node, n, i`` of the prefix n-grams that several classes have, and the class in which the
        n-gram stands first as ``a, m, j``. All of it comes from one exchange by n-gram."""
        places = classes.select("node", "n", F.posexplode("prefix").alias("i", "token"))
        same = Window.partitionBy("token")
        met = places.select("token", "node", "n", "i", F.count("*").over(same).alias("c"),
                            F.min(F.struct("i", "node", "n")).over(same).alias("f")).where("c > 1")
        return self.table(met.select("token", "node", "n", "i", F.col("f.node").alias("a"), F.col("f.n").alias("m"),
                                     F.col("f.i").alias("j")), "places")

    def with_first(self, places: DataFrame) -> DataFrame:
        """For every class ``b`` one of those that stand first for its n-grams, past the filters: the ``a`` that does so
        for most of them. One partner joins near copies to their group. What it leaves apart meets later, also where an n-gram has two classes
        only and the second chose another partner."""
        met = places.where("a != node").where(_may_link(self.percent)).groupBy("node", "a").agg(F.count("*").alias("c"))
        best = met.groupBy("node").agg(F.max(F.struct("c", "a")).alias("best"))
        return best.select("best.a", F.col("node").alias("b"))

    def across(self, places: DataFrame, labels: DataFrame, tried: DataFrame) -> DataFrame:
        """Pairs of different components that share a prefix n-gram, past the filters and not tried yet."""
        labelled = places.select("token", "node", "n", "i").join(labels.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left") \
            .withColumn("label", F.coalesce("label", "node"))
        # The one exchange of all that follows, as long as each part takes the same columns and filters from it: members are
        # counted by their node, which is never null, and those of the top left out by a comparison that infers no filter.
        labelled = labelled.repartition("token")
        # What a token's largest component could meet outside it, and the others anywhere.
        reach = F.max(F.col("n") - F.col("i")).alias("reach")
        sizes = labelled.groupBy("token", "label").agg(
            F.count("node").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), reach)
        place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("c"), "label"))
        ranked = sizes.withColumn("place", place)
        outside = F.col("place") > 1
        opened = ranked.groupBy("token").agg(
            F.max(F.when(~outside, F.col("label"))).alias("top"), F.sum("c").alias("all"),
            F.sum(F.when(outside, F.col("c"))).alias("others"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.max("reach").alias("reach"), F.min(F.when(outside, F.col("lo"))).alias("o_lo"),
            F.max(F.when(outside, F.col("hi"))).alias("o_hi"), F.max(F.when(outside, F.col("reach"))).alias("o_reach"),
            F.count("*").alias("labels")).where("labels > 1")
        rows = labelled.join(opened, "token").where(
            f"if(label = top, {_may_meet('o_lo', 'o_hi', 'o_reach', self.percent)}, "
            f"{_may_meet('lo', 'hi', 'reach', self.percent)})")
        percent = self.percent

        def blocks(part: DataFrame, total: str, name: str) -> DataFrame:
            number = F.pmod(F.xxhash64("node"), F.ceil(F.col(total) / _BLOCK)).alias("block")
            return part.groupBy("token", number).agg(F.collect_list(F.struct("node", "label", "n", "i")).alias(name))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def near(x: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
                ok = (x[1] != t[1]) & ~_apart(x[2], t[2], x[3], t[3], percent)
                low, high = np.minimum(x[0], t[0])[ok], np.maximum(x[0], t[0])[ok]
                return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                (few, at), (many, to) = _unpack(batch.column(0)), _unpack(batch.column(1))
                # Groups of few members, which most are, pair in one step for the whole batch.
                widths, pairs = np.diff(to), np.diff(at) * np.diff(to)
                small = np.where(pairs <= _CROSS, pairs, 0)
                group = np.repeat(np.arange(len(small)), small)
                place = np.arange(len(group)) - np.repeat(np.cumsum(small) - small, small)
                yield near(few[:, at[group] + place // widths[group]], many[:, to[group] + place % widths[group]])
                for k in np.flatnonzero(pairs > _CROSS):
                    t = many[:, to[k]:to[k + 1]]
                    t = t[:, np.argsort(t[2], kind="stable")]
                    for x in few[:, at[k]:at[k + 1]].T:
                        lo, hi = np.searchsorted(t[2], [-(-percent * x[2] // 100), 100 * x[2] // percent + 1])
                        yield near(x[:, None], t[:, lo:hi])

        few = blocks(rows.where("not (label <=> top)"), "others", "few")
        met = few.join(blocks(rows, "all", "many"), "token").select("few", "many").mapInArrow(
            meet, "a bigint, b bigint").distinct()
        with small_batches(self.spark, _BLOCK_BATCH):
            known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            return self.table(met.join(known, ["a", "b"], "left_anti"), "across")

    def sides(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``node, a, part, b`` of every class that ``pairs`` need: as ``b`` once a pair, as ``a``, with -1 for ``b``, once per
        ``_SHARED`` pairs."""
        counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / _SHARED).alias("parts"))
        second = pairs.join(counts, "a").select(
            F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
        first = counts.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                              F.lit(-1).cast("bigint").alias("b"))
        return second, first

    def likely(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs that the parities of their sets do not rule out. Only for these whole sets are sent."""
        percent = self.percent

        def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                n, m = batch["n"], batch["m"]
                apart = [parity_distance(x, y) for x, y in zip(batch["bits"], batch["own"])]
                yield batch.loc[apart <= n + m - 2 * least_overlap(n, m, percent), ["a", "b"]]

        second, first = self.sides(pairs)
        bits = classes.select("node", "n", "bits")
        own = first.join(bits, "node").select("a", "part", F.col("n").alias("m"), F.col("bits").alias("own"))
        met = second.join(bits, "node").join(own, ["a", "part"]).select("a", "b", "n", "m", "bits", "own")
        with small_batches(self.spark, _TEXT_BATCH):
            return self.table(met.mapInPandas(close, "a bigint, b bigint"), "likely")

    def verified(self, pairs: DataFrame, classes: DataFrame, shared) -> DataFrame:
        """Links among ``pairs`` by their whole sets. A set goes from its text straight to the sides it is needed for."""
        width, percent = self.width, self.percent

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, codes = None, b""
            sent = set()  # rows equal in key and text would send the same set again
            for batch in batches:
                out = []
                for node, a, part, b, text in zip(*(batch[c] for c in ("node", "a", "part", "b", "text"))):
                    if (a, part, b) in sent:
                        continue
                    sent.add((a, part, b))
                    if node != known:  # the rows of one text follow each other
                        known, codes = node, ordered_set(text, width, shared.value)[1].tobytes()
                    out.append((a, part, b, codes))
                yield pd.DataFrame(out, columns=["a", "part", "b", "codes"])

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = None
            for batch in batches:
                out = []
                for a, b, codes in zip(batch["a"], batch["b"], batch["codes"]):
                    codes = np.frombuffer(codes, np.uint64)
                    if b < 0:
                        own = codes
                    elif similar(own, codes, percent):
                        out.append((a, b))
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        second, first = self.sides(self.likely(pairs, classes))
        wanted = _checked(self.table(second.union(first).join(classes.select("node", "place", "hash"), "node"), "wanted"))
        found = _texts(self.docs, self.key, self.text).where("text is not null").join(wanted, ["place", "hash"])
        sets = found.select("node", "a", "part", "b", "text").mapInPandas(
            read, "a bigint, part bigint, b bigint, codes binary")
        rows = sets.repartition("a", "part").sortWithinPartitions("a", "part", "b")
        with small_batches(self.spark, _SET_BATCH):
            return self.table(rows.select("a", "b", "codes").mapInPandas(compare, "a bigint, b bigint"), "links")


def join_classes(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
                 bits: int = COUNTER_BITS) -> DataFrame:
    """``<key>, n_shingles, component_id`` for every row of ``docs``.

    Two texts are linked if 100 * intersection is at least ``percent`` * union of their sets of ``width``-word
    n-grams, A-Z lower-cased; a text of fewer words is one n-gram. ``component_id`` is the smallest key reachable by
    links. Texts without words (also null) have the empty set and are linked with nothing; rows without a key
    are linked with nothing and have no component. Rows of one key with different texts are nodes of
    their own under that key. Other columns are not looked at; no rows give no rows.
    """
    join = _Join(docs, width, percent, key, text)
    spark = docs.sparkSession
    with small_batches(spark, _TEXT_BATCH):
        shared = spark.sparkContext.broadcast(rarity(docs, width, text, bits))
        signed, _ = write_table(_signed(docs, width, percent, key, text, shared), "join-signed")
    usable = F.expr("n > 0 and id is not null")
    classes = signed.where(usable).groupBy("s1", "s2").agg(
        F.min(F.struct("id", "place", "hash")).alias("first"), F.first("n").alias("n"),
        F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    classes = join.table(classes.select("s1", "s2", "n", "bits", "prefix", "first.*").withColumn(
        "node", F.monotonically_increasing_id()), "classes")
    places = join.shared_places(classes)
    tried = join.table(join.with_first(places), "tried")
    near = join.verified(tried, classes, shared)
    labels, labels_path = components(near)
    more = join.verified(join.across(places, labels, tried), classes, shared)
    roots, roots_path = components(labels.union(more))
    named = classes.select("s1", "s2", "id", "node").join(
        roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    of_class, _ = write_table(named.join(least, "root").select("s1", "s2", "component"), "join-components")
    for path in (*join.paths, labels_path, roots_path):
        drop_table(spark, path)
    linked = signed.where(usable).join(of_class, ["s1", "s2"]).select("id", "n", "component")
    alone = signed.where(~F.coalesce(usable, F.lit(False))).select("id", "n", F.col("id").alias("component"))
    return linked.union(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                                      F.col("component").alias("component_id"))

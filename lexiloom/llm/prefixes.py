"""Prefix trie of conversations, built as burst tries.

A conversation is a sequence of turns, a turn is known by the MD5 of its role and text. A container is a
trie head with the suffixes of all conversations that go through it. Containers with too many suffixes
burst: the head becomes a node of its own and its suffixes move to one container per next turn. What is left is
dealt to shards by head, sorted by the turns of the suffix, and swept once with a stack of open nodes.

* Equal conversations are one class from the start, known by the exclusive or of two hashes of turn and
  place. Only classes go into the trie; each carries how many conversations it stands for.
* Suffixes are held in pieces of ``piece`` turns, so no row grows with a conversation. The piece that begins
  at a depth belongs to the container of all that came there the same way. Pieces are swept from the deepest
  shared one up, and hand what lies below them to the piece above; a conversation that is alone from some depth on
  needs no look below, its totals are known beforehand.
* The ids that end at a node are put together in ranges of ids and hashed range by range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.index import with_row_index
from ..storage import drop_table, write_table

#: Suffixes a container may hold before it bursts, turns in a piece, and ids in a range.
CONTAINER, PIECE, RANGE = 1000, 64, 4096
#: Tables of up to this many rows of three numbers are broadcast, larger ones shuffled.
BROADCAST_ROWS = 200_000
_NOBODY = hashlib.sha256(b"").hexdigest()
_HEAD = ["d", "p1", "p2"]
_NODE = ("conv bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved bigint, ends string, turn_id string")


def number_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """``conv, k, t, size``: the turns of every conversation from 1 on, with id and UTF-8 bytes of the text.

    Turns are in order of ``turn``, null first, equal ones by id. Null roles and texts are empty; rows without
    a conversation are left out; repeated rows stay.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    known = F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), known.alias("t"),
        F.octet_length(text_).cast("bigint").alias("size"))
    rows, path = write_table(rows, "trie-turns")
    numbered, _ = write_table(with_row_index(rows, ["turn", "t"], "k", within=["conv"]).select(
        "conv", (F.col("k") + 1).alias("k"), "t", "size"), "trie-numbered")
    drop_table(df.sparkSession, path)
    return numbered


def share_heads(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of another, and the table of all conversations (``conv``).

    Conversation c begins with the first h turns of conversation c - c % every, h = crc32(c) % most, and goes
    on with its own turns after its first h.
    """
    first = F.when(F.col("k") < most, F.struct("k", "t", "size"))
    own, _ = write_table(turns.groupBy("conv").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(first)).alias("head")), "trie-heads")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = own.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    bases = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), "head")
    based = convs.join(bases, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    begun = based.where("taken > 0").select("conv", F.inline(F.slice("head", F.lit(1), F.col("taken").cast("int"))))
    shifts = _checked(based.select("conv", "h", "taken"))
    rest = turns.join(shifts, "conv").where("k > h").select("conv", (F.col("k") - F.col("h") + F.col("taken")).alias(
        "k"), "t", "size")
    rebuilt, _ = write_table(begun.select("conv", "k", "t", "size").unionByName(rest), "trie-rebuilt")
    return rebuilt, own.select("conv")


def _checked(table: DataFrame) -> DataFrame:
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if small else table


def _pieces(turns: DataFrame, piece: int) -> DataFrame:
    """Turns in pieces, with the exclusive or of two hashes of turn and place."""
    hashed = turns.withColumns({"x1": F.xxhash64("k", "t"), "x2": F.xxhash64("t", "k", F.lit(7)),
                                "j": F.floor((F.col("k") - 1) / piece)})
    listed = F.sort_array(F.collect_list(F.struct("k", "t", "size")))
    return hashed.groupBy("conv", "j").agg(
        listed.alias("part"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("size").alias("bytes"),
        F.count("*").alias("n"))


def _end_hashes(members: DataFrame) -> DataFrame:
    """``n, x1, x2, ends``: SHA-256 of the ids of every class, ascending and joined by commas.

    Ids come in strings of a range each, so the task that hashes a large class reads few rows, one at a time.
    """
    ranges = members.groupBy("n", "x1", "x2", F.floor(F.col("conv") / RANGE).alias("range")).agg(
        F.concat_ws(",", F.sort_array(F.collect_list("conv")).cast("array<string>")).alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for n, x1, x2, ids in zip(batch["n"], batch["x1"], batch["x2"], batch["ids"]):
                if key == (n, x1, x2):
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (n, x1, x2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["n", "x1", "x2", "ends"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["n", "x1", "x2", "ends"])

    ordered = ranges.repartition("n", "x1", "x2").sortWithinPartitions("n", "x1", "x2", "range")
    return ordered.select("n", "x1", "x2", "ids").mapInPandas(
        digest, "n bigint, x1 bigint, x2 bigint, ends string")


@dataclass
class _Open:
    """A node of which the sweep has not seen the end."""

    depth: int
    size: int
    turn_id: str | None
    conv: int | None = None
    n_convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str = _NOBODY
    below: bool = False
    rows: list = field(default_factory=list)

    def take(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n_convs += n

    def close(self, out: list) -> tuple:
        """The node's row without its parent; the rows of its children, now with theirs, go out."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n_convs - 1) * self.size
        out.extend((conv, depth, self.conv, *rest) for conv, depth, *rest in self.rows)
        return (self.conv, self.depth, self.n_convs, self.children, self.leaves, self.saved, self.ends, self.turn_id)


def _close(stack: list[_Open], out: list) -> None:
    row = stack[-1].close(out)
    done = stack.pop()
    above = stack[-1]
    above.rows.append(row)
    above.take(done.conv, done.n_convs)
    above.children += 1
    above.leaves += done.leaves
    above.saved += done.saved


_SWEPT = _NODE + ", d bigint, p1 bigint, p2 bigint, up1 bigint, up2 bigint, size bigint"
_COLUMNS = [c.split()[0] for c in _SWEPT.split(", ")]


def _sweep(rows: DataFrame) -> DataFrame:
    """Nodes of all containers; heads carry their container and have no parent yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, head, stack, path = None, (), [], []

        def finish(out: list) -> None:
            if key is None:
                return
            while len(stack) > 1:
                _close(stack, out)
            conv, depth, *rest = stack[0].close(out)
            out.append((conv, depth, None, *rest, *key, *head))

        def frame(out: list) -> pd.DataFrame:
            return pd.DataFrame([r + (None,) * (len(_COLUMNS) - len(r)) for r in out], columns=_COLUMNS, dtype=object)

        for batch in batches:
            out: list = []
            for r in batch.itertuples(index=False):
                if key != (r.d, r.p1, r.p2):
                    finish(out)
                    key, path = (r.d, r.p1, r.p2), []
                    head = (None, None, r.size) if r.top else (r.up1, r.up2, r.size)
                    stack = [_Open(r.d, r.size, r.turn_id, r.ended)]
                ts = r.ts
                at = 0
                while at < min(len(path), len(ts)) and path[at] == ts[at]:
                    at += 1
                while len(stack) - 1 > at:
                    _close(stack, out)
                stack.extend(_Open(r.d + i + 1, int(r.sizes[i]), ts[i]) for i in range(at, len(ts)))
                path = ts
                node = stack[-1]
                node.take(r.rep, r.m)
                if r.ends is not None:
                    node.ends = r.ends
                elif not node.below:
                    node.below = True
                    node.children += int(r.b_children)
                    node.leaves += int(r.b_leaves)
                    node.saved += int(r.b_saved)
            yield frame(out)
        out = []
        finish(out)
        yield frame(out)

    # No nulls among the numbers: pandas would make them floats.
    plain = rows.withColumns({"top": F.col("up1").isNull(), "ended": F.coalesce("ended", "rep")}).na.fill(0, ["up1", "up2", "b_children", "b_leaves", "b_saved"])
    sharded = plain.repartition(*_HEAD).sortWithinPartitions(*_HEAD, "ts")
    return sharded.mapInPandas(run, _SWEPT)


def _burst(rows: DataFrame, container: int) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """Containers small enough to sweep, and the heads of those that burst, level by level."""
    heads, paths = [], []
    done = None
    while True:
        big = _checked(rows.where(F.size("ts") > 0).groupBy(*_HEAD).agg(F.count("*").alias("c")).where(
            F.col("c") > container).drop("c"))
        if big.isEmpty():
            return (rows if done is None else done.union(rows)), heads, paths
        small = rows.join(big, _HEAD, "left_anti").select(*rows.columns)
        hot = rows.join(big, _HEAD, "left_semi").select(*rows.columns)
        below = F.when((F.size("ts") == 0) & F.col("ends").isNull(), F.struct("b_children", "b_leaves", "b_saved"))
        level, path = write_table(hot.groupBy(*_HEAD, "up1", "up2", "size", "turn_id").agg(
            F.min(F.least("rep", "ended")).alias("conv"), F.sum("m").alias("n_convs"), F.max(below).alias("below"),
            F.max(F.when(F.size("ts") == 0, F.col("ends"))).alias("ends")), "trie-burst")
        heads.append(level)
        k, t = F.col("d") + 1, F.get("ts", F.lit(0))
        moved = hot.where(F.size("ts") > 0).withColumns({
            "up1": F.col("p1"), "up2": F.col("p2"), "p1": F.col("p1").bitwiseXOR(F.xxhash64(k, t)),
            "p2": F.col("p2").bitwiseXOR(F.xxhash64(t, k, F.lit(7))), "d": k, "size": F.get("sizes", F.lit(0)),
            "ended": F.lit(None).cast("bigint"),
            "turn_id": t, "ts": F.slice("ts", F.lit(2), F.size("ts")), "sizes": F.slice("sizes", F.lit(2), F.size("ts"))})
        done = small if done is None else done.union(small)
        rows, moved_path = write_table(moved, "trie-moved")
        paths += [path, moved_path]


def _totals(heads: list[DataFrame], swept: DataFrame, paths: list[str]) -> DataFrame:
    """All heads with what lies below them, the bursts from the deepest level up."""
    closed = swept.where("d is not null").drop("parent", "depth")
    for level in reversed(heads):
        below = closed.where("up1 is not null").groupBy(
            (F.col("d") - 1).alias("d"), F.col("up1").alias("p1"), F.col("up2").alias("p2")).agg(
            F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        summed = level.join(below, _HEAD, "left")
        children = F.coalesce("c", F.lit(0)) + F.coalesce("below.b_children", F.lit(0))
        leaves = F.coalesce("l", F.lit(0)) + F.coalesce("below.b_leaves", F.lit(0))
        saved = F.coalesce("s", F.lit(0)) + F.coalesce("below.b_saved", F.lit(0))
        whole, path = write_table(summed.select(
            "conv", "n_convs", children.alias("n_children"), F.when(children > 0, leaves).otherwise(1).alias("n_leaves"),
            (saved + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
            F.coalesce("ends", F.lit(_NOBODY)).alias("ends"), "turn_id", *_HEAD, "up1", "up2", "size"), "trie-level")
        paths.append(path)
        closed = closed.unionByName(whole)
    return closed


def build_trie(turns: DataFrame, convs: DataFrame, container: int = CONTAINER, piece: int = PIECE) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv, k, t, size: numbered from 1) over all of ``convs`` (conv).

    Gives ``conv, depth, parent, n_convs, n_children, n_leaves, saved, ends, turn_id``: smallest conversation
    through the node, depth, smallest conversation through its parent (root: null), conversations
    through it, children, childless nodes in its subtree, bytes of last texts that all but one conversation
    share, summed over its subtree, SHA-256 of the ids ending there, and the id of its last turn. A
    conversation without turns ends at the root. No conversations give no rows.
    """
    spark = turns.sparkSession
    parts, parts_path = write_table(_pieces(turns, piece), "trie-pieces")
    whole = parts.groupBy("conv").agg(F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"),
                                      F.sum("bytes").alias("total"))
    zero = F.lit(0).cast("bigint")
    members, members_path = write_table(convs.distinct().join(whole, "conv", "left").na.fill(0), "trie-members")
    classes = members.groupBy("n", "x1", "x2").agg(
        F.min("conv").alias("rep"), F.count("*").alias("m"), F.max("total").alias("total"))
    classes, classes_path = write_table(classes.join(_end_hashes(members), ["n", "x1", "x2"]).select(
        "rep", "m", F.col("n").alias("length"), "total", "ends", "x1", "x2"), "trie-classes")
    # Where each piece begins: how its conversation came there, and the bytes before.
    earlier = Window.partitionBy("conv").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    stats = parts.select("conv", "j", "x1", "x2", "bytes", "n").join(
        classes.select(F.col("rep").alias("conv"), "m", "length", "total", "ends"), "conv").select(
        "conv", "j", "m", "length", "ends", F.coalesce(F.bit_xor("x1").over(earlier), zero).alias("p1"),
        F.coalesce(F.bit_xor("x2").over(earlier), zero).alias("p2"), "x1", "x2",
        (F.col("total") - F.coalesce(F.sum("bytes").over(earlier), zero) - F.col("bytes")).alias("after"))
    stats, stats_path = write_table(stats, "trie-places")
    alone = stats.where("j > 0").groupBy("j", "p1", "p2").agg(F.count("*").alias("c"), F.min("conv").alias("conv")).where(
        "c = 1").groupBy("conv").agg(F.min("j").alias("alone"))
    # Conversations that end where a piece begins have none there, but may be the smallest at its head.
    ended = classes.where(f"length > 0 and length % {piece} = 0").select(
        F.expr(f"length div {piece}").alias("j"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("rep").alias("ended"))
    rows = stats.join(alone, "conv", "left").join(parts.select("conv", "j", "part"), ["conv", "j"]).join(
        ended, ["j", "p1", "p2"], "left")
    going_on = F.col("length") > (F.col("j") + 1) * piece
    next_alone = going_on & F.coalesce(F.col("j") + 1 >= F.col("alone"), F.lit(False))
    rows = rows.select(
        "j", (F.col("j") * piece).alias("d"), "p1", "p2", F.lit(None).cast("bigint").alias("up1"),
        F.lit(None).cast("bigint").alias("up2"), zero.alias("size"), F.lit(None).cast("string").alias("turn_id"),
        F.col("conv").alias("rep"), "m", "ended", F.when(~going_on, F.col("ends")).alias("ends"),
        F.col("part.t").alias("ts"), F.col("part.size").alias("sizes"),
        F.when(next_alone, 1).cast("bigint").alias("b_children"), F.when(next_alone, 1).cast("bigint").alias("b_leaves"),
        F.when(next_alone, (F.col("m") - 1) * F.col("after")).alias("b_saved"),
        F.coalesce(F.col("j") >= F.col("alone"), F.lit(False)).alias("alone"),
        F.col("p1").bitwiseXOR(F.col("x1")).alias("n1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("n2"))
    silent = classes.where("length = 0").select(
        *[zero.alias(c) for c in ("j", "d", "p1", "p2")], *[F.lit(None).cast("bigint").alias(c) for c in ("up1", "up2")],
        zero.alias("size"), F.lit(None).cast("string").alias("turn_id"), "rep", "m",
        F.lit(None).cast("bigint").alias("ended"), "ends", F.array().cast("array<string>").alias("ts"), F.array().cast("array<bigint>").alias("sizes"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("b_children", "b_leaves", "b_saved")],
        F.lit(False).alias("alone"), zero.alias("n1"), zero.alias("n2"))
    rows, rows_path = write_table(rows.unionByName(silent), "trie-suffixes")
    for path in (parts_path, members_path, classes_path, stats_path):
        drop_table(spark, path)
    last = rows.where("not alone").agg(F.max("j")).first()[0]
    nodes, below = [], None
    for j in range(last if last is not None else -1, -1, -1):
        stage = rows.where((F.col("j") == j) & ~F.col("alone") | (F.col("alone") if j == last else F.lit(False)))
        if below is not None:
            found = below.select(F.col("p1").alias("n1"), F.col("p2").alias("n2"), F.col("n_children").alias("f1"),
                                 F.col("n_leaves").alias("f2"), F.col("saved").alias("f3"))
            stage = stage.join(_checked(found), ["n1", "n2"], "left").withColumns({
                "b_children": F.coalesce("b_children", "f1"), "b_leaves": F.coalesce("b_leaves", "f2"),
                "b_saved": F.coalesce("b_saved", "f3")}).drop("f1", "f2", "f3")
        stage = stage.drop("j", "alone", "n1", "n2")
        small, heads, paths = _burst(stage, container)
        swept, _ = write_table(_sweep(small), "trie-swept")
        closed = _totals(heads, swept, paths)
        nodes.append(swept.where("d is null").select(*_COLUMNS[:9]))
        burst = heads[0].select(*_HEAD, "conv") if heads else None
        for level in heads[1:]:
            burst = burst.union(level.select(*_HEAD, "conv"))
        inner = closed.where("up1 is not null").withColumns({"depth": F.col("d"), "d": F.col("d") - 1})
        if burst is not None:
            parents = burst.toDF("d", "up1", "up2", "parent")
            inner, _ = write_table(inner.join(parents, ["d", "up1", "up2"]).select(*_COLUMNS[:9]), "trie-inner")
            nodes.append(inner)
        below, _ = write_table(closed.where("up1 is null").select(*_COLUMNS[:1], *_COLUMNS[3:9], *_HEAD), "trie-roots")
        for path in paths:
            drop_table(spark, path)
        below_all, below = below, below.where(F.col("d") == j * piece)
        if j == 0:
            nodes.append(below.select("conv", zero.alias("depth"), F.lit(None).cast("bigint").alias("parent"),
                                      *_COLUMNS[3:9]))
    drop_table(spark, rows_path)
    if not nodes:
        return spark.createDataFrame([], _NODE)
    out = nodes[0]
    for more in nodes[1:]:
        out = out.union(more)
    return out


def node_texts(nodes: DataFrame, df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """``nodes`` with the role and text of their last turn; the root has neither."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    known = F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"))
    texts = df.select(known.alias("turn_id"), role_.alias("role"), text_.alias("text")).dropDuplicates(["turn_id"])
    return nodes.join(texts, "turn_id", "left")

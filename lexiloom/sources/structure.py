"""Where JSON values end in files that are read in splits.

A piece of a file (a line, or what lies between two closing brackets) acts on the state of a JSON reader,
which is whether it stands inside a string and how deep the brackets are. What a piece does is known before
the state is: its quotes flip the one, and there is a change of depth for either start. These maps are composed
inside each stretch of a split, one row per stretch is composed over the file, and a join carries it back, so no task
need hold more than a stretch and no text is put together before its borders are known. The files are scanned once,
into a table of the pieces with their effects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import write_table

#: Splits are cut further into stretches of this many rows, in bits, so that what a task sorts does not depend on the
#: splits' size. A split is known by a hash of its file, since sorting by long paths is slow.
_STRETCH_BITS = 15
_SPLIT = ("file_id", "block", "stretch")


def _windows():
    within = Window.partitionBy(*_SPLIT, "local").orderBy("pos")
    return within, within.rowsBetween(Window.unboundedPreceding, -1)


def _depth_change(text: Column) -> Column:
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _effects(text: Column) -> list[Column]:
    """Quotes of a piece, and its change of depth if it begins outside or inside a string."""
    spans = F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"', -1)

    def every_other(first: int) -> Column:
        kept = F.filter(spans, lambda _, i: i % 2 == first)
        return _depth_change(F.array_join(kept, ""))

    return [(F.size(spans) - 1).cast("bigint").alias("quotes"), every_other(0).cast("bigint").alias("outside"),
            every_other(1).cast("bigint").alias("inside")]


def _carried(blocks: DataFrame, values: Sequence[str]) -> DataFrame:
    """Per split, ``first_frame`` and what earlier splits hold of that frame, as ``c_<value>``.

    ``blocks`` has ``opened``, the number of frames a split opens, and the sums of its last frame.
    """
    order = Window.partitionBy("file_id").orderBy("block", "stretch")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    framed = blocks.withColumn("first_frame", F.coalesce(F.sum("opened").over(earlier), F.lit(0))) \
        .withColumn("frame", F.col("first_frame") + F.col("opened"))
    same = Window.partitionBy("file_id", "frame").orderBy("block", "stretch").rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        framed = framed.withColumn(v, F.sum(v).over(same))
    return framed.select("*", *[F.lag(v, 1, 0).over(order).alias(f"c_{v}") for v in values])


def with_structure(pieces: DataFrame, opens: Column, text: Column, flag: Column | None = None) -> DataFrame:
    """Add ``file_id``, ``stretch``, ``local``, ``frame``, ``in_string``, ``depth``, ``object_file`` and ``broken``.

    A piece for which ``opens`` is true starts a frame, outside strings and at depth 0. ``in_string`` and
    ``depth`` are the state after ``text``, the piece with its end mark. ``object_file`` tells that the first piece
    begins with a brace, ``n_flag`` counts the earlier pieces of the frame that have ``flag``, ``broken`` tells that the file ends inside something; its last piece may lack the end mark.
    """
    marked, _ = write_table(pieces.select("*", F.xxhash64("file").alias("file_id"), F.shiftright("pos", _STRETCH_BITS).alias("stretch"), opens.cast("bigint").alias("opens"), F.octet_length("value").alias("bytes"),
                                          (F.lit(False) if flag is None else flag).cast("bigint").alias("flag"),
                                          *_effects(text)), "json-pieces")
    # The path of a row's file comes back with the carried state, so that it is not sorted with every row.
    files = marked.groupBy("file_id").agg(F.first("file").alias("file"), F.max("file_size").alias("file_size"))
    local = marked.drop("file", "file_size").withColumn("local", F.sum("opens").over(Window.partitionBy(*_SPLIT).orderBy("pos")))
    upto, before = _windows()
    even = F.col("flips") % 2 == 0
    local = local.withColumn("flips", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    local = local.withColumn("from_out", F.sum(F.when(even, F.col("outside")).otherwise(F.col("inside"))).over(upto)) \
        .withColumn("from_in", F.sum(F.when(even, F.col("inside")).otherwise(F.col("outside"))).over(upto))
    local = local.withColumn("n_flag", F.coalesce(F.sum("flag").over(before), F.lit(0)))
    segments = local.groupBy(*_SPLIT, "local").agg(
        F.sum("quotes").alias("quotes"), F.sum("flag").alias("flag"), F.max_by("from_out", "pos").alias("out"), F.max_by("from_in", "pos").alias("in"),
        F.sum(F.col("bytes") + 1).alias("bytes"),
        F.min_by(F.col("value").rlike(r"^﻿?\s*\{"), "pos").alias("brace"))
    blocks = segments.groupBy(*_SPLIT).agg(
        F.max("local").alias("opened"), F.max_by(F.struct("quotes", "flag", "out", "in"), "local").alias("last"),
        F.sum("bytes").alias("bytes"), F.min_by("brace", "local").alias("brace"))
    # The depth a split adds depends on the quotes before it, so these come first.
    sums = blocks.select("*", "last.quotes", "last.flag")
    quoted = _carried(sums, ["quotes", "flag"])
    added = F.when(F.col("c_quotes") % 2 == 0, F.col("last.out")).otherwise(F.col("last.in"))
    own = F.when(F.col("opened") > 0, F.col("last.out")).otherwise(added)  # a frame opened here begins outside
    known = _carried(quoted.drop("frame", "first_frame").withColumn("depth", own), ["depth"]).join(files, "file_id")
    whole = Window.partitionBy("file_id")
    unmarked = (F.sum("bytes").over(whole) - F.max("file_size").over(whole)).isin(1, -2).cast("int")
    place = F.struct("block", "stretch")
    at_end = F.max_by(F.struct("quotes", "depth"), place).over(whole)
    carry = known.select(
        *_SPLIT, "file", "file_size", "first_frame", "c_quotes", "c_flag", "c_depth", F.min_by("brace", place).over(whole).alias("object_file"),
        ((at_end["quotes"] % 2 != 0) | (at_end["depth"] + unmarked != 0)).alias("broken"))
    joined = local.join(carry, list(_SPLIT))
    going_on = F.col("local") == 0
    quotes = F.when(going_on, F.col("c_quotes")).otherwise(0)
    depth = F.when(going_on, F.col("c_depth")).otherwise(0) + F.when(
        quotes % 2 == 0, F.col("from_out")).otherwise(F.col("from_in"))
    return joined.select(
        *pieces.columns, "file_id", "stretch", "local", (F.col("first_frame") + F.col("local")).alias("frame"),
        ((quotes + F.col("flips") + F.col("quotes")) % 2 == 1).alias("in_string"), depth.alias("depth"),
        (F.col("n_flag") + F.when(going_on, F.col("c_flag")).otherwise(0)).alias("n_flag"), "object_file", "broken")


def with_counts(pieces: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Add ``n_<flag>``: how many earlier pieces of the frame have the flag. Carried over splits as above."""
    upto, before = _windows()
    ones = {f: F.coalesce(F.col(f), F.lit(False)).cast("bigint") for f in flags}
    counted = pieces.select("*", *[F.coalesce(F.sum(one).over(before), F.lit(0)).alias(f"n_{f}") for f, one in ones.items()])
    segments = counted.groupBy(*_SPLIT, "local").agg(*[F.sum(one).alias(f) for f, one in ones.items()])
    blocks = segments.groupBy(*_SPLIT).agg(
        F.max("local").alias("opened"), F.max_by(F.struct(*flags), "local").alias("last"))
    carry = _carried(blocks.select(*_SPLIT, "opened", "last.*"), list(flags))
    joined = counted.join(carry.select(*_SPLIT, *[f"c_{f}" for f in flags]), list(_SPLIT))
    total = [(F.col(f"n_{f}") + F.when(F.col("local") == 0, F.col(f"c_{f}")).otherwise(0)).alias(f"n_{f}") for f in flags]
    return joined.select(*pieces.columns, *total)

"""Mixing sources to target weights by nested hash thresholds.

Every document has a hash; a source's budget becomes a threshold on it, so a smaller budget takes a
subset of what a larger one takes, and the mix itself is a filter. The threshold is found from
histograms: tokens by source and leading hash bits, then by the next bits inside the one bucket in
which the budget ends, then by single hashes inside what is left of it. Nothing larger is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.index import with_row_index
from ..storage import write_table
from .words import fresh

WORD = r"[^\x20\x09-\x0D]+"
#: The hash has 60 bits; a histogram looks at 12 of them.
_BITS = 12
#: Source tables up to this many rows are broadcast, larger ones joined by shuffling.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix_hash(key: Column, text: Column) -> Column:
    """60 bits of md5 of the id; rows without an id are told apart by their text."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(text)), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(":mix"))), 1, 15), 16, 10).cast("bigint")


def _water_level(sources: DataFrame, budget: float, cap: float) -> float:
    """Level at which ``least(cap * tokens, level * weight)`` adds up to the budget.

    Each pass caps what the last level lifts above its cap and shares the rest anew.
    """
    level = -1.0
    while True:
        capped = F.col("tokens") * cap <= level * F.col("weight")
        row = sources.agg(
            F.sum(F.when(capped, F.col("tokens") * cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            return max(level, 0.0)
        found = (budget - row["held"]) / row["weight"]
        if found <= level:
            return level
        level = found


def _boundary(sums: DataFrame, at: str) -> DataFrame:
    """The first bucket of each source whose running sum passes the rest of the budget."""
    w = Window.partitionBy("sid").orderBy(at)
    below = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("below", F.col("below") + below).where(
        (F.col("below") <= F.col("rest")) & (F.col("rest") < F.col("below") + F.col("n")))
    return ends.select("sid", F.col(at).alias("bucket"), "below", "rest")


def source_budgets(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                   cap: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source"
                   ) -> DataFrame:
    """One row per source: ``source, source_size, target, copies, threshold``.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all
    tokens; a target above ``cap`` times its source's tokens is cut to that and the excess shared anew.
    A document is taken ``copies`` times, and once more if its hash is at most ``threshold``. The
    document at the border is taken if that brings the source nearer to its target.
    """
    sized, _ = write_table(docs.select(
        F.col(source).alias("source"), mix_hash(F.col(key), F.col(text)).alias("h"),
        word_count(F.col(text)).alias("n")).withColumn("b", F.shiftright("h", 60 - _BITS)), "mix-sized")
    first = sized.groupBy("source", "b").agg(F.sum("n").alias("n"))
    totals = first.groupBy("source").agg(F.sum("n").alias("tokens"))
    order = [F.col("source").isNull(), F.col("source")]
    named, _ = write_table(with_row_index(totals, order, "sid"), "mix-sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights))
    sources = named.withColumn("weight", weight)
    budget = share * (sources.agg(F.sum("tokens")).first()[0] or 0)
    level = _water_level(sources, budget, cap)
    target = F.least(F.col("tokens") * cap, F.col("weight") * level)
    copies = F.when(F.col("tokens") > 0, F.floor(target / F.col("tokens"))).otherwise(0)
    plan = sources.withColumn("target", target).withColumn("copies", copies.cast("bigint")).withColumn(
        "rest", F.col("target") - F.col("copies") * F.col("tokens")).drop("weight")
    ids = bounded(plan.select("source", "sid", "rest"))
    rows, _ = write_table(_by_source(sized, ids).select("sid", "h", "n", "b", "rest"), "mix-rows")
    histogram = rows.groupBy("sid", "b", "rest").agg(F.sum("n").alias("n")).withColumn("below", F.lit(0))
    border = _boundary(histogram, "b")
    inside = _inside(rows, border, "b")
    next_bits = F.shiftright("h", 60 - 2 * _BITS).alias("b2")
    histogram = inside.groupBy("sid", next_bits, "below", "rest").agg(F.sum("n").alias("n"))
    border = _boundary(histogram, "b2")
    inside = _inside(inside.drop("below").withColumn("b2", next_bits), border, "b2")
    single = inside.groupBy("sid", "h", "below", "rest").agg(F.sum("n").alias("n"))
    border = _boundary(single.withColumn("start", F.col("below")), "h")
    # The hash at the border is in if more than half of it fits, else all hashes below it are.
    last = single.groupBy("sid", "h").agg(F.sum("n").alias("g"))
    ends = border.withColumnRenamed("bucket", "h").join(last, ["sid", "h"]).select(
        "sid", F.when(2 * (F.col("rest") - F.col("below")) > F.col("g"), F.col("h"))
        .otherwise(F.col("h") - 1).alias("threshold"))
    out = plan.join(ends, "sid", "left").select(
        "source", F.col("tokens").alias("source_size"), "target", "copies",
        F.coalesce("threshold", F.lit(-1)).alias("threshold"))
    return write_table(out, "mix-budgets")[0]


def bounded(table: DataFrame) -> DataFrame:
    """Broadcast a table of checked size; larger ones are left to a shuffled join."""
    small = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return F.broadcast(table) if small else table.hint("shuffle_merge")


def _by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.join(table.withColumnRenamed("source", "_source"),
                     F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _inside(rows: DataFrame, border: DataFrame, at: str) -> DataFrame:
    found = border.select("sid", F.col("bucket").alias(at), "below")
    return rows.join(bounded(found), ["sid", at])


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                cap: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source"
                ) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``; columns of these names are replaced.

    ``taken`` is ``size`` times the copies the mix takes, 0 for documents left out. Null texts have no
    words, null sources are one source, rows that are equal in id share their fate, and rows without
    an id go by their text. An empty table stays empty. Texts are read, never shuffled.
    """
    budgets = source_budgets(docs, weights, share, cap, key, text, source)
    name = {c: fresh(docs, f"_{c}") for c in ("size", "h", "source", "source_size", "target", "copies", "threshold")}
    plan = bounded(budgets.select(*[F.col(c).alias(name[c]) for c in budgets.columns]))
    rows = docs.withColumn(name["size"], word_count(F.col(text))).withColumn(
        name["h"], mix_hash(F.col(key), F.col(text)))
    joined = rows.join(plan, rows[source].eqNullSafe(plan[name["source"]]), "left")
    copies = F.col(name["copies"]) + (F.col(name["h"]) <= F.col(name["threshold"])).cast("int")
    new = {"size": F.col(name["size"]), "source_size": F.col(name["source_size"]),
           "target": F.col(name["target"]), "taken": F.col(name["size"]) * copies}
    kept = [c for c in docs.columns if c.lower() not in new]
    return joined.select(*kept, *[v.alias(k) for k, v in new.items()])

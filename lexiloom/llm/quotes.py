"""Quotation linking: conversations in reply order, without the quotes.

Lines that begin with quote marks are passages at a level. A passage goes to the nearest earlier message
that holds all its lines, or all its sentences, in order: runs of words of the messages are joined to one
run of each passage, and what meets is compared whole. A message replies to the one its first level quotes, or else to the
message before it. Replies form branches: the first reply to a message goes on with its branch, every
further one begins a new one. A conversation of any length is spread over buckets of its rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.index import running_sum, with_bucket_index, with_row_index
from ..storage import drop_table, write_table
from .words import UNSPACED

#: Quote marks of a line, and what introduces a quote. Fixed values.
_MARKS = re.compile(r"\s*((?:>|&gt;|»|\|(?=\s))\s*)+")
_ONE_MARK = re.compile(r">|&gt;|»|\|")
_BARS = re.compile(r"[\s|]*\|\s*")
#: What a row of a table has behind its first bar.
_CELLS = re.compile(r"\s\|\s|\|\s*$")
_INTRODUCTION = re.compile(r"\s*(?:On|Am|Le|El)\b.*(?:wrote|schrieb|écrit|escribió)\b.*:\s*$", re.I)
#: Words, letters of scripts without spaces, and other characters one by one.
_TOKEN = re.compile(rf"[{UNSPACED}]|(?:(?![{UNSPACED}])\w)+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
#: Tokens of a run that is looked up; shorter passages are looked up by their longest token.
_RUN = 4
#: Tables of up to this many rows are broadcast, larger ones shuffled.
BROADCAST_ROWS = 200_000
#: Messages of a conversation that are searched together for the source of a quote.
_CHUNK = 512


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def _marks(line: str, in_table: bool) -> tuple[str, bool]:
    """The quote marks of a line, and whether a row of a table follows them.

    Bars alone go on with a table, but begin none: they may be an empty line of a quote.
    """
    found = _MARKS.match(line)
    marks = found[0] if found else ""
    bar = marks.find("|")
    if bar < 0:
        return marks, False
    rest = line[len(marks):]
    if in_table if not rest.strip() and _BARS.fullmatch(line, bar) else _CELLS.search(rest):
        return marks[:bar], True
    return marks, False


@dataclass
class Passage:
    level: int
    lines: list[str] = field(default_factory=list)
    #: Lines as they were, with the introduction; whether a bar marks any; and how many own lines stand before.
    raw: list[str] = field(default_factory=list)
    bars: bool = False
    at: int = 0


def read_message(text: str) -> tuple[list[str], list[Passage]]:
    """The lines that are no quotes or introductions, and the passages."""
    own: list[str] = []
    passages: list[Passage] = []
    last, table = 0, False
    for line in text.split("\n"):
        marks, table = _marks(line, table)
        level = len(_ONE_MARK.findall(marks))
        if level:
            introduction = [own.pop()] if not last and own and _INTRODUCTION.match(own[-1]) else []
            if level != last:
                passages.append(Passage(level, raw=introduction, at=len(own)))
            passages[-1].lines.append(line[len(marks):])
            passages[-1].raw.append(line)
            passages[-1].bars |= "|" in marks
        else:
            own.append(line)
        last = level
    return own, passages


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The message without quotes and their introductions, and its passages as (level, text).

    Consecutive lines of one level are one passage; levels count from 1. Rows of a table are no quotes.
    """
    own, passages = read_message(text or "")
    if not passages:
        return text or "", []
    return "\n".join(own).strip("\n"), [(p.level, "\n".join(p.lines)) for p in passages]


def segments(own: list[str], passages: list[Passage]) -> list[dict] | None:
    """The message in pieces, if it has passages: ``at`` is their number, null what is no quote.

    ``bars`` says whether bars mark a passage. One without text has the number -1; it goes if other marks
    than bars stand for it, since nothing is lost with it.
    """
    if not passages:
        return None
    out, start, number = [], 0, 0
    for p in passages:
        if own[start:p.at]:
            out.append({"at": None, "bars": False, "text": "\n".join(own[start:p.at])})
        start = p.at
        named = bool(normalise("\n".join(p.lines)))
        if named or p.bars:
            out.append({"at": number if named else -1, "bars": p.bars, "text": "\n".join(p.raw)})
        number += named
    if own[start:]:
        out.append({"at": None, "bars": False, "text": "\n".join(own[start:])})
    return out


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def holds(said: str, lines: list[str]) -> bool:
    """Whether a message (its tokens between single spaces) holds the lines, or their sentences, in order."""

    def in_order(parts: list[str]) -> bool:
        at = 0
        for part in parts:
            found = " ".join(tokens(part))
            at = said.find(f" {found} ", at) if found else at
            if at < 0:
                return False
            at += len(found) + 1 if found else 0
        return True

    return in_order(lines) or in_order(_SENTENCE.split(" ".join(lines)))


def runs(words: list[str]) -> set[str]:
    """What a message can be looked up by: its tokens, and its runs of ``_RUN``."""
    return {*words, *(" ".join(words[i:i + _RUN]) for i in range(len(words) - _RUN + 1))}


def wanted_run(lines: list[str]) -> str:
    """A run of the longest stretch inside one line and one sentence, which any source has in one piece."""
    longest = max((tokens(x) for line in lines for x in _SENTENCE.split(line)), key=len)
    if len(longest) < _RUN:
        return max(longest, key=len)
    return max((" ".join(longest[i:i + _RUN]) for i in range(len(longest) - _RUN + 1)), key=len)


def sources(own: str) -> list[str]:
    """What of a message others may quote: all of it, its paragraphs, and its lines."""
    parts = [own, *re.split(r"\n\s*\n", own), *own.split("\n")]
    return list(dict.fromkeys(p for p in map(normalise, parts) if p))


def parse_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``_own``, ``_quotes`` (level, text, and a run of its tokens to look up) and
    ``_segments``."""

    @F.pandas_udf("own string, quotes array<struct<level:int,text:string,run:string>>, "
                  "segments array<struct<at:int,bars:boolean,text:string>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for value in texts:
                own, quotes = parse(value)
                named = [{"level": k, "text": v.lower(), "run": wanted_run(v.split("\n"))}
                         for k, v in quotes if normalise(v)]
                rows.append((None if value is None else own, named, segments(*read_message(value or ""))))
            yield pd.DataFrame(rows, columns=["own", "quotes", "segments"])

    parsed = messages.withColumn("_parsed", read.asNondeterministic()(F.col(text)))
    return parsed.select(*messages.columns, F.col("_parsed.own").alias("_own"),
                         F.col("_parsed.quotes").alias("_quotes"), F.col("_parsed.segments").alias("_segments"))


def _held(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``conv, idx, h``: the messages that hold a passage, of the conversations with any."""

    @F.pandas_udf("array<string>")
    def all_runs(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(runs(tokens(t or ""))) for t in texts])

    @F.pandas_udf("array<bigint>")
    def found(texts: pd.Series, hashes: pd.Series, passages: pd.Series) -> pd.Series:
        out = []
        for value, keys, asks in zip(texts, hashes, passages):
            said = f" {' '.join(tokens(value or ''))} "
            out.append([int(k) for k, p in zip(keys, asks) if holds(said, p.split("\n"))])
        return pd.Series(out)

    small = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = asked.select(F.col("conv").alias("c"), F.xxhash64("run").alias("r"), "h", "passage")
    known = F.broadcast(known) if small else known
    convs = asked.select(F.col("conv").alias("c")).distinct()
    asking = rows.join(F.broadcast(convs) if small else convs, rows["conv"].eqNullSafe(F.col("c")), "left_semi")
    said = asking.select("conv", "idx", F.explode(all_runs.asNondeterministic()("_own")).alias("run")).select(
        "conv", "idx", F.xxhash64("run").alias("run"))
    met = said.join(known, said["conv"].eqNullSafe(known["c"]) & (said["run"] == known["r"])).groupBy(
        "conv", "idx").agg(F.collect_list(F.struct("h", "passage")).alias("asks"))
    met = met.select(F.col("conv").alias("c"), F.col("idx").alias("i"), "asks")
    both = rows.join(met, rows["conv"].eqNullSafe(met["c"]) & (rows["idx"] == met["i"]))
    return both.select("conv", "idx", F.explode(found.asNondeterministic()(
        "_own", F.col("asks.h"), F.col("asks.passage"))).alias("h"))


def _quote_links(rows: DataFrame) -> DataFrame:
    """``conv, idx, level, at, source``: the nearest earlier message that holds a quoted passage.

    Inside a chunk of messages and hash the nearest is a minimum distance; earlier chunks hand over the
    last message they hold, so no group grows with a conversation.
    """
    chunk = F.floor(F.col("idx") / _CHUNK)
    quoted = rows.select("conv", "idx", F.posexplode("_quotes").alias("at", "q")).select(
        "conv", F.xxhash64("q.text").alias("h"), "idx", "at", F.col("q.level").alias("level"),
        chunk.alias("chunk"), "q.run", F.col("q.text").alias("passage"))
    asked, asked_path = write_table(quoted.select("conv", "h", "run", "passage").dropDuplicates(["conv", "h"]),
                                    "quote-asked")
    quoted = quoted.drop("run", "passage")
    said, said_path = write_table(_held(rows, asked).withColumn("chunk", chunk), "quote-said")
    drop_table(rows.sparkSession, asked_path)
    last = said.groupBy("conv", "h", "chunk").agg(F.max("idx").alias("last"), F.collect_set("idx").alias("all"))
    here = last.select(F.col("conv").alias("c1"), F.col("h").alias("h1"), F.col("chunk").alias("k1"), "all")
    same = quoted.join(here, quoted["conv"].eqNullSafe(here["c1"]) & (quoted["h"] == here["h1"])
                       & (quoted["chunk"] == here["k1"]), "left")
    inside = F.array_max(F.filter("all", lambda i: i < F.col("idx")))
    same = same.select(quoted["conv"], quoted["h"], "idx", "at", "level", quoted["chunk"], inside.alias("inside"))
    # What earlier chunks hold: one array of chunk ends per conversation and hash.
    ends = last.groupBy("conv", "h").agg(F.collect_list(F.struct("chunk", "last")).alias("ends")).select(
        F.col("conv").alias("c2"), F.col("h").alias("h2"), "ends")
    wide = same.join(ends, same["conv"].eqNullSafe(ends["c2"]) & (same["h"] == ends["h2"]), "left")
    before = F.array_max(F.transform(F.filter("ends", lambda e: e["chunk"] < F.col("chunk")),
                                     lambda e: e["last"]))
    out, _ = write_table(wide.select("conv", "idx", "level", "at", F.coalesce("inside", before).alias(
        "source")).where("source is not null"), "quote-links")
    drop_table(rows.sparkSession, said_path)
    return out


def _branches(rows: DataFrame) -> DataFrame:
    """``conv, idx, branch``: the first message of the branch that a message belongs to."""
    spark = rows.sparkSession
    # The first reply to a message goes on with its branch.
    first = rows.where("parent is not null").groupBy("conv", "parent").agg(F.min("idx").alias("child"))
    named = first.select(F.col("conv").alias("c"), F.col("parent").alias("p"), "child")
    marked = rows.join(named, rows["conv"].eqNullSafe(named["c"]) & (rows["parent"] == named["p"]), "left")
    goes_on = F.coalesce(F.col("child") == F.col("idx"), F.lit(False))
    breaks = ~(goes_on & (F.col("parent") == F.col("idx") - 1))
    runs = marked.select("_bucket", "conv", "idx", breaks.cast("int").alias("new"),
                         F.when(goes_on, F.col("parent")).alias("from"))
    numbered = running_sum(runs, F.col("new"), "conv", "idx", "before").withColumn(
        "run", F.col("before") + F.col("new"))
    numbered, numbered_path = write_table(numbered.select("conv", "idx", "new", "from", "run"), "quote-runs")
    heads = numbered.where("new = 1").select("conv", "run", F.col("idx").alias("branch"), "from")
    on = numbered.select(F.col("conv").alias("c"), F.col("idx").alias("i"), F.col("run").alias("up"))
    link, path = write_table(heads.join(on, heads["conv"].eqNullSafe(on["c"]) & (heads["from"] == on["i"]), "left")
                             .select("conv", "run", F.col("up").alias("to"), "branch"), "quote-heads")
    while not link.where("to is not null").isEmpty():  # halves every chain of runs each time
        far = link.select(F.col("conv").alias("c"), F.col("run").alias("r"), F.col("to").alias("to2"),
                          F.col("branch").alias("branch2"))
        step = link.join(far, link["conv"].eqNullSafe(far["c"]) & (link["to"] == far["r"]), "left").select(
            "conv", "run", F.col("to2").alias("to"), F.coalesce("branch2", "branch").alias("branch"))
        link, after = write_table(step, "quote-heads")
        drop_table(spark, path)
        path = after
    ends = link.select(F.col("conv").alias("c"), F.col("run").alias("r"), "branch")
    out, _ = write_table(numbered.join(
        ends, numbered["conv"].eqNullSafe(ends["c"]) & (numbered["run"] == ends["r"])).select(
        "conv", "idx", "branch"), "quote-branches")
    for old in (path, numbered_path):
        drop_table(spark, old)
    return out


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text",
                role: str = "role") -> DataFrame:
    """``<conv>, <turn>, <role>, text, n_quotes, n_linked, reply_to, branch, position`` of every message.

    ``text`` is the message without the quotes that link (null stays null); a passage without a source stays
    as it was, marks and introduction included, though later messages are not searched for in it.
    ``n_quotes`` counts the passages, those that bars mark only if they link. ``reply_to`` is the turn of
    the message that holds its first linked passage of level 1, else of the message before, null for the
    first. ``branch`` counts from 0 by the first message of a branch; ``position`` is the place in reply
    order, branch after branch, so that a message follows the one it replies to. Messages of equal turn
    are ordered by role and text; equal rows are messages of their own in any order. Null conversations
    are one conversation, null turns come first. Other columns are not looked at.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                           F.col(text).alias("text"))
    named, _ = write_table(parse_messages(rows).withColumn("tie", F.xxhash64("text")), "quote-messages")
    indexed, _ = write_table(with_bucket_index(named, ["turn", "role", "tie"], "idx", ["conv"]), "quote-index")
    found = _quote_links(indexed)
    direct = found.groupBy("conv", "idx").agg(
        F.count("*").alias("n_linked"), F.collect_list("at").alias("linked"),
        F.min_by("source", F.when(F.col("level") == 1, F.col("at"))).alias("source")).select(
        F.col("conv").alias("c"), F.col("idx").alias("i"), "n_linked", "linked", "source")
    joined = indexed.join(direct, indexed["conv"].eqNullSafe(direct["c"]) & (indexed["idx"] == direct["i"]), "left")
    parent = F.coalesce("source", F.when(F.col("idx") > 0, F.col("idx") - 1))
    # What links to nothing may be code, a list or the words of somebody else: it stays.
    linked = F.coalesce("linked", F.array().cast("array<int>"))
    stay = F.filter("_segments", lambda p: p["at"].isNull() | ~F.array_contains(linked, p["at"]))
    put_back = F.size(F.filter(stay, lambda p: (p["at"] >= 0) & p["bars"]))
    own = F.when(F.col("_segments").isNull(), F.col("_own")).otherwise(
        F.btrim(F.array_join(F.transform(stay, lambda p: p["text"]), "\n"), F.lit("\n")))
    n_quotes = F.size("_quotes") - F.when(F.col("_segments").isNull(), 0).otherwise(put_back)
    replies, _ = write_table(joined.select(
        "_bucket", "conv", "idx", "turn", "role", own.alias("_own"), n_quotes.alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), parent.alias("parent")), "quote-replies")
    branches = _branches(replies.select("_bucket", "conv", "idx", "parent"))
    in_branch = replies.join(branches.select(F.col("conv").alias("c"), F.col("idx").alias("i"), "branch"),
                             replies["conv"].eqNullSafe(F.col("c")) & (replies["idx"] == F.col("i")))
    turns = replies.select(F.col("conv").alias("c3"), F.col("idx").alias("i3"), F.col("turn").alias("reply_to"))
    with_turn = in_branch.drop("c", "i").join(
        turns, in_branch["conv"].eqNullSafe(turns["c3"]) & (in_branch["parent"] == turns["i3"]), "left")
    placed, _ = write_table(with_turn.select(*[c for c in replies.columns if c != "_bucket"], "branch", "reply_to"),
                            "quote-placed")
    numbered = with_row_index(placed, ["branch", "idx"], "position", ["conv"])
    return numbered.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role),
                           F.col("_own").alias("text"), "n_quotes", "n_linked", "reply_to", "branch", "position")

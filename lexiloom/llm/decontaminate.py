"""Benchmark decontamination by pigeonhole edit matching.

An item may occur with up to ``budget`` edits. Cut into ``budget + 1`` pieces, at least one of them
stands unchanged in any such occurrence, so an automaton over all pieces finds every candidate in one
pass over a text. Myers' bit-parallel distance then verifies the text around a hit. Items too short for
edits are looked up as they are, between word borders.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .words import UNSPACED, fresh

#: Edits allowed per character of an item.
EDIT_RATE = 0.06
#: Items with fewer characters are found only unchanged and as whole words.
EXACT_BELOW = 24
#: Characters of the items that one automaton holds; more items go in blocks of about this size.
BLOCK_CHARS = 1_000_000
#: A character of a word; letters of scripts without spaces are words of their own.
_IN_WORD = re.compile(rf"(?![{UNSPACED}])\w")


def normalise(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their places."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _bits(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return masks


def distances(pattern: str, text: str, anchored: bool = False) -> list[int]:
    """Least edits between the pattern and a part of the text that ends at each character.

    The part starts anywhere, or at the start of the text if ``anchored``. One machine word as wide as
    the pattern holds a column of differences.
    """
    m, masks = len(pattern), _bits(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    out = []
    for c in text:
        equal = masks.get(c, 0)
        x = equal | down
        h = (((equal & up) + up) ^ up) | equal
        plus = (down | ~(h | up)) & full
        minus = up & h
        score += bool(plus & high) - bool(minus & high)
        plus = ((plus << 1) | anchored) & full
        up = ((minus << 1) | ~(x | plus)) & full
        down = plus & x
        out.append(score)
    return out


def best_match(pattern: str, text: str) -> tuple[int, int, int]:
    """Least distance with the first end that has it, and the nearest start for that: (d, start, end)."""
    scores = distances(pattern, text)
    least = min(scores)
    end = scores.index(least) + 1
    before = text[max(0, end - len(pattern) - least):end][::-1]
    back = distances(pattern[::-1], before, anchored=True)
    return least, end - (back.index(least) + 1 if least in back else 0), end


def build(items: list[tuple[object, str]], rate: float) -> tuple[object, list[tuple[object, str, int]]]:
    """Automaton over the pieces of all items; its values say which item and where in it."""
    known = [(i, t, int(len(t) * rate) if len(t) >= EXACT_BELOW else 0) for i, t in items]
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for number, (_, text, budget) in enumerate(known):
        for at, piece in pieces(text, budget):
            places[piece].append((number, at))
    automaton = ahocorasick.Automaton()
    for piece, where in places.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, known


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether neither end of the part lies inside a word."""
    return not any(0 < at < len(text) and _IN_WORD.match(text[at - 1]) and _IN_WORD.match(text[at])
                   for at in (start, end))


def search(text: str, automaton, known) -> list[tuple[object, int, int, int]]:
    """Best occurrence of each item within its budget: (item, distance, start, length)."""
    starts: dict[int, list[int]] = defaultdict(list)
    exact: dict[int, int] = {}
    for last, (size, where) in automaton.iter(text):
        for number, at in where:
            if len(known[number][1]) >= EXACT_BELOW:
                starts[number].append(last + 1 - size - at)
            elif number not in exact and whole_words(text, last + 1 - size, last + 1):
                exact[number] = last + 1 - size
    out = [(known[number][0], 0, start, len(known[number][1])) for number, start in exact.items()]
    for number, found in starts.items():
        item, pattern, budget = known[number]
        windows: list[list[int]] = []
        for s in sorted(found):  # an occurrence begins within the budget of where a piece puts it
            low, high = max(0, s - budget), min(len(text), s + len(pattern) + budget)
            if windows and low <= windows[-1][0] + 2 * budget:
                windows[-1][1] = max(windows[-1][1], high)
            else:
                windows.append([low, high])
        best = None
        for low, high in windows:
            if high - low < len(pattern) - budget:
                continue
            d, start, end = best_match(pattern, text[low:high])
            if d <= budget and (best is None or d < best[1]):
                best = (item, d, low + start, end - start)
        if best:
            out.append(best)
    return out


def _blocks(benchmark: DataFrame, key: str, text: str) -> list[list[tuple[object, str]]]:
    """Normalised items in blocks of bounded size, one collected after the other."""
    items = benchmark.where(F.col(text).isNotNull()).select(key, text).distinct()
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    out = []
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64(text), F.lit(n)) == block).collect()
        named = sorted(((r[0], normalise(r[1])) for r in rows), key=lambda x: (x[0] is None, x[0], x[1]))
        out.append([(i, t) for i, t in named if t])
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text", rate: float = EDIT_RATE, output: str = "matches") -> DataFrame:
    """``docs`` with ``output``: an array of ``item, distance, start, length``.

    One entry per benchmark item whose text occurs with at most ``rate`` edits per character, at its
    best and then first place in the normalised text; items under ``EXACT_BELOW`` characters occur only
    unchanged, between word borders. Null and empty texts have none; null and empty items are not
    searched; repeated items count once. Texts are searched whole, whatever their length, and no row
    moves. A column named ``output`` is replaced.
    """
    kind = benchmark.schema[item].dataType.simpleString()
    schema = f"array<struct<item:{kind},distance:int,start:int,length:int>>"
    parts = []
    for block in _blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((block, rate))
        parts.append(_searcher(shared, schema)(F.col(text)))
    found = F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array().cast(schema)
    return docs.withColumn(output, F.array_sort(found))


def _searcher(shared, schema: str):
    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block, rate = shared.value
        automaton, known = build(block, rate)
        for texts in batches:
            out = [search(normalise(t), automaton, known) if known else [] for t in texts]
            yield pd.Series([[dict(zip(("item", "distance", "start", "length"), m)) for m in row]
                             for row in out], dtype=object)

    return run.asNondeterministic()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no item occurs, with their columns as they were."""
    name = fresh(docs, "_matches")
    return find_items(docs, benchmark, text, output=name).where(F.size(name) == 0).drop(name)

"""Merging neighbours inside one word: the only part of the vocabulary work that runs in Python."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

INFINITE = float("inf")


def merge_neighbours(word: str, rule, in_order: bool = False) -> list[str]:
    """Merge neighbouring symbols, begun as single characters, until no rule applies.

    ``rule(pair text)`` gives ``(rank, symbol)`` or None; the lowest rank goes first and among equals
    the leftmost place. With ``in_order`` a rule whose turn is over does not come again. Takes
    n log n steps for n characters.
    """
    symbols: list[str | None] = list(word)
    queue = []
    for i in range(len(word) - 1):
        pair = word[i:i + 2]
        r = rule(pair)
        if r is not None:
            queue.append((r[0], i, i + 1, pair, r[1]))
    if not queue:
        return symbols
    n = len(symbols)
    heapify(queue)
    following = list(range(1, n + 1))
    previous = list(range(-1, n - 1))
    while queue:
        rank, i, j, pair, symbol = heappop(queue)
        # Places change while they wait; only those still as they were count.
        if symbols[i] is None or symbols[j] is None or following[i] != j \
                or symbols[i] + symbols[j] != pair:
            continue
        symbols[i], symbols[j] = symbol, None
        k = following[i] = following[j]
        if k < n:
            previous[k] = i
        for a, b in ((previous[i], i), (i, k)):
            if a >= 0 and b < n:
                wider = symbols[a] + symbols[b]
                r = rule(wider)
                if r is not None and not (in_order and r[0] < rank):
                    heappush(queue, (r[0], a, b, wider, r[1]))
    return [s for s in symbols if s is not None]


def merge_short(word: str, ranks: dict[str, float]) -> list[str]:
    """As ``merge_neighbours`` for pieces that are their own text, faster for words of everyday length."""
    symbols, get = list(word), ranks.get
    best = [get(a + b, INFINITE) for a, b in zip(word, word[1:])]
    while best:
        least = min(best)
        if least == INFINITE:
            break
        i = best.index(least)
        symbols[i] += symbols.pop(i + 1)
        del best[i]
        if i < len(best):
            best[i] = get(symbols[i] + symbols[i + 1], INFINITE)
        if i:
            best[i - 1] = get(symbols[i - 1] + symbols[i], INFINITE)
    return symbols

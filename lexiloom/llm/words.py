"""Helpers shared by the operators: free column names, folds, and words of a text as numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SPACES = b" \t\n\x0b\x0c\r"
#: Letters of scripts written without spaces between words (Thai to Tibetan, Myanmar, Khmer, kana, bopomofo,
#: Han), as ranges for a character class. Fixed value.
UNSPACED = ("\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31f0-\u31ff\u3400-\u4dbf"
            "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key: str = "doc_id") -> Column:
    """True for the rows nothing is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits evenly, so that any of them may be used on their own."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) <= n:
        size = 1 << max(16, n.bit_length())  # most workers never see a text as long as a segment
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def _segment_hashes(data: bytes, separators: np.ndarray) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~separators[b]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(data: bytes, separators: np.ndarray = _SPACE) -> np.ndarray:
    """64-bit hash of every word in order. Long texts go in segments cut between words."""
    if len(data) <= _SEGMENT:
        return _segment_hashes(data, separators)
    parts, at = [], 0
    flat = separators[np.frombuffer(data, np.uint8)]
    while at < len(data):
        cut = at + _SEGMENT
        if cut < len(data):
            step = 1 << 12
            while cut < len(data) and not flat[cut:cut + step].any():
                cut += step
            cut = min(len(data), cut + int(flat[cut:cut + step].argmax()))
        parts.append(_segment_hashes(data[at:min(cut, len(data))], separators))
        at = cut
    return np.concatenate(parts)


def bag_of_words(text: str | None, bits: int) -> np.ndarray:
    """Sorted distinct hash buckets of the words of a text, without case and ASCII punctuation."""
    hashes = word_hashes(utf8(text.lower()) if text else b"", _NOT_ALNUM)
    return np.unique(hashes >> np.uint64(64 - bits)).astype(np.int64)

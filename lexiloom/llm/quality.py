"""Quality rules: word counts, repetition, and bands of zstandard ratios by length and script.

A text that repeats itself compresses too well for its length, noise too badly. What is usual at a
length is learned from the corpus: a histogram of ratios by quarter octaves of the length in bytes,
with each distinct text once, gives a median and a spread per class. Neighbouring classes vote on both,
so that a class filled by copies of one text cannot move its own band. Scripts with more bytes to a
character compress better, so texts and chunks are judged among those of as many half bytes a character:
a script is never measured by the band of another, however few its texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .neardup import small_batches
from .words import SPACES, fresh, utf8

#: Chunks, in bytes; where a rest is left behind the last full one, the last bytes of the text are one more.
CHUNK = 4096
#: Reach of a band below and above its median in robust standard deviations, for documents and for
#: single chunks. Repetition lies just below what is usual, noise far above it.
WIDTH, CHUNK_WIDTH = (3.0, 6.0), (5.0, 8.0)
#: A band never reaches less far than this share of its median.
LEAST_WIDTH = 0.08
#: Classes with fewer distinct texts take those of their neighbours in.
CLASS_ROWS = 100
_SPREAD = 1.4826
_BIN = 0.002
#: Texts that Python gets at once where this module runs the work itself.
_TEXT_BATCH = 1000
#: Length classes of texts of one width begin at this multiple of it; chunks have minus the width.
_STRIDE = 1000
_SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
           "n_repeat_words bigint, base_failed boolean, ratio double, chunk_low double, "
           "chunk_high double, kept boolean")
_KEEP_SYMBOLS = bytes(i for i in range(256) if i not in b"#*$%&|<>")


def _ratio(compressor: zstandard.ZstdCompressor, data: bytes) -> float:
    return len(compressor.compress(data)) / len(data)


def _compressor() -> zstandard.ZstdCompressor:
    """One per task; its level is the same whatever the length of a text."""
    return zstandard.ZstdCompressor(level=3)


def _width(data: bytes) -> int:
    """Half bytes to a character, from 2 for Latin over 4 for Cyrillic to 6 for Han, 8 at most."""
    going_on = int(((np.frombuffer(data, np.uint8) & 0xC0) == 0x80).sum())
    return min(8, round(2 * len(data) / max(1, len(data) - going_on)))


def _ratios(compressor: zstandard.ZstdCompressor, data: bytes) -> tuple[float, list[tuple[int, float]]]:
    """Of the whole text, and of its chunks with their classes; a text shorter than a chunk has none."""
    whole = _ratio(compressor, data) if data else float("nan")
    starts = list(range(0, len(data) - CHUNK + 1, CHUNK))
    if starts and len(data) % CHUNK:
        starts.append(len(data) - CHUNK)
    parts = [data[i:i + CHUNK] for i in starts]
    return whole, [(-_width(part), _ratio(compressor, part)) for part in parts]


def _text_class(data: bytes) -> int:
    return _STRIDE * _width(data) + int(4 * np.log2(len(data))) if data else 0


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words (a power of two) found twice or more, first included."""
    if len(words) < width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    step = 1
    while step < width:  # number equal windows of twice the length, exactly
        pairs = ids[:-step] * (len(words) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    depth = np.zeros(len(words) + 1, np.int64)
    depth[:len(twice)] += twice
    depth[width:width + len(twice)] -= twice
    return int((np.cumsum(depth) > 0).sum())


def _counts(data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()
    raw = np.frombuffer(data, np.uint8)
    chars = sum(map(len, words)) - int(((raw & 0xC0) == 0x80).sum())  # bytes that go on a code point
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.strip(SPACES):
            if line in seen:
                dup += 1
            seen.add(line)
    return (len(words), chars, len(data.translate(None, _KEEP_SYMBOLS)), dup, repeated_words(words))


def _histogram(docs: DataFrame, text: str) -> DataFrame:
    """Distinct texts by class and ratio; classes below zero hold the chunks."""

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressor = _compressor()
        for batch in batches:
            out = []
            for key, value in zip(batch["_key"], batch["_text"]):
                data = utf8(value)
                if not data:
                    continue
                whole, chunks = _ratios(compressor, data)
                out.append((key, _text_class(data), int(whole / _BIN), 1))
                n = Counter((c, int(ratio / _BIN)) for c, ratio in chunks)
                out += [(key, *place, times) for place, times in n.items()]
            yield pd.DataFrame(out, columns=["key", "class", "bin", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(
        F.xxhash64(F.col(text)).alias("_key"), F.col(text).alias("_text"))
    once = rows.mapInPandas(bins, "key bigint, class int, bin int, n bigint").dropDuplicates()
    return once.groupBy("class", "bin").agg(F.sum("n").alias("n"))


def _middle(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values)
    total = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(total, total[-1] / 2)])


def _band(values: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    middle = _middle(values, counts)
    return middle, _SPREAD * _middle(np.abs(values - middle), counts)


def compression_limits(docs: DataFrame, text: str = "text") -> dict[int, tuple[float, float]]:
    """Lowest and highest usual ratio by class: width and length of texts, minus the width of chunks.

    There are at most 7 widths with 130 lengths each.
    """
    with small_batches(docs.sparkSession, _TEXT_BATCH):
        rows = _histogram(docs, text).collect()  # at most classes x bins
    if not rows:
        return {}
    table = np.array([(r["class"], (r["bin"] + 0.5) * _BIN, r["n"]) for r in rows])
    own: dict[int, tuple[float, float]] = {}
    for c in np.unique(table[:, 0]).astype(int):
        reach, part = 0, table[table[:, 0] == c]
        while c >= 0 and part[:, 2].sum() < CLASS_ROWS and reach < 8:
            reach += 1
            part = table[(np.abs(table[:, 0] - c) <= reach) & (table[:, 0] >= 0)]
        own[int(c)] = _band(part[:, 1], part[:, 2])
    limits = {}
    for c, (middle, spread) in own.items():
        width = CHUNK_WIDTH
        if c >= 0:
            # The mean of the classes at equal distance below and above has no slope in it.
            pairs = [(own[c - j], own[c + j]) for j in range(1, 5) if c - j in own and c + j in own]
            middle = float(np.median([middle] + [(a[0] + b[0]) / 2 for a, b in pairs]))
            spread = float(np.median([spread] + [(a[1] + b[1]) / 2 for a, b in pairs]))
            width = WIDTH
        below, above = (max(x * spread, LEAST_WIDTH * middle) for x in width)
        limits[c] = (middle - below, middle + above)
    return limits


def quality(docs: DataFrame, limits: dict[int, tuple[float, float]], text: str = "text",
            max_repeat_percent: int = 30, min_words: int = 20) -> Column:
    """Struct of the counts, the ratios and the verdict for every text; see ``_SCHEMA``.

    A null text counts as empty: no words, so ``base_failed``. A text passes if its base rules hold and
    its ratio and those of all its chunks lie in the bands; lengths without a band pass. Texts of any
    length are read whole.
    """

    def one(compressor: zstandard.ZstdCompressor, value: str | None) -> tuple:
        data = utf8(value)
        counts = _counts(data)
        failed = counts[0] < min_words or 100 * counts[4] > max_repeat_percent * counts[0]
        whole, chunks = _ratios(compressor, data)
        ratios = [ratio for _, ratio in chunks]
        low, high = (min(ratios), max(ratios)) if ratios else (None, None)
        kept = not failed
        if kept:
            least, most = limits.get(_text_class(data), (0.0, 9.0))
            kept = least <= whole <= most
        for c, ratio in chunks if kept else ():
            least, most = limits.get(c, (0.0, 9.0))
            kept = kept and least <= ratio <= most
        return (*counts, failed, whole if data else None, low, high, kept)

    @F.pandas_udf(_SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressor = _compressor()
        for texts in batches:
            yield pd.DataFrame([one(compressor, value) for value in texts],
                               columns=[f.split()[0] for f in _SCHEMA.split(", ")])

    return judge.asNondeterministic()(F.col(text))


def score_quality(docs: DataFrame, text: str = "text", output: str = "quality") -> DataFrame:
    """``docs`` with the struct ``output``; a column of that name is replaced."""
    return docs.withColumn(output, quality(docs, compression_limits(docs, text), text))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their columns as they were."""
    name = fresh(docs, "_quality")
    return score_quality(docs, text, name).where(F.col(f"{name}.kept")).drop(name)

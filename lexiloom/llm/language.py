"""Language of a text from spans: script ranges, per-word scores, and Viterbi with a switching penalty.

The model holds, for every language, smoothed log shares of hashed letter trigrams and the scripts its
letters are from; both are counted over all learning rows on Spark. A word's score for a language is
the sum over its letters; languages that hardly use a word's script are ruled out for it. Viterbi then
labels spans: changing language between two words costs a fixed penalty.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: First code points of script ranges, each up to the next. Fixed values.
SCRIPT_STARTS = (
    0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B80,
    0x0C00, 0x0E00, 0x0E80, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C60, 0x2D00,
    0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xF900, 0xFB00, 0xFB50, 0xFE70, 0xFF00, 0xFF66, 0xFFA0,
    0x10000, 0x20000)
#: The script of each range. Fixed values.
SCRIPTS = (
    "Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Syriac", "Devanagari", "Bengali",
    "Gurmukhi", "Indic", "Tamil", "Telugu", "Thai", "Lao", "Burmese", "Georgian", "Hangul", "Ethiopic",
    "Latin", "Greek", "Other", "Latin", "Other", "Kana", "Other", "Han", "Other", "Hangul", "Han",
    "Latin", "Arabic", "Arabic", "Latin", "Kana", "Hangul", "Other", "Han")
_NAMES = tuple(dict.fromkeys(SCRIPTS))
_SCRIPT_OF_RANGE = np.array([_NAMES.index(s) for s in SCRIPTS], np.int64)
_STARTS = np.array(SCRIPT_STARTS)
BITS = 15
#: Cost of changing language between two words, in nats.
SWITCH = 12.0
#: A language is a candidate for a word if at least this share of its letters has the word's script.
SCRIPT_SHARE = 0.001
#: Languages a model may have; their trigram tables are collected and broadcast.
MAX_LANGUAGES = 400
_SMOOTHING = 0.5
_RULED_OUT = -1e4
_PIECE = 1 << 20
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool))
    return _letters[0]


@dataclass
class Words:
    """Trigram buckets of all letters in order, where words start among them, and their scripts."""

    buckets: np.ndarray
    starts: np.ndarray
    scripts: np.ndarray


def read_words(text: str) -> Words:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    padded = np.zeros(len(codes) + 2, np.uint64)
    padded[1:-1] = np.where(letter, codes, 0)
    at = np.flatnonzero(letter) + 1
    grams = (padded[at - 1] << np.uint64(42)) | (padded[at] << np.uint64(21)) | padded[at + 1]
    buckets = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    starts = np.flatnonzero(padded[at - 1] == 0)
    first = codes[at[starts] - 1]
    scripts = _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, first, side="right") - 1]
    return Words(buckets, starts, scripts)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language
    allowed: np.ndarray  # script x language


def count_trigrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, kind, bucket, n``: trigram buckets (kind 0) and scripts (kind 1) of all given rows.

    Languages of one task are summed there, so a language with a third of all rows moves no more
    than any other.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, value in zip(batch["_lang"], batch["_text"]):
                grams, scripts = seen.setdefault(
                    name, (np.zeros(1 << BITS, np.int64), np.zeros(len(_NAMES), np.int64)))
                for start in range(0, len(value), _PIECE):
                    words = read_words(value[start:start + _PIECE])
                    grams += np.bincount(words.buckets, minlength=1 << BITS)
                    lengths = np.diff(np.append(words.starts, len(words.buckets)))
                    scripts += np.bincount(words.scripts, lengths, len(_NAMES)).astype(np.int64)
            if len(seen) > MAX_LANGUAGES:
                yield from _flush(seen)
        yield from _flush(seen)

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    counted = rows.mapInPandas(sums, "lang string, kind int, bucket int, n bigint")
    return counted.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


def _flush(seen: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
    for name, tables in seen.items():
        for kind, table in enumerate(tables):
            at = np.flatnonzero(table)
            yield pd.DataFrame({"lang": name, "kind": kind, "bucket": at, "n": table[at]})
    seen.clear()


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from every given row; the collected table has languages x buckets rows at most."""
    counts = count_trigrams(docs, text, lang)
    known = docs.where(F.col(lang).isNotNull()).select(lang).distinct().limit(MAX_LANGUAGES + 1)
    languages = sorted(r[0] for r in known.collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = counts.toPandas()
    column = table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    grams = np.zeros((1 << BITS, len(languages)))
    scripts = np.zeros((len(_NAMES), len(languages)))
    for kind, out in ((0, grams), (1, scripts)):
        rows = (table["kind"] == kind).to_numpy()
        out[table["bucket"].to_numpy()[rows], column[rows]] = table["n"].to_numpy()[rows]
    grams += _SMOOTHING
    weights = np.log(grams / grams.sum(0)) if languages else grams
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    return Model(languages, weights.astype(np.float32), allowed)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Words x languages; languages of other scripts are ruled out where any language is left."""
    scores = np.add.reduceat(model.weights[words.buckets], words.starts, axis=0)
    allowed = model.allowed[words.scripts]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return np.where(allowed, scores, _RULED_OUT)


def label_words(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word under the switching penalty (Viterbi).

    Leaving the best single language for a run of words costs at least one switch per language used in
    it. Where no run of words gains more than that in any one language, and the best beginning and the
    best end together do not either, staying is optimal and nothing needs to be traced.
    """
    best = int(scores.sum(0).argmax())
    gain = np.zeros((len(scores) + 1, scores.shape[1]))
    np.cumsum(scores - scores[:, best:best + 1], axis=0, out=gain[1:])
    lowest = np.minimum.accumulate(gain, axis=0)
    if (gain - lowest).max() <= switch and gain.max() + (gain[-1] - lowest[-1]).max() <= switch:
        return np.full(len(scores), best)
    n = scores.shape[1]
    value = [0.0] * n
    came: list[tuple[int, list[bool]]] = []
    for row in scores.tolist():
        top = max(range(n), key=value.__getitem__)
        least = value[top] - switch
        moved = [v < least for v in value]
        came.append((top, moved))
        value = [(least if m else v) + s for v, m, s in zip(value, moved, row)]
    labels = np.empty(len(scores), np.int64)
    at = max(range(n), key=value.__getitem__)
    for i in range(len(scores) - 1, -1, -1):
        labels[i] = at
        top, moved = came[i]
        if moved[at]:
            at = top
    return labels


def label_text(text: str | None, model: Model) -> tuple[str, float, list[tuple[int, int, str]]]:
    """Language of most letters, its share of letters, and spans as (first word, words, language)."""
    words = read_words(text or "")
    if not len(words.starts) or not model.languages:
        return "und", 0.0, []
    labels = label_words(word_scores(words, model))
    lengths = np.diff(np.append(words.starts, len(words.buckets)))
    letters = np.bincount(labels, lengths, len(model.languages))
    top = int(letters.argmax())
    cuts = np.flatnonzero(np.diff(labels)) + 1
    first = np.concatenate(([0], cuts))
    spans = [(int(a), int(b - a), model.languages[labels[a]])
             for a, b in zip(first, np.append(cuts, len(labels)))]
    return model.languages[top], float(letters[top] / letters.sum()), spans


def identify(docs: DataFrame, model: Model, text: str = "text", output: str = "language") -> DataFrame:
    """``docs`` with ``output``: ``lang_pred, score, spans`` of the whole text.

    Null texts and texts without a letter are ``und`` with score 0; so is all text under a model without
    languages. A column named ``output`` is replaced. Of equal languages the first in code point order
    wins. Rows are independent of each other, so repeated rows get the same answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>")
    def label(texts: pd.Series) -> pd.DataFrame:
        out = [label_text(t, shared.value) for t in texts]
        return pd.DataFrame({"lang_pred": [x[0] for x in out], "score": [x[1] for x in out],
                             "spans": [[{"start": a, "words": n, "lang": g} for a, n, g in x[2]]
                                       for x in out]})

    return docs.withColumn(output, label.asNondeterministic()(F.col(text)))


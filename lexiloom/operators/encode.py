"""Text to token ids and back with a vocabulary table.

Encoding is one narrow pass: the vocabulary (bounded, checked) is broadcast and each Arrow batch is
segmented by itself, so no token is ever shuffled and a frequent word costs one lookup. A worker takes a
batch apart slice by slice, so what it holds depends neither on the batch nor on the length of a text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.fixed import BOS_ID, EOS_ID, SPECIALS, UNK_ID, WHITESPACE, WORD_MARK
from ..functions.merging import merge_neighbours, merge_short
from ..functions.text import col

MAX_VOCAB = 2_000_000
_MEMO_WORDS = 500_000
_MEMO_IDS = 8_000_000
#: Bytes of texts and number of words taken at a time: words in Python take ten times the memory of their text.
_SLICE_BYTES, _STRETCH = 1 << 19, 1 << 16
_SHORT_WORD = 48
_SPECIAL = re.compile("(" + "|".join(re.escape(s) for s in SPECIALS) + ")")
_WORD = re.compile(f"[^{re.escape(WHITESPACE)}]+")
# With spaces kept, every space begins a chunk, and so does every line break.
_CHUNK = re.compile(f"[{WORD_MARK}\n]?[^{WORD_MARK}\n]+|[{WORD_MARK}\n]")
#: Pieces that stand for single bytes. Fixed form.
BYTE_PIECES = tuple(f"<0x{b:02X}>" for b in range(256))
_BYTE_SET = frozenset(BYTE_PIECES)


def vocab_rows(vocab: DataFrame) -> list[tuple[int, str, float]]:
    """The vocabulary on the driver, refused above ``MAX_VOCAB`` pieces."""
    rows = vocab.select("id", "piece", "score").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a vocabulary of more than {MAX_VOCAB} pieces cannot be broadcast")
    return sorted((r.id, r.piece, r.score) for r in rows)


def merge_rules(rows: list[tuple[int, str, float]]) -> dict[str, tuple[float, str]]:
    """Pieces as rules: neighbours whose joined text is a piece merge, the highest score first."""
    return {piece: (-score, piece) for _, piece, score in rows
            if piece not in SPECIALS and piece not in BYTE_PIECES}


def with_byte_pieces(vocab: DataFrame) -> DataFrame:
    """The vocabulary with the 256 byte pieces at its end, so that no character is unknown."""
    first = vocab.agg(F.max("id")).first()[0] + 1
    rows = [(first + b, piece, 0.0, "byte") for b, piece in enumerate(BYTE_PIECES)]
    return vocab.unionByName(vocab.sparkSession.createDataFrame(rows, vocab.schema))


class _Numbers(dict):
    """Numbers of the words seen; a new one is segmented when it is first asked for."""

    def __init__(self, encoder: BatchEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word) -> int:
        number = self[word] = len(self)
        self.encoder.add(word)
        return number


class BatchEncoder:
    """Ids of texts. Every distinct word is segmented once, and the ids of a stretch of words are taken from those
    of its distinct ones in one step. A memo that has grown too large is begun anew between two stretches.

    Where the vocabulary has all byte pieces, an unknown character is written as its bytes, else a run
    of them as one unknown piece. Literal special pieces and marks in a text stand among the words as tuples.
    """

    def __init__(self, rows: list[tuple[int, str, float]], literals: bool, keep_spaces: bool):
        self.literals, self.keep_spaces = literals, keep_spaces
        self.ids = {}
        for i, piece, _ in rows:
            self.ids.setdefault(piece, i)
        self.rules = merge_rules(rows)
        self.ranks = {piece: rank for piece, (rank, _) in self.rules.items()}
        self.special = {(p,): self.ids.get(p, i) for i, p in enumerate(SPECIALS)}
        codes = [self.ids.get(p) for p in BYTE_PIECES]
        self.bytes = None if None in codes else codes
        self.clear()

    def clear(self) -> None:
        self.numbers, self.pool, self.ends = _Numbers(self), array("i"), array("q", [0])

    def add(self, word: str | tuple[str]) -> None:
        self.pool.extend(self.segment(word))
        self.ends.append(len(self.pool))

    def segment(self, word: str | tuple[str]) -> list[int]:
        if isinstance(word, tuple):
            if word in self.special:
                return [self.special[word]]
            # A mark in the text itself.
            return [UNK_ID] if self.bytes is None else [self.bytes[b] for b in WORD_MARK.encode()]
        word = word if self.keep_spaces else WORD_MARK + word
        pieces = merge_short(word, self.ranks) if len(word) <= _SHORT_WORD else merge_neighbours(
            word, self.rules.get)
        found = [*map(self.ids.get, pieces)]
        if None not in found and UNK_ID not in found:
            return found
        found = []
        for piece in pieces:
            i = self.ids.get(piece, UNK_ID)
            if i == UNK_ID and self.bytes is not None:
                found += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif i != UNK_ID or not found or found[-1] != UNK_ID:
                found.append(i)
        return found

    def words(self, text: str) -> Iterable:
        if not self.literals or not _SPECIAL.search(text):
            return self.plain(text)
        return self.parsed(text)

    def parsed(self, text: str) -> Iterator:
        for part in _SPECIAL.split(text):
            if (part,) in self.special:
                yield (part,)
            else:
                yield from self.plain(part)

    def plain(self, text: str) -> Iterable:
        return self.spaced(text) if self.keep_spaces else _found(_WORD, text)

    def spaced(self, text: str) -> Iterator:
        for i, stretch in enumerate(text.split(WORD_MARK) if text else ()):
            if i:
                yield (WORD_MARK,)
            marked = stretch.replace(" ", WORD_MARK)
            yield from _found(_CHUNK, marked if i else WORD_MARK + marked)

    def numbered(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """The numbers of all words in stretches, each with the places in it where a text ends."""
        at, ended = array("i"), []
        for text in texts:
            words, more = iter(self.words(text) if text else ()), True
            while more:
                before = len(at)
                at.extend(map(self.numbers.__getitem__, islice(words, _STRETCH)))
                more = len(at) == before + _STRETCH
                if not more:
                    ended.append(len(at))
                if len(at) >= _STRETCH:
                    yield np.asarray(at), ended
                    at, ended = array("i"), []
                    if len(self.numbers) > _MEMO_WORDS or len(self.pool) > _MEMO_IDS:
                        self.clear()
        yield np.asarray(at), ended
        if len(self.numbers) > _MEMO_WORDS or len(self.pool) > _MEMO_IDS:
            self.clear()

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered words one after another, and where each word ends."""
        # Views: an array cannot grow while one is left.
        ends, pool = np.asarray(self.ends), np.asarray(self.pool)
        starts = ends[at]
        lengths = ends[at + 1] - starts
        after = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(after[-1]) + np.repeat(starts - after[:-1], lengths)
        return pool[places], after

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends."""
        parts, upto, total = [], [np.zeros(1, np.int64)], 0
        for at, ended in self.numbered(texts):
            ids, after = self.taken(at)
            parts.append(ids)
            upto.append(total + after[ended])
            total += len(ids)
        return np.concatenate(parts), np.concatenate(upto)


class BatchCounter(BatchEncoder):
    """Numbers of tokens and of unknowns of texts in several vocabularies at once. Words are the same in all of
    them, so a text is taken apart once, and of a distinct word only its numbers are kept."""

    def __init__(self, vocabs: list[list[tuple[int, str, float]]], literals: bool = True, keep_spaces: bool = False):
        self.encoders = [BatchEncoder(rows, literals, keep_spaces) for rows in vocabs]
        super().__init__(vocabs[0], literals, keep_spaces)

    def add(self, word: str | tuple[str]) -> None:
        for encoder in self.encoders:
            ids = encoder.segment(word)
            self.pool.extend((len(ids), ids.count(UNK_ID)))

    def count(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: tokens and unknowns in the first vocabulary, in the second, and so on."""
        width = 2 * len(self.encoders)
        total, upto = np.zeros((1, width), np.int64), [np.zeros((1, width), np.int64)]
        for at, ended in self.numbered(texts):
            sums = np.asarray(self.pool).reshape(-1, width)[at].cumsum(axis=0, dtype=np.int64)
            sums = np.concatenate([total, total + sums])
            upto.append(sums[ended])
            total = sums[-1:]
        return np.diff(np.concatenate(upto), axis=0)


def _found(pattern: re.Pattern, text: str) -> Iterable[str]:
    """All matches, those of a long text one at a time."""
    if len(text) <= _SLICE_BYTES:
        return pattern.findall(text)
    return map(re.Match.group, pattern.finditer(text))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts of a batch in slices of at most ``_SLICE_BYTES``, longer texts alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + _SLICE_BYTES, "right")))
        yield texts.slice(start, end - start)
        start = end


def _by_slices(shared, make, result, kind: T.DataType):
    """An Arrow function of texts: ``result`` of every slice, by what ``make`` makes of the broadcast value."""

    def batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # A worker keeps its copy of the broadcast, and with it the words of its earlier tasks.
        held = shared.value
        if "encoder" not in held:
            held["encoder"] = make(held["rows"])
        for batch in texts:
            for part in _slices(batch):
                yield result(held["encoder"], part)

    # The annotations pick the iterator form; they must be real classes here.
    batches.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, kind)


def token_ids(spark, vocab: DataFrame, text: str | Column, parse_literals: bool = True,
              keep_spaces: bool = False) -> Column:
    """Ids of a text column, without begin and end marks."""
    shared = spark.sparkContext.broadcast({"rows": vocab_rows(vocab)})

    def ids_of(encoder: BatchEncoder, texts: pa.Array) -> pa.Array:
        ids, ends = encoder.encode(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids),
                                        mask=texts.is_null() if texts.null_count else None)

    encoded = _by_slices(shared, lambda rows: BatchEncoder(rows, parse_literals, keep_spaces), ids_of,
                         T.ArrayType(T.IntegerType()))
    return encoded(col(text))


def token_counts(spark, vocabs: list[DataFrame], text: str | Column) -> Column:
    """Tokens and unknowns of a text column in each vocabulary, as one array; null for null."""
    shared = spark.sparkContext.broadcast({"rows": [vocab_rows(vocab) for vocab in vocabs]})

    def counts_of(counter: BatchCounter, texts: pa.Array) -> pa.Array:
        counts = counter.count(texts.to_pylist())
        ends = np.arange(len(texts) + 1) * counts.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts.ravel()),
                                        mask=texts.is_null() if texts.null_count else None)

    return _by_slices(shared, BatchCounter, counts_of, T.ArrayType(T.LongType()))(col(text))


def special_tokens(ids: Column, add_bos: bool, add_eos: bool) -> Column:
    parts = [F.array(F.lit(BOS_ID))] if add_bos else []
    parts.append(ids)
    if add_eos:
        parts.append(F.array(F.lit(EOS_ID)))
    return F.concat(*parts) if len(parts) > 1 else ids


def encode(df: DataFrame, vocab: DataFrame, text: str | Column = "text", out: str = "input_ids",
           add_bos: bool = True, add_eos: bool = False, parse_literals: bool = True,
           max_length: int | None = None, keep_spaces: bool = False) -> DataFrame:
    """Add the token ids of a text column.

    ``keep_spaces`` writes every space and line break; without it words are what is between them.
    With byte pieces in the vocabulary (``with_byte_pieces``) such ids give the very text back.

    With literals recognised, a wrapped document encoded with both marks begins with two begin ids
    and ends with two end ids, as in the original pretraining rows.
    """
    ids = token_ids(df.sparkSession, vocab, text, parse_literals, keep_spaces)
    ids = special_tokens(ids, add_bos, add_eos)
    return df.withColumn(out, F.slice(ids, 1, max_length) if max_length is not None else ids)


def with_attention_mask(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(ids)))


def tokenize(df: DataFrame, vocab: DataFrame, ids: str = "input_ids",
             out: str = "pieces") -> DataFrame:
    """Ids as pieces; an id without a piece is an error.

    The vocabulary is one constant array, so a piece is a position lookup.
    """
    return df.withColumn(out, F.transform(ids, _lookup(_piece_table(vocab))))


def _piece_table(vocab: DataFrame) -> list[str]:
    rows = vocab_rows(vocab)
    if rows and rows[-1][0] >= MAX_VOCAB:
        raise ValueError(f"ids must stay below {MAX_VOCAB}")
    table = [""] * (rows[-1][0] + 1 if rows else 0)
    for i, piece, _ in rows:
        if "\n" in piece:
            raise ValueError("pieces must not contain line breaks")
        table[i] = piece
    return table


def _lookup(table: list[str]):
    pieces = F.split(F.lit("\n".join(table)), "\n")
    return lambda i: F.coalesce(F.get(pieces, i), F.raise_error(
        F.concat(F.lit("no piece has the id "), i.cast("string"))))


def decode_ids(df: DataFrame, vocab: DataFrame, ids: str = "input_ids",
               out: str = "text") -> DataFrame:
    """Ids back to text: pieces joined, word marks as spaces, no leading space.

    An id without a piece is an error, never left out. With byte pieces in the vocabulary all pieces are put
    together as bytes, so these become the characters they write and no character stands for anything else.
    """
    table = _piece_table(vocab)
    if set(BYTE_PIECES) <= set(table):
        coded = [piece[3:5] if piece in _BYTE_SET else piece.replace(WORD_MARK, " ").encode("utf-8").hex()
                 for piece in table]
        text = F.unhex(F.array_join(F.transform(ids, _lookup(coded)), "")).cast("string")
    else:
        text = F.translate(F.array_join(F.transform(ids, _lookup(table)), ""), WORD_MARK, " ")
    return df.withColumn(out, F.regexp_replace(text, "^ ", ""))


def peek(df: DataFrame, vocab: DataFrame, key: str, ids: str | None = None, text: str = "text"
         ) -> DataFrame:
    """First row by key, decoded. Without ids only that row's text is encoded."""
    first = df.select(key, ids or text).orderBy(key).limit(1)
    if ids is None:
        first = encode(first, vocab, text, "input_ids", add_bos=False)
    return decode_ids(first, vocab, ids or "input_ids").select(key, "text")


def compare_vocabs(df: DataFrame, vocabs: dict[str, DataFrame], by: list[str] = ["source"],
                   text: str = "text") -> DataFrame:
    """Tokens, characters, tokens per character and share of unknowns, per vocabulary and group.

    All vocabularies take their counts from one pass over the words of a text; no ids leave a worker.
    """
    counted = df.select(*by, F.length(text).alias("_chars"),
                        token_counts(df.sparkSession, list(vocabs.values()), text).alias("_counts"))
    per_vocab = counted.select(*by, "_chars", F.explode(F.array(*[
        F.struct(F.lit(n).alias("vocab"), F.get("_counts", F.lit(2 * i)).alias("tokens"),
                 F.get("_counts", F.lit(2 * i + 1)).alias("unknown"))
        for i, n in enumerate(vocabs)])).alias("v")).select(*by, "_chars", "v.*")
    summed = per_vocab.groupBy("vocab", *by).agg(
        F.sum("tokens").alias("n_tokens"), F.sum("_chars").alias("n_chars"),
        F.sum("unknown").alias("n_unknown"))
    return summed.select(
        "vocab", *by, "n_tokens", "n_chars",
        F.round(F.try_divide("n_tokens", "n_chars"), 6).alias("tokens_per_char"),
        F.round(F.try_divide("n_unknown", "n_tokens"), 6).alias("unknown_share"))

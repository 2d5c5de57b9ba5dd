"""Learning a byte-pair vocabulary as a Spark job over the table of distinct words.

Inside the job every symbol is one code point: characters stand for themselves and merged pieces take
the code points from ``_FIRST_MERGED`` on that no character of the corpus has. Merging a pair is then a literal ``replace`` and a
word's pairs are its neighbouring code points. Counting, ranking and cutting are plain expressions;
only the rules of a round are applied by a small Arrow function.

Pairs rank by (count desc, newer symbol asc, left, right). A round makes many merges with the same
result as one at a time. Take the ``k`` best pairs as candidates and cut every word wherever two
neighbours are not a candidate. What is left are short runs; the distinct ones with their counts
are few and come to the driver, which merges in them pair by pair:

* whenever two symbols P and Q are neighbours, the last old symbol in P and the first in Q are an
  old pair at that place, so P Q counts at most what that old pair did at the start of the round;
* so a pair that ranks above the first pair that is not a candidate has all its places inside the
  runs, and its count there is exact. The round ends when no such pair is left;
* it also ends after a pair whose text already is a symbol, since that adds places to old pairs.

If there are too many distinct runs, fewer candidates are taken; a single one needs no runs at all.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixed import CHARACTER_COVERAGE, SPECIALS, VOCAB_SIZE, WORD_MARK
from ..functions.merging import merge_neighbours
from ..storage import drop_table, write_table
from .vocab import VOCAB_SCHEMA, alphabet, word_counts

_FIRST_MERGED = 0x40000
_LAST_MERGED = 0x10FFFD
_UNKNOWN = " "
_FIRST_CANDIDATES = 64
_MAX_CANDIDATES = 8192
_MAX_RUNS = 100_000
_WORDS_PER_TASK = 20_000
_SHORT_WORD = 32
#: Words of an Arrow batch, and neighbours whose codes are counted in one step.
_BATCH_WORDS, _COUNTED_AT_ONCE = 20_000, 1 << 21
#: Bits of a code point.
_CODE_BITS = 21
MIN_COUNT = 2


@dataclass
class Symbols:
    """Merged symbols so far: bounded by the vocabulary size."""

    text_of: dict[str, str] = field(default_factory=dict)
    symbol_of: dict[str, str] = field(default_factory=dict)
    merges: list[tuple[str, str]] = field(default_factory=list)
    characters: frozenset[int] = frozenset()
    following: int = _FIRST_MERGED

    def text(self, symbol: str) -> str:
        return self.text_of.get(symbol, symbol)

    def known(self, pair: str) -> bool:
        return self.text(pair[0]) + self.text(pair[1]) in self.symbol_of

    def add(self, pair: str) -> str:
        """Record the merge and return the symbol it writes."""
        joined = self.text(pair[0]) + self.text(pair[1])
        self.merges.append((self.text(pair[0]), self.text(pair[1])))
        if joined not in self.symbol_of:
            while self.following in self.characters:
                self.following += 1
            code = self.following
            if code > _LAST_MERGED:
                raise ValueError("too many merges")
            self.following += 1
            self.symbol_of[joined] = chr(code)
            self.text_of[chr(code)] = joined
        return self.symbol_of[joined]


@contextmanager
def wide_batches(spark: SparkSession) -> Iterator[None]:
    """Words are short, and what a batch costs besides them should not count."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(_BATCH_WORDS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def usable_characters(chars: DataFrame) -> tuple[list[str], str]:
    """Kept characters, the most frequent first, and all others; at most the size of Unicode."""
    rows = sorted(chars.collect(), key=lambda r: (-r.n, r.ch))
    return [r.ch for r in rows if r.kept], "".join(r.ch for r in rows if not r.kept)


def symbol_words(counts: DataFrame, dropped: str) -> DataFrame:
    """``symbols, n`` of the marked words; a dropped character becomes a barrier."""
    marked = F.concat(F.lit(WORD_MARK), "word")
    if dropped:
        marked = F.translate(marked, dropped, _UNKNOWN * len(dropped))
    return counts.select(marked.alias("symbols"), "n")


def _neighbours(symbols: str) -> str:
    """SQL for all pairs of neighbouring symbols, without those at a barrier."""
    parts = f"split({symbols}, '')"
    left, right = f"slice({parts}, 1, size({parts}) - 1)", f"slice({parts}, 2, size({parts}))"
    long = f"zip_with({left}, {right}, (a, b) -> concat(a, b))"
    # Cutting from the word is faster, but its cost grows with the square of the length.
    short = f"transform(sequence(1, greatest(length({symbols}) - 1, 1)), i -> substring({symbols}, i, 2))"
    pairs = f"if(length({symbols}) <= {_SHORT_WORD}, {short}, {long})"
    return f"filter({pairs}, p -> length(p) = 2 and not contains(p, '{_UNKNOWN}'))"


def merge_word(word: str, rules: dict[str, tuple[int, str]]) -> str:
    """One word after the rules (pair -> position, symbol), each applied once and in order."""
    return "".join(merge_neighbours(word, rules.get, in_order=True))


@dataclass
class _Batch:
    """Words of an Arrow batch as one text, and the codes of all neighbours, -1 at a barrier or after a word."""

    counts: np.ndarray
    lengths: np.ndarray
    text: str
    pairs: np.ndarray

    @classmethod
    def read(cls, words: pa.Array, counts: pa.Array) -> _Batch:
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py()
        symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = np.full(len(symbols), -1, np.int64)
        pairs[:-1] = symbols[:-1] << _CODE_BITS | symbols[1:]
        barrier = symbols == ord(_UNKNOWN)
        pairs[barrier] = -1
        pairs[:-1][barrier[1:]] = -1
        pairs[np.cumsum(lengths)[lengths > 0] - 1] = -1
        return cls(counts.to_numpy(zero_copy_only=False), lengths, text, pairs)

    def word_at(self, places: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)[places]

    def runs(self, codes: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Where stretches begin in which all neighbours are among the sorted ``codes``, and their texts."""
        at = np.minimum(np.searchsorted(codes, self.pairs), len(codes) - 1)
        edges = np.diff((codes[at] == self.pairs).astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
        return starts, [self.text[i:j] for i, j in zip(starts.tolist(), ends.tolist())]


def _cut(text: str, lengths: np.ndarray) -> pa.Array:
    """A text taken apart into words of these lengths."""
    data = np.frombuffer(text.encode(), np.uint8)
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    offsets = begins[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def _codes(pairs: list[str]) -> np.ndarray:
    return np.sort(np.array([ord(a) << _CODE_BITS | ord(b) for a, b in pairs], np.int64))


def _text_of(code: int) -> str:
    return chr(code >> _CODE_BITS) + chr(code & ((1 << _CODE_BITS) - 1))


def merged_words(table: DataFrame, candidates: list[str], merged: Callable[[str], str | None]) -> DataFrame:
    """``symbols, n, was`` after a round; ``was`` is a changed word before, null for the others.

    All that merges in a round lies inside the runs of its candidates, so a word changes by what became of its
    runs on the driver: ``merged`` gives the text of a run afterwards, None if it stays as it was.
    """
    listed = _codes(candidates)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, counts = batch.columns
            read = _Batch.read(words, counts)
            parts, last, places, shorter = [], 0, [], []
            starts, runs = read.runs(listed)
            for start, run in zip(starts.tolist(), runs):
                after = merged(run)
                if after is not None:
                    parts += (read.text[last:start], after)
                    last = start + len(run)
                    places.append(start)
                    shorter.append(len(run) - len(after))
            was = pa.nulls(len(words), pa.string())
            if places:
                at = read.word_at(np.array(places, np.int64))
                lengths = read.lengths.copy()
                np.subtract.at(lengths, at, np.array(shorter, np.int64))
                changed = np.zeros(len(words), bool)
                changed[at] = True
                was = pc.if_else(pa.array(changed), words, was)
                words = _cut("".join(parts) + read.text[last:], lengths)
            yield pa.RecordBatch.from_arrays([words, counts, was], ["symbols", "n", "was"])

    return table.select("symbols", "n").mapInArrow(merge, "symbols string, n bigint, was string")


def pair_counts(symbol_table: DataFrame) -> DataFrame:
    exploded = symbol_table.selectExpr(f"explode({_neighbours('symbols')}) as pair", "n")
    return exploded.groupBy("pair").agg(F.sum("n").alias("n"))


def coded_counts(table: DataFrame) -> DataFrame:
    """``pair, n``: how often each pair of neighbours is in ``symbols``, less how often it is in ``was`` where that
    column is there. A pair is the number its two code points make."""
    columns = [c for c in ("symbols", "was") if c in table.columns]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, at, np.concatenate([n for _, n in held]))
            held.clear()
            keep = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array(codes[keep]), pa.array(sums[keep])], ["pair", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for sign, words in zip((1, -1), batch.columns[1:]):
                read = _Batch.read(words, batch.column(0))
                places = np.flatnonzero(read.pairs >= 0)
                held.append((read.pairs[places], sign * read.counts[read.word_at(places)]))
            if sum(len(codes) for codes, _ in held) > _COUNTED_AT_ONCE:
                yield flush()
        if held:
            yield flush()

    found = table.select("n", *columns).mapInArrow(count, "pair bigint, n bigint")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def changed_counts(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pair counts after a round: those before, and what the words that changed add and take away.

    A pair's count only falls after the round that made it, so pairs too rare to merge are dropped.
    """
    moves = coded_counts(table.where("was is not null"))
    return pairs.union(moves).groupBy("pair").agg(F.sum("n").alias("n")).where(f"n >= {MIN_COUNT}")


def _rank(pair: str, n: int) -> tuple:
    return -n, max(pair), pair[0], pair[1]


def ranked(pairs: DataFrame) -> DataFrame:
    """Coded pairs, the best first."""
    left, right = F.shiftright("pair", _CODE_BITS), F.col("pair").bitwiseAND((1 << _CODE_BITS) - 1)
    return pairs.orderBy(F.desc("n"), F.greatest(left, right), left, right)


def candidate_runs(symbol_table: DataFrame, candidates: list[str]) -> DataFrame:
    """Distinct stretches of words in which all neighbours are candidates, with their counts.

    A task that finds more than ``_MAX_RUNS`` of them stops: that many are no use, whatever the others find.
    """
    listed = _codes(candidates)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            read = _Batch.read(*batch.columns)
            starts, runs = read.runs(listed)
            for run, n in zip(runs, read.counts[read.word_at(starts)].tolist()):
                counts[run] += n
            if len(counts) > _MAX_RUNS:
                break
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["run", "n"])

    stretches = symbol_table.select("symbols", "n").mapInArrow(cut, "run string, n bigint")
    return stretches.groupBy("run").agg(F.sum("n").alias("n"))


def merge_in_runs(runs: list[tuple[str, int]], bound: tuple, symbols: Symbols, n_pieces: int,
                  merged: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """Merge pair by pair while the best pair ranks above ``bound``; returns the rules made.

    ``merged`` takes the runs that change, with their texts afterwards.
    """
    texts = [run for run, _ in runs]
    counts: Counter[str] = Counter()
    places: defaultdict[str, set[int]] = defaultdict(set)

    def count(i: int, sign: int) -> set[str]:
        pairs = [left + right for left, right in zip(texts[i], texts[i][1:])]
        for pair in pairs:
            counts[pair] += sign * runs[i][1]
            places[pair].add(i)
        return set(pairs)

    for i in range(len(runs)):
        count(i, 1)
    queue = [_rank(pair, n) for pair, n in counts.items()]
    heapify(queue)
    rules = []
    while queue and len(symbols.symbol_of) < n_pieces:
        best = heappop(queue)
        pair = best[2] + best[3]
        if counts[pair] != -best[0]:
            continue  # an older count of this pair
        if counts[pair] < MIN_COUNT or not best < bound:
            break
        known = symbols.known(pair)
        rules.append((pair, symbols.add(pair)))
        if known:
            for i in places[pair]:
                texts[i] = texts[i].replace(*rules[-1])
            break
        changed = set()
        for i in places.pop(pair):
            changed |= count(i, -1)
            texts[i] = texts[i].replace(*rules[-1])
            changed |= count(i, 1)
        for p in changed:
            heappush(queue, _rank(p, counts[p]))
    if merged is not None:
        merged.update((run, text) for (run, _), text in zip(runs, texts) if run != text)
    return rules


def _rows(df: DataFrame) -> list[tuple[str, int]]:
    """Rows of a bounded frame of text and count."""
    columns = df.toArrow()
    return list(zip(columns[0].to_pylist(), columns[1].to_pylist()))


def _round(table: DataFrame, pairs: DataFrame, symbols: Symbols, n_pieces: int,
           k: int) -> tuple[list[tuple[str, str]], list[str], Callable[[str], str | None], int]:
    """Rules of one round, its candidates, what becomes of their runs, and the number of candidates to begin the
    next with."""
    best = _rows(ranked(pairs.where(F.col("n") >= MIN_COUNT)).limit(k + 1))
    top = [(_text_of(code), n) for code, n in best]
    while top:
        candidates = [p for p, _ in top[:k]]
        if len(candidates) == 1:
            pair = candidates[0]
            symbol = symbols.add(pair)
            return [(pair, symbol)], candidates, lambda run: run.replace(pair, symbol), 2
        found = _rows(candidate_runs(table, candidates).limit(_MAX_RUNS + 1))
        if len(found) <= _MAX_RUNS:
            bound = _rank(*top[k]) if len(top) > k else (0,)
            merged: dict[str, str] = {}
            rules = merge_in_runs(found, bound, symbols, n_pieces, merged)
            growth = 4 if len(found) < _MAX_RUNS // 20 else 2
            return rules, candidates, merged.get, min(growth * k, _MAX_CANDIDATES)
        k = max(k // 2, 1)
    return [], [], {}.get, k


def learn_merges(symbol_table: DataFrame, n_pieces: int, kept: Sequence[str] = ()) -> Symbols:
    """Merge until there are ``n_pieces`` merged pieces or no pair occurs twice.

    ``kept`` are the characters of the words, which no merged piece may stand for. There is room for
    850,000 merged pieces less those characters.

    A round passes words without a merged pair on as they are and keeps pair counts by the differences of the
    words that change. Both tables are written after each round, so no round depends on the plan or the cached
    blocks of another.
    """
    spark = symbol_table.sparkSession
    symbols = Symbols(characters=frozenset(ord(c) for c in kept if ord(c) >= _FIRST_MERGED))
    # Merging is heavy on CPU and light on bytes: the size of the files would give too few tasks.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(partitions, symbol_table.count() // _WORDS_PER_TASK))
    table, table_path = write_table(symbol_table.repartition(tasks), "bpe-words")
    with wide_batches(spark):
        return _learn(table, table_path, n_pieces, symbols)


def _learn(table: DataFrame, table_path: str, n_pieces: int, symbols: Symbols) -> Symbols:
    spark = table.sparkSession
    pairs, pairs_path = write_table(coded_counts(table), "bpe-pairs")
    k = _FIRST_CANDIDATES
    while len(symbols.symbol_of) < n_pieces:
        known = len(symbols.symbol_of)
        rules, candidates, merged, k = _round(table, pairs, symbols, n_pieces, k)
        if not rules or len(symbols.symbol_of) >= n_pieces:
            break
        old_paths = table_path, pairs_path
        table, table_path = write_table(merged_words(table, candidates, merged), "bpe-words")
        # A pair whose text was a symbol before adds places to old pairs: then all are counted anew.
        again = len(symbols.symbol_of) < known + len(rules)
        pairs, pairs_path = write_table(
            coded_counts(table.select("symbols", "n")) if again else changed_counts(pairs, table), "bpe-pairs")
        table = table.select("symbols", "n")
        for path in old_paths:
            drop_table(spark, path)
    for path in (table_path, pairs_path):
        drop_table(spark, path)
    return symbols


def train_bpe(df: DataFrame, vocab_size: int = VOCAB_SIZE, coverage: float = CHARACTER_COVERAGE,
              text: str = "text", n_merged: int | None = None) -> DataFrame:
    """Vocabulary of special pieces, merged pieces in the order learnt, then characters.

    ``n_merged`` sets the number of merged pieces directly instead of by ``vocab_size``.
    """
    spark = df.sparkSession
    counts, path = write_table(word_counts(df, text), "bpe-counts")
    kept, dropped = usable_characters(alphabet(counts, coverage))
    room = n_merged if n_merged is not None else max(vocab_size - len(SPECIALS) - len(kept), 0)
    if room > _LAST_MERGED - _FIRST_MERGED - len(kept):
        raise ValueError("too many merges")
    symbols = learn_merges(symbol_words(counts, dropped), room, kept)
    drop_table(spark, path)
    pieces = list(SPECIALS) + [p for p in symbols.symbol_of if p not in SPECIALS] + kept
    rows = [
        (i, piece, 0.0 if i < len(SPECIALS) else float(len(SPECIALS) - i), "trained")
        for i, piece in enumerate(pieces)
    ]
    return spark.createDataFrame(rows, VOCAB_SCHEMA)


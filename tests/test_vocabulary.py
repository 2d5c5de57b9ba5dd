import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import fixed
from lexiloom.functions import merging
from lexiloom.functions.merging import merge_neighbours
from lexiloom.operators import bpe, encode, vocab
from lexiloom.plans import queries, vocabulary

SCHEMA = vocab.VOCAB_SCHEMA


def sequential(words, n_pieces):
    """One merge at a time, on lists of strings; ties as documented."""
    table = {w: list("▁" + w) for w in words}
    age: dict[str, int] = {}
    merges = []

    def newness(symbol):
        return (1, age[symbol]) if symbol in age else (0, ord(symbol))

    while len(age) < n_pieces:
        counts = Counter()
        for w, n in words.items():
            for pair in zip(table[w], table[w][1:]):
                counts[pair] += n
        if not counts:
            break
        pair = min(counts, key=lambda p: (-counts[p], max(newness(p[0]), newness(p[1])),
                                          newness(p[0]), newness(p[1])))
        if counts[pair] < 2:
            break
        merges.append(pair)
        age.setdefault("".join(pair), len(age))
        for w, symbols in table.items():
            out, i = [], 0
            while i < len(symbols):
                if tuple(symbols[i:i + 2]) == pair:
                    out.append("".join(pair))
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            table[w] = out
    return merges


def random_words(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abcd"
    words = Counter()
    for _ in range(rng.randint(1, 12)):
        words["".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))] += rng.randint(1, 5)
    if seed % 5 == 0:
        words["aaaa" * rng.randint(1, 3)] += rng.randint(1, 4)
    return words


def corpus(spark, words):
    return spark.createDataFrame([(" ".join([w] * n),) for w, n in words.items()], "text string")


@pytest.mark.parametrize("seed", range(8))
def test_spark_training_equals_one_merge_at_a_time(spark, seed):
    words = random_words(seed)
    counts = vocab.word_counts(corpus(spark, words))
    learnt = bpe.learn_merges(bpe.symbol_words(counts, ""), 12)
    assert learnt.merges == sequential(words, 12)


def in_rounds(words, n_pieces, k):
    """The trainer's rounds on plain dictionaries instead of tables."""
    symbols = bpe.Symbols()
    table = Counter({"▁" + w: n for w, n in words.items()})
    while len(symbols.symbol_of) < n_pieces:
        pairs = Counter()
        for s, n in table.items():
            for a, b in zip(s, s[1:]):
                pairs[a + b] += n
        top = sorted(((p, n) for p, n in pairs.items() if n >= 2), key=lambda x: bpe._rank(*x))[:k + 1]
        if not top:
            break
        candidates = {p for p, _ in top[:k]}
        runs = Counter()
        for s, n in table.items():
            cut = "".join(a if a + b in candidates else a + " " for a, b in zip(s, s[1:])) + s[-1]
            for run in cut.split(" "):
                if len(run) > 1:
                    runs[run] += n
        bound = bpe._rank(*top[k]) if len(top) > k else (0,)
        rules = bpe.merge_in_runs(list(runs.items()), bound, symbols, n_pieces)
        assert rules
        shared = {pair: (i, symbol) for i, (pair, symbol) in enumerate(rules)}
        assert len(shared) == len(rules)
        merged = Counter()
        for s, n in table.items():
            merged[bpe.merge_word(s, shared)] += n
            for rule in rules:
                s = s.replace(*rule)
            assert s in merged
        table = merged
    return symbols.merges


def test_rounds_of_any_width_equal_one_merge_at_a_time():
    for seed in range(5_000):
        words = random_words(seed)
        n = 1 + seed % 25
        assert in_rounds(words, n, 1 + seed % 7) == sequential(words, n), seed


@pytest.mark.parametrize("limit", [1, 20, 300])
def test_too_many_runs_take_fewer_candidates(spark, monkeypatch, limit):
    monkeypatch.setattr(bpe, "_MAX_RUNS", limit)
    words = random_words(4)
    counts = vocab.word_counts(corpus(spark, words))
    learnt = bpe.learn_merges(bpe.symbol_words(counts, ""), 8)
    assert learnt.merges == sequential(words, 8)


def test_training_on_documents_equals_one_merge_at_a_time(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = vocab.word_counts(docs).orderBy(F.desc("n"), "word").limit(2_000)
    rows = {r.word: r.n for r in counts.collect()}
    table = spark.createDataFrame(list(rows.items()), "word string, n long")
    learnt = bpe.learn_merges(bpe.symbol_words(table, ""), 500)
    assert learnt.merges == sequential(rows, 500)


def test_vocabulary_layout(spark):
    df = spark.createDataFrame([("low low low lower lowest ☃",)], "text string")
    rows = bpe.train_bpe(df, vocab_size=15, coverage=1.0).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows)))
    assert [r.piece for r in rows[:3]] == ["<unk>", "<s>", "</s>"]
    assert len(rows) <= 15 and "☃" in {r.piece for r in rows}
    assert rows[3].score == 0.0 and rows[4].score == -1.0


def test_rare_characters_are_left_out(spark):
    df = spark.createDataFrame([("ab " * 500 + "ж",)], "text string")
    kept = {r.ch for r in vocab.alphabet(vocab.word_counts(df), 0.99).where("kept").collect()}
    assert kept == {"▁", "a", "b"}
    v = bpe.train_bpe(df, coverage=0.99, n_merged=2)
    assert "ж" not in {r.piece for r in v.collect()}
    ids = encode.encode(spark.createDataFrame([("abжжab",)], "text string"), v, add_bos=False)
    pieces = encode.tokenize(ids, v).first().pieces
    assert pieces.count("<unk>") == 1


def test_merged_symbols_do_not_collide_with_private_characters(spark):
    df = spark.createDataFrame([("ab ab \U000f0000x \U000f0000x",)], "text string")
    pieces = {r.piece for r in bpe.train_bpe(df, coverage=1.0, n_merged=4).collect()}
    assert {"\U000f0000", "\u2581ab", "\u2581\U000f0000x"} <= pieces


def test_quotes_and_backslashes_train(spark):
    df = spark.createDataFrame([("it's it's \\x \\x \"q\" \"q\" ,, ,,",)], "text string")
    pieces = {r.piece for r in bpe.train_bpe(df, coverage=1.0, n_merged=12).collect()}
    assert "▁it's" in pieces and "▁\\x" in pieces


def base_vocab(spark, pieces):
    return spark.createDataFrame([(i, p, float(-i), "base") for i, p in enumerate(pieces)], SCHEMA)


def test_merge_vocabularies(spark):
    base = base_vocab(spark, ["<unk>", "<s>", "</s>", "a", "b"])
    new = base_vocab(spark, ["<unk>", "b", "c", "d"])
    merged = vocab.merge_vocab(base, new)
    got = [(r.id, r.piece, r.score) for r in merged.orderBy("id").collect()]
    assert got[:5] == [(i, p, float(-i)) for i, p in enumerate(["<unk>", "<s>", "</s>", "a", "b"])]
    assert got[5:] == [(5, "c", 0.0), (6, "d", 0.0)]
    again = vocab.merge_vocab(merged, new)
    assert [(r.id, r.piece) for r in again.orderBy("id").collect()] == [(i, p) for i, p, _ in got]
    report = vocab.vocab_report(merged).first()
    assert (report.n_pieces, report.n_before, report.n_added) == (7, 5, 2)
    assert report.specials == "<unk>=0,<s>=1,</s>=2"
    assert vocab.vocab_growth(merged, 5).first().growth == 2
    assert vocab.vocab_growth(merged, 50).first().growth == 0
    assert [r.id for r in vocab.vocab_head(merged, 3).collect()] == [0, 1, 2]


def test_merge_plans_an_anti_join(spark):
    base, new = base_vocab(spark, ["a"]), base_vocab(spark, ["a", "b"])
    missing = new.join(base.select("piece"), "piece", "left_anti")
    assert "LeftAnti" in missing._jdf.queryExecution().executedPlan().toString()


def naive_segments(word, score):
    symbols = list(word)
    while True:
        best = None
        for i in range(len(symbols) - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None and (best is None or s > best[0]):
                best = (s, i)
        if best is None:
            return symbols
        symbols[best[1]:best[1] + 2] = ["".join(symbols[best[1]:best[1] + 2])]


def test_segments_equal_repeated_scanning():
    rng = random.Random(1)
    for _ in range(500):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(8)}
        score = {p: float(-rng.randint(0, 5)) for p in pieces}
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        rules = encode.merge_rules([(0, p, s) for p, s in score.items()])
        assert merge_neighbours(word, rules.get) == naive_segments(word, score)


def test_round_trip_and_marks(spark):
    text = "the  cat\nsat on the\tmat"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    v = bpe.train_bpe(df.where("id = 1"), coverage=1.0, n_merged=8)
    ids = encode.encode(df, v, add_bos=False)
    back = {r.id: r.text for r in encode.decode_ids(ids, v).collect()}
    assert back == {1: "the cat sat on the mat", 2: "", 3: None}
    wrapped = df.where("id = 1").withColumn("text", F.concat(F.lit("<s>"), "text", F.lit("</s>")))
    row = encode.encode(wrapped, v, add_eos=True).first().input_ids
    assert row[:2] == [1, 1] and row[-2:] == [2, 2] and 1 not in row[2:-2]
    plain = encode.encode(wrapped, v, add_bos=True, parse_literals=False).first().input_ids
    assert plain[0] == 1 and 2 not in plain
    assert encode.encode(wrapped, v, max_length=5).first().input_ids == row[:5]
    assert encode.peek(ids, v, "id").first().text == "the cat sat on the mat"
    mask = encode.with_attention_mask(ids.where("id = 1")).first()
    assert mask.attention_mask == [1] * len(mask.input_ids)


def test_encoding_needs_no_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    v = base_vocab(spark, ["<unk>", "<s>", "</s>", "▁", "a"])
    plan = encode.decode_ids(encode.encode(docs, v), v)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_merged_vocabulary_prefers_new_pieces(spark):
    base = spark.createDataFrame(
        [(i, p, s, "base") for i, (p, s) in enumerate(
            [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), ("▁a", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -3.0)])],
        SCHEMA)
    new = base_vocab(spark, ["<unk>", "ab"])
    merged = vocab.merge_vocab(base, new)
    df = spark.createDataFrame([("ab a b",)], "text string")
    pieces = encode.tokenize(encode.encode(df, merged, add_bos=False), merged).first().pieces
    score = {r.piece: r.score for r in merged.collect() if r.piece not in fixed.SPECIALS}
    assert pieces == [p for w in ("▁ab", "▁a", "▁b") for p in naive_segments(w, score)]
    compared = encode.compare_vocabs(df.withColumn("source", F.lit("s")), {"base": base, "merged": merged})
    got = {r.vocab: r.n_tokens for r in compared.collect()}
    assert got["merged"] == len(pieces)


def test_extended_vocabulary(spark):
    base = base_vocab(spark, ["<unk>", "<s>", "</s>", "▁"])
    corpus_rows = spark.createDataFrame([("火锅 火锅 火锅 很好",)], "text string")
    merged = vocabulary.extend_vocabulary(corpus_rows, base, vocab_size=12, coverage=1.0)
    rows = merged.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows)))
    assert "▁火锅" in {r.piece for r in rows}


def test_unknown_ids_are_refused(spark):
    v = spark.createDataFrame([(0, "<unk>", 0.0, "x"), (1, "<s>", 0.0, "x"), (2, "</s>", 0.0, "x"),
                               (3, "ab", -1.0, "x"), (4, "cd", -2.0, "x")], "id int, piece string, score float, origin string")
    ids = spark.createDataFrame([([3, 4],), ([3, 999, 4],), ([-1],)], "input_ids array<int>")
    good = ids.where(F.forall("input_ids", lambda i: i.between(0, 4)))
    assert encode.decode_ids(good, v).first().text == "abcd"
    for bad in (999, -1):
        with pytest.raises(Exception, match="no piece has the id"):
            encode.decode_ids(ids.where(F.array_contains("input_ids", bad)), v).collect()


def test_private_characters_survive(spark):
    text = "\U000f1234a \U000f1234b \U000f1234a \U00040000x \U00040000x \U0010fffdz"
    v = bpe.train_bpe(spark.createDataFrame([(1, text)], "id int, text string"), coverage=1.0)
    ids = encode.encode(spark.createDataFrame([(1, text)], "id int, text string"), v, add_bos=False)
    assert encode.decode_ids(ids, v).first().text == text
    assert 0 not in ids.first().input_ids


def test_every_text_comes_back(spark):
    texts = ["ab cd\ncd  ab", "  two  spaces ", "", "\n\n", "tab\there", "\u53e4\u6587 and \U0001f600", "<0x41> <s>", "\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    v = encode.with_byte_pieces(bpe.train_bpe(spark.createDataFrame([(1, "ab cd ab cd and")], "id int, text string")))
    ids = encode.encode(df, v, add_bos=False, parse_literals=False, keep_spaces=True)
    assert {r.id: r.text for r in encode.decode_ids(ids.drop("text"), v).collect()} == dict(enumerate(texts))
    unknown = encode.compare_vocabs(df, {"bytes": v}, ["id"])
    assert unknown.where("unknown_share > 0").isEmpty()


def test_merged_comparison_trains_to_the_default_size(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    base, new = bpe.train_bpe(queries.table(spark, sf_dir, "benchmark")), bpe.train_bpe(docs)
    want = encode.compare_vocabs(docs, {"base": base, "merged": vocab.merge_vocab(base, new), "new": new})
    got = queries.compare_vocabs_merged(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert queries.trained(spark, sf_dir, "documents").count() == new.count() > queries.FIRST_MERGES + 500


def test_any_text_comes_back(spark):
    """Word marks, noncharacters and the names of byte pieces in a text are characters like others."""
    texts = ["\u2581x a\u2581b", "a\uffff41 b", " \u2581 ", "<0x41>", "\n\u2581\n", "ab  cd\u2581", "\U0001f600\u2581\U0001f600", "", " "]
    v = encode.with_byte_pieces(bpe.train_bpe(spark.createDataFrame([("ab cd ab cd a\uffffb a\uffffb",)], "text string")))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ids = encode.encode(df.withColumnRenamed("text", "own"), v, "own", add_bos=False, parse_literals=False, keep_spaces=True)
    assert all(r.text == r.own for r in encode.decode_ids(ids, v).collect())


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=14), st.dictionaries(st.text("abc", min_size=2, max_size=4), st.integers(0, 3)))
def test_short_words_merge_as_long_ones(word, ranks):
    rules = {piece: (rank, piece) for piece, rank in ranks.items()}
    assert merging.merge_short(word, ranks) == merging.merge_neighbours(word, rules.get)


def test_slices_and_stretches(monkeypatch):
    """What is taken at a time is bounded, and the same ids come out however texts are cut."""
    pieces = [(i, p, 0.0 if i < 3 else -float(i)) for i, p in enumerate(["<unk>", "<s>", "</s>", "▁", "a", "b", "▁a", "ab", "▁ab"])]
    texts = ["ab a  b", None, "", "x" * 50, " ".join(f"a{i % 7}b" for i in range(400)), "<s>ab</s> b\nab ▁a"] * 3
    whole = {spaces: encode.BatchEncoder(pieces, True, spaces).encode(texts) for spaces in (False, True)}
    monkeypatch.setattr(encode, "_SLICE_BYTES", 64)
    monkeypatch.setattr(encode, "_STRETCH", 5)
    monkeypatch.setattr(encode, "_MEMO_WORDS", 3)
    for spaces, (ids, ends) in whole.items():
        encoder = encode.BatchEncoder(pieces, True, spaces)
        stretches = [len(at) for at, _ in encoder.numbered(texts)]
        assert max(stretches) < 2 * 5 and len(encoder.numbers) <= 3 + 2 * 5
        got, upto = encoder.encode(texts)
        assert got.tolist() == ids.tolist() and upto.tolist() == ends.tolist()
        counts = encode.BatchCounter([pieces, pieces[:-1]], True, spaces).count(texts)
        rows = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
        assert counts[:, :2].tolist() == [[len(r), r.count(0)] for r in rows]
    parts = list(encode._slices(pa.array(texts)))
    assert [t for part in parts for t in part.to_pylist()] == texts
    assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part.to_pylist()) <= 64 for part in parts)


def test_rounds_change_words_by_their_runs(spark):
    rows = [("▁abcé", 2), ("▁xab c", 3), ("ab𝄞abc", 1), ("▁", 4), ("▁zz", 5)]
    table = spark.createDataFrame(rows, "symbols string, n long").coalesce(1)
    changed = bpe.merged_words(table, ["ab", "bc"], {"abc": "X", "ab": "YZ"}.get)
    assert [tuple(r) for r in changed.collect()] == [
        ("▁Xé", 2, "▁abcé"), ("▁xYZ c", 3, "▁xab c"), ("YZ𝄞X", 1, "ab𝄞abc"), ("▁", 4, None), ("▁zz", 5, None)]
    text = {r.pair: r.n for r in bpe.pair_counts(table).collect()}
    after = {r.pair: r.n for r in bpe.pair_counts(changed).collect()}
    coded = {bpe._text_of(r.pair): r.n for r in bpe.coded_counts(table).collect()}
    moves = {bpe._text_of(r.pair): r.n for r in bpe.coded_counts(changed.where("was is not null")).collect()}
    assert coded == text
    assert moves == {p: after.get(p, 0) - text.get(p, 0) for p in after | text if after.get(p, 0) != text.get(p, 0)}


def test_too_many_runs_stop_a_task(spark, monkeypatch):
    monkeypatch.setattr(bpe, "_MAX_RUNS", 100)
    table = spark.range(200_000, numPartitions=1).selectExpr("concat('▁', bin(id)) as symbols", "1L as n")
    assert 100 < bpe.candidate_runs(table, ["▁1", "10", "11", "01", "00"]).count() < 100_000

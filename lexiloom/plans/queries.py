"""Every operator as a query over the given tables, each over whole tables and whole texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.text import clean_text, python_list_text, split_semicolons, words, wrap_document
from ..operators import batch, dialogue, encode, index, pack, sampling, sets, stats, supervised, vocab
from ..operators.bpe import pair_counts as count_pairs, symbol_words, train_bpe as learn, usable_characters
from ..operators.layout import spread
from ..sources import books, cache, json_records, lines, sinks, tree
from ..storage import new_path, write_table
from . import pretraining, tuning

#: Merges of ``documents`` that SQL can follow one by one, for the queries named ``first_merges`` and
#: their twins; all others train to the default size.
FIRST_MERGES = 200
CUSTOM_PATTERNS = ("th+", "[aeiou]", r"\d+")
PACK_BLOCK, PACK_ROWS = 256, 200
ARRAY_ROWS = 1000
WORD_BLOCK, WORD_ROWS = 128, 100
#: The longest example the original tunes on, and its rows per batch here.
TUNE_LENGTH, TUNE_ROWS = 4096, 8

_VOCABS: dict[tuple[str, str, str, int | None], list] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.gather_turns(table(spark, sf_dir, "conversations"))


def trained(spark: SparkSession, sf_dir: str, name: str, n_merged: int | None = None) -> DataFrame:
    """Vocabulary learnt from a table's texts, once per session, of the default size unless ``n_merged``."""
    key = (spark.sparkContext.applicationId, sf_dir, name, n_merged)
    if key not in _VOCABS:
        _VOCABS[key] = learn(spread(table(spark, sf_dir, name)), n_merged=n_merged).collect()
    return spark.createDataFrame(_VOCABS[key], vocab.VOCAB_SCHEMA)


def joined(ids: str) -> F.Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias(ids)


# Cleaning and templates

def clean_text_query(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", clean_text("text").alias("text"))


def clean_custom(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", clean_text("text", CUSTOM_PATTERNS).alias("text"))


def clean_extra(spark, sf_dir):
    marked = F.translate("text", ".", "※")
    return documents(spark, sf_dir).select(
        "doc_id", clean_text(marked, fixed.EXTRA_PATTERNS).alias("text"))


def semicolons(spark, sf_dir):
    marked = F.translate("text", ",", fixed.FULLWIDTH_SEMICOLON)
    return table(spark, sf_dir, "documents").select("doc_id", split_semicolons(marked).alias("text"))


def wrap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", wrap_document("text").alias("text"))


def render_chat(spark, sf_dir):
    return dialogue.render_chat(dialogues(spark, sf_dir))


def dialogue_to_instruction(spark, sf_dir):
    records = dialogue.dialogue_to_instruction(dialogues(spark, sf_dir))
    return records.withColumn("output", F.array_join("output", " | "))


def build_prompt(spark, sf_dir):
    return dialogue.build_prompt(dialogue.dialogue_to_instruction(dialogues(spark, sf_dir)))


def build_prompt_join(spark, sf_dir):
    records = dialogue.dialogue_to_instruction(dialogues(spark, sf_dir))
    return dialogue.build_prompt(records, list_output="join")


def maths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("original_text"),
        F.concat(F.lit("x="), F.col("o_custkey").cast("string"), F.lit("+1")).alias("equation"),
        (F.col("o_custkey") + 1).cast("string").alias("ans"))


def math_to_instruction(spark, sf_dir):
    return dialogue.math_to_instruction(maths(spark, sf_dir))


def math_to_chat(spark, sf_dir):
    return dialogue.math_to_chat(maths(spark, sf_dir))


# Files

def book_names(spark, sf_dir) -> DataFrame:
    suffix = F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dir"),
                                                    path.alias("path"))


def sample_one_per_dir(spark, sf_dir):
    return sampling.sample_one_per_dir(book_names(spark, sf_dir), "dir", "path")


def page_files(spark, sf_dir) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    name = F.concat(F.col("page_id").cast("string"), F.lit("-"), F.substring_index("url", "/", -1))
    return table(spark, sf_dir, "pages").select(host.alias("dir"), name.alias("file_name"))


def number_files(spark, sf_dir):
    return sampling.number_files(page_files(spark, sf_dir))


def rename_by_regex(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return sampling.rename_by_regex(pages, "[&?=]+")


def written_tree(spark, sf_dir) -> str:
    """The documents as a tree of ``.txt`` files, one folder per source."""
    root = new_path(spark, "tree")
    table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").text(root)
    return root


def scan_books(spark, sf_dir):
    decoded = books.decode_books(books.scan_books(spark, written_tree(spark, sf_dir)))
    return decoded.groupBy(F.substring_index("dir", "=", -1).alias("source"), "encoding").agg(
        F.sum(F.length("text")).alias("n_chars"))


def scan_books_paths(spark, sf_dir):
    """A file per document, in turn UTF-8, UTF-16, UTF-8 behind a mark, and GB18030."""
    root = new_path(spark, "encoded")
    docs = document_files(spark, sf_dir)
    form = F.col("doc_id") % 4

    @F.pandas_udf("binary")
    def as_gb18030(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.encode("gb18030"))

    utf8 = F.col("text").cast("binary")
    content = F.when(form == 1, F.encode("text", "UTF-16")).when(
        form == 2, F.concat(F.lit(b"\xef\xbb\xbf"), utf8)).when(
        form == 3, as_gb18030(F.when(form == 3, F.col("text")))).otherwise(utf8)
    tree.write_tree(docs.select("rel_path", content.alias("content")), root, "content")
    read = books.decode_books(books.scan_books(spark, root))
    return read.select("dir", "rel_path", "file_name", "encoding", F.md5("text").alias("text_md5"))


def document_files(spark, sf_dir) -> DataFrame:
    source = F.coalesce("source", F.lit("none"))
    path = F.concat(source, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("rel_path"),
                                                    F.coalesce("text", F.lit("")).alias("text"))


def write_books_files(spark, sf_dir):
    root = new_path(spark, "mirrored-files")
    books.write_books(document_files(spark, sf_dir), root, as_files=True)
    files = books.scan_books(spark, root)
    return files.select("rel_path", F.length("content").cast("bigint").alias("n_bytes"),
                        F.md5("content").alias("content_md5"))


def write_books(spark, sf_dir):
    root = new_path(spark, "mirrored")
    suffix = F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix)
    books.write_books(table(spark, sf_dir, "documents").select(path.alias("rel_path"), "text"), root)
    return spark.read.parquet(root)


def concat_corpus(spark, sf_dir):
    path = new_path(spark, "corpus")
    named = table(spark, sf_dir, "documents").select(
        F.col("source").alias("dir"), F.col("doc_id").cast("string").alias("file_name"), "text")
    books.write_corpus(named, path)
    # The place of a line in the joined files shows their order.
    placed = lines.positioned_lines(spark, path).select("file", "block", "pos", "value")
    return index.with_row_index(placed, ["file", "block", "pos"], "line").select(
        "line", F.col("value").alias("text"))


def read_lines(spark, sf_dir):
    rows = lines.read_lines(spark, written_tree(spark, sf_dir), keep_linebreaks=False)
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def read_any(spark, sf_dir):
    rows = lines.as_text(lines.read_any(spark, [f"{sf_dir}/documents.parquet"]))
    return rows.select(F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


def read_dialogues(spark, sf_dir):
    path = new_path(spark, "dialogues")
    dialogues(spark, sf_dir).select(F.to_json("utterances").alias("value")).write.text(path)
    return dialogue.render_chat(json_records.read_dialogues(spark, path, "lines").select("utterances"))


def write_arrays(spark, values: DataFrame, label: str) -> str:
    """Folders of files that are one JSON array each, of up to ``ARRAY_ROWS`` of the ids, by id."""
    path = new_path(spark, label)
    grouped = values.groupBy(F.floor(F.col("conv_id") / ARRAY_ROWS).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("conv_id", "value"))).alias("all"))
    grouped.select("part", F.to_json("all.value", {"ignoreNullFields": "false"}).alias("value")).write.partitionBy("part").text(path)
    return path


def read_dialogues_array(spark, sf_dir):
    """Files that are one array of conversations each, numbered inside their file."""
    path = write_arrays(spark, dialogues(spark, sf_dir).select("conv_id", F.col("utterances").alias("value")),
                        "dialogue-arrays")
    rows = json_records.read_dialogues(spark, path, "array")
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint").alias("part")
    chat = dialogue.render_chat(rows.select(part, "conv_id", "utterances"))
    return chat.select("part", F.col("conv_id").cast("bigint").alias("conv_id"), "text")


def read_framed_json(spark, sf_dir):
    path = new_path(spark, "framed")
    fields = [F.concat(F.lit(f'  "{k}": '), F.expr(f"substring(to_json(array({k})), 2, length(to_json(array({k}))) - 2)"))
              for k in json_records.MATHS_KEYS]
    body = F.concat(F.lit("{\n"), F.concat_ws(",\n", *fields), F.lit("\n}"))
    # Every tenth order loses its closing quote and must come back as corrupt.
    broken = F.when(F.col("o_orderkey") % 10 == 0, F.regexp_replace(body, '"\n}$', "\n}")).otherwise(body)
    maths(spark, sf_dir).select(broken.alias("value")).write.text(path)
    return json_records.read_framed_json(spark, path).select(
        *json_records.MATHS_KEYS, F.col("_corrupt").isNotNull().cast("bigint").alias("corrupt"))


def list_json(spark, sf_dir):
    path = new_path(spark, "instructions")
    sinks.write_instruction_json(
        dialogue.dialogue_to_instruction(dialogues(spark, sf_dir)), path)
    records = json_records.list_json(spark, path, json_records.instruction_schema(True), "lines")
    return records.withColumn("output", python_list_text("output"))


def list_json_array(spark, sf_dir):
    """The same records in files that are one array each."""
    records = dialogue.dialogue_to_instruction(dialogues(spark, sf_dir))
    fields = F.struct("instruction", "input", "output").alias("value")
    path = write_arrays(spark, records.select("conv_id", fields), "instruction-arrays")
    read = json_records.list_json(spark, path, json_records.instruction_schema(True), glob=None)
    return read.withColumn("output", python_list_text("output"))


def instruction_array_file(spark, sf_dir):
    """The same records as one file that is one array."""
    folder = new_path(spark, "instruction-file")
    records = dialogue.dialogue_to_instruction(dialogues(spark, sf_dir))
    sinks.write_instruction_array(records, f"{folder}/records.json", ["conv_id"])
    read = json_records.list_json(spark, folder, json_records.instruction_schema(True), glob=None)
    return read.withColumn("output", python_list_text("output"))


def corpus_file(spark, sf_dir):
    """The joined corpus as one file: the line numbers come from places in it."""
    folder = new_path(spark, "corpus-file")
    named = table(spark, sf_dir, "documents").select(
        F.col("source").alias("dir"), F.col("doc_id").cast("string").alias("file_name"), "text")
    books.write_corpus(named, folder, single_file=True)
    placed = lines.positioned_lines(spark, folder).select("file", "block", "pos", "value")
    return index.with_row_index(placed, ["file", "block", "pos"], "line").select(
        "line", F.col("value").alias("text"))


def text_csv(spark, sf_dir):
    path = new_path(spark, "chat-csv")
    sinks.write_text_csv(render_chat(spark, sf_dir), path)
    return sinks.read_text_csv(spark, path)


def load_or_build(spark, sf_dir):
    source = f"{sf_dir}/documents.parquet"
    inputs = {"files": cache.input_fingerprint(spark, [source]), "seed": 42}
    folder = new_path(spark, "sets")

    def build() -> DataFrame:
        return sampling.split_train_test(table(spark, sf_dir, "documents"), "doc_id")

    cache.load_or_build(spark, folder, inputs, build, ["split"])
    found = cache.load_or_build(spark, folder, inputs, build, ["split"])
    return found.select("doc_id", F.col("split").cast("string").alias("split"))


# Samples, splits, numbering

def split_train_test(spark, sf_dir):
    return sampling.split_train_test(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "split")


def split_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.split_train_test(docs, "doc_id", exact=True).select("doc_id", "split")


def shuffle_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    path = new_path(spark, "shuffled")
    sampling.shuffle_rows(orders, "o_orderkey").write.parquet(path)
    # The place of a row in the written files shows their order.
    rows = spark.read.parquet(path).select("*", "_metadata.file_name", "_metadata.row_index")
    return index.with_row_index(rows, ["file_name", "row_index"]).drop("file_name", "row_index")


def assign_shards(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.assign_shards(orders, "o_orderkey").select(
        "o_orderkey", F.col("shard").cast("bigint").alias("shard"))


def assign_shards_even(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.assign_shards(docs, "doc_id", n=7, even=True).select(
        "doc_id", "idx", F.col("shard").cast("bigint").alias("shard"))


def assign_batches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sampling.assign_batches(orders, 64, ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "idx", "batch_id")


def row_index(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return index.with_row_index(lineitem, ["l_shipdate", "l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "idx")


def sample_count(spark, sf_dir):
    return sampling.sample_count(table(spark, sf_dir, "documents"), 500)


# Vocabulary

def word_counts(spark, sf_dir):
    return vocab.word_counts(documents(spark, sf_dir))


def alphabet(spark, sf_dir):
    chars = vocab.alphabet(vocab.word_counts(documents(spark, sf_dir)))
    return chars.select("ch", "n", F.col("kept").cast("bigint").alias("kept"))


def pair_counts(spark, sf_dir):
    counts, _ = write_table(vocab.word_counts(documents(spark, sf_dir)), "words")
    return count_pairs(symbol_words(counts, usable_characters(vocab.alphabet(counts))[1]))


def _scored(learnt: DataFrame) -> DataFrame:
    return learnt.select(
        F.col("id").cast("bigint").alias("id"), "piece", F.col("score").cast("bigint").alias("score"))


def train_bpe(spark, sf_dir):
    """The default size, 32,000 pieces, or as many as the words give, with scores."""
    return _scored(learn(documents(spark, sf_dir)))


def train_bpe_first_merges(spark, sf_dir):
    return _scored(learn(documents(spark, sf_dir), n_merged=FIRST_MERGES))


def train_bpe_default(spark, sf_dir):
    """The default size, 32,000 pieces, or as many as the words give."""
    return learn(documents(spark, sf_dir)).select("id", "piece")


def train_bpe_to_end(spark, sf_dir):
    """The default size again, from texts so few that SQL can follow it to its end."""
    return learn(table(spark, sf_dir, "benchmark")).select(F.col("id").cast("bigint").alias("id"), "piece")


def word_vocabs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    base = vocab.word_counts(table(spark, sf_dir, "benchmark"))
    new = vocab.word_counts(documents(spark, sf_dir))
    return tuple(vocab.word_vocab(write_table(c, "words")[0]) for c in (base, new))


def merge_vocab(spark, sf_dir):
    return vocab.merge_vocab(*word_vocabs(spark, sf_dir)).select(
        F.col("id").cast("bigint").alias("id"), "piece", "origin",
        F.col("score").cast("bigint").alias("score"))


def vocab_head(spark, sf_dir):
    return vocab.vocab_head(word_vocabs(spark, sf_dir)[1]).select(
        F.col("id").cast("bigint").alias("id"), "piece")


def merged_trained(spark, sf_dir, n_merged: int | None = None) -> DataFrame:
    return vocab.merge_vocab(trained(spark, sf_dir, "benchmark"), trained(spark, sf_dir, "documents", n_merged))


def vocab_report(spark, sf_dir):
    return vocab.vocab_report(merged_trained(spark, sf_dir))


def vocab_report_first_merges(spark, sf_dir):
    return vocab.vocab_report(merged_trained(spark, sf_dir, FIRST_MERGES))


def vocab_growth(spark, sf_dir):
    return vocab.vocab_growth(vocab.merge_vocab(*word_vocabs(spark, sf_dir)), 1_000)


def concat_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return sets.concat_sets(docs, items).select(
        F.col("source_no").cast("bigint").alias("source_no"), "id", "text")


# Encoding and packing

def encoded(spark, sf_dir, **options) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return encode.encode(docs, trained(spark, sf_dir, "benchmark"), **options)


def encode_query(spark, sf_dir):
    return encoded(spark, sf_dir).select("doc_id", joined("input_ids"))


def encode_pieces(spark, sf_dir):
    ids = encoded(spark, sf_dir, add_bos=False)
    pieces = encode.tokenize(ids, trained(spark, sf_dir, "benchmark"))
    return pieces.select("doc_id", F.array_join("pieces", " ").alias("pieces"))


def encode_truncated(spark, sf_dir):
    ids = encoded(spark, sf_dir, max_length=128, add_eos=True)
    return ids.select("doc_id", joined("input_ids"))


def encode_wrapped(spark, sf_dir):
    ids = encoded(spark, sf_dir, text=wrap_document("text"), add_eos=True)
    masked = encode.with_attention_mask(ids)
    return masked.select("doc_id", joined("input_ids"), joined("attention_mask"))


def decode(spark, sf_dir):
    ids = encoded(spark, sf_dir, add_bos=False).select("doc_id", "input_ids")
    return encode.decode_ids(ids, trained(spark, sf_dir, "benchmark")).select("doc_id", "text")


def round_trip(spark, sf_dir):
    """Texts with all their line breaks and spaces, encoded and decoded."""
    pieces = encode.with_byte_pieces(trained(spark, sf_dir, "benchmark"))
    ids = encode.encode(documents(spark, sf_dir).select("doc_id", "text"), pieces, add_bos=False,
                        parse_literals=False, keep_spaces=True)
    return encode.decode_ids(ids.select("doc_id", "input_ids"), pieces).select("doc_id", "text")


def peek_first(spark, sf_dir):
    return encode.peek(table(spark, sf_dir, "documents"), trained(spark, sf_dir, "benchmark"), "doc_id")


def compare_vocabs(spark, sf_dir, n_merged: int | None = None):
    return encode.compare_vocabs(documents(spark, sf_dir), {
        "base": trained(spark, sf_dir, "benchmark"),
        "new": trained(spark, sf_dir, "documents", n_merged),
    })


def compare_vocabs_first_merges(spark, sf_dir):
    return compare_vocabs(spark, sf_dir, FIRST_MERGES)


def compare_vocabs_merged(spark, sf_dir):
    return encode.compare_vocabs(documents(spark, sf_dir), {
        "base": trained(spark, sf_dir, "benchmark"),
        "merged": merged_trained(spark, sf_dir),
        "new": trained(spark, sf_dir, "documents"),
    })


def pack_words(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", words("text").alias("input_ids"))
    blocks = pack.pack_blocks(docs, WORD_BLOCK, ["doc_id"], WORD_ROWS)
    return blocks.select("batch_id", "block_id", F.array_join("input_ids", " ").alias("tokens"))


def pack_tokens(spark, sf_dir):
    blocks = pretraining.training_blocks(
        documents(spark, sf_dir).select("doc_id", "text"), trained(spark, sf_dir, "benchmark"),
        ["doc_id"], block_size=PACK_BLOCK, batch_rows=PACK_ROWS)
    return blocks.select("batch_id", "block_id", joined("input_ids"), joined("labels"))


def split_blocks(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", words("text").alias("input_ids"))
    blocks = pack.pack_blocks(docs, WORD_BLOCK, ["doc_id"], WORD_ROWS)
    return pretraining.split_blocks(blocks).select("batch_id", "block_id", "split")


# Supervised rows

def examples(spark, sf_dir, max_len=None) -> DataFrame:
    records = dialogue.dialogue_to_instruction(dialogues(spark, sf_dir))
    return tuning.supervised_examples(records, trained(spark, sf_dir, "benchmark"), max_len)


def mask_labels(spark, sf_dir):
    return examples(spark, sf_dir).select("conv_id", joined("input_ids"), joined("labels"))


def mask_labels_truncated(spark, sf_dir):
    """As tuned: whole records, cut at the longest length."""
    return examples(spark, sf_dir, TUNE_LENGTH).select("conv_id", joined("input_ids"), joined("labels"))


def pad_batches(spark, sf_dir):
    padded = tuning.padded_batches(examples(spark, sf_dir), TUNE_ROWS, ["conv_id"])
    mask = F.array_join(F.transform("attention_mask", lambda m: F.when(m, "T").otherwise("F")), "")
    return padded.select("conv_id", "batch_id", joined("input_ids"), joined("labels"),
                         mask.alias("attention_mask"))


# Statistics

def corpus_stats(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return stats.corpus_stats(docs, ["source"], stages={
        "raw": F.col("text"), "clean": split_semicolons(clean_text("text"))})


def set_sizes(spark, sf_dir):
    return sets.set_sizes(sampling.split_train_test(table(spark, sf_dir, "documents"), "doc_id"))


def perplexity(spark, sf_dir):
    losses = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 10).alias("loss"))
    return stats.perplexity(losses, by=["event_type"]).select(
        "event_type", F.round("eval_loss", 6).alias("eval_loss"),
        F.round(F.log("perplexity"), 6).alias("log_perplexity"))


def unigram_perplexity(spark, sf_dir):
    losses = stats.unigram_loss(documents(spark, sf_dir))
    return losses.select("source", "n_words", F.round("eval_loss", 6).alias("eval_loss"),
                         F.round(F.exp("eval_loss"), 4).alias("perplexity"))


def planned_steps(spark, sf_dir):
    return stats.planned_steps(table(spark, sf_dir, "documents"), 3, 8, fixed.REPLICAS)


def metrics(spark, sf_dir):
    docs = sampling.split_train_test(table(spark, sf_dir, "documents"), "doc_id")
    path = new_path(spark, "metrics")
    sinks.write_metrics(stats.metrics_row(
        train_samples=sampling.sample_count(docs.where("split = 'train'")),
        eval_samples=sampling.sample_count(docs.where("split = 'test'"))), path)
    return spark.read.schema("train_samples DOUBLE, eval_samples DOUBLE").json(path).select(
        F.col("train_samples").cast("bigint").alias("train_samples"),
        F.col("eval_samples").cast("bigint").alias("eval_samples"))


def map_batches(spark, sf_dir):
    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "first_doc": [int(rows.doc_id.iloc[0])], "n_docs": [len(rows)],
            "n_chars": [int(rows.n_chars.sum())]})

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return batch.map_batches(docs, summary, "first_doc bigint, n_docs bigint, n_chars bigint",
                             batch_rows=64, order_by=["doc_id"])


def collate_batches(spark, sf_dir):
    def longest(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch_id": [int(rows.batch_id.iloc[0])],
                             "n_rows": [len(rows)], "longest": [int(rows.n_chars.max())]})

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    batched = sampling.assign_batches(docs, 32, ["doc_id"])
    return batch.collate_batches(batched, longest, "batch_id bigint, n_rows bigint, longest bigint")


QUERIES = {
    "clean_text": clean_text_query,
    "clean_custom_patterns": clean_custom,
    "clean_extra_patterns": clean_extra,
    "split_semicolons": semicolons,
    "wrap_document": wrap,
    "render_chat": render_chat,
    "dialogue_to_instruction": dialogue_to_instruction,
    "math_to_instruction": math_to_instruction,
    "math_to_chat": math_to_chat,
    "build_prompt": build_prompt,
    "build_prompt_join": build_prompt_join,
    "scan_books": scan_books,
    "scan_books_paths": scan_books_paths,
    "read_lines": read_lines,
    "read_any": read_any,
    "read_dialogues": read_dialogues,
    "read_dialogues_array": read_dialogues_array,
    "read_framed_json": read_framed_json,
    "list_json": list_json,
    "list_json_array": list_json_array,
    "instruction_array_file": instruction_array_file,
    "load_or_build": load_or_build,
    "write_books": write_books,
    "write_books_files": write_books_files,
    "concat_corpus": concat_corpus,
    "corpus_file": corpus_file,
    "text_csv": text_csv,
    "metrics": metrics,
    "sample_one_per_dir": sample_one_per_dir,
    "number_files": number_files,
    "rename_by_regex": rename_by_regex,
    "split_train_test": split_train_test,
    "split_train_test_exact": split_exact,
    "shuffle_rows": shuffle_rows,
    "assign_shards": assign_shards,
    "assign_shards_even": assign_shards_even,
    "assign_batches": assign_batches,
    "row_index": row_index,
    "sample_count": sample_count,
    "round_trip": round_trip,
    "peek_first": peek_first,
    "word_counts": word_counts,
    "alphabet": alphabet,
    "pair_counts": pair_counts,
    "train_bpe": train_bpe,
    "train_bpe_first_merges": train_bpe_first_merges,
    "train_bpe_default": train_bpe_default,
    "train_bpe_to_end": train_bpe_to_end,
    "merge_vocab": merge_vocab,
    "vocab_head": vocab_head,
    "vocab_report": vocab_report,
    "vocab_report_first_merges": vocab_report_first_merges,
    "vocab_growth": vocab_growth,
    "concat_sets": concat_sets,
    "encode": encode_query,
    "encode_pieces": encode_pieces,
    "encode_truncated": encode_truncated,
    "encode_wrapped": encode_wrapped,
    "decode": decode,
    "compare_vocabs": compare_vocabs,
    "compare_vocabs_first_merges": compare_vocabs_first_merges,
    "compare_vocabs_merged": compare_vocabs_merged,
    "pack_words": pack_words,
    "pack_tokens": pack_tokens,
    "split_blocks": split_blocks,
    "mask_labels": mask_labels,
    "mask_labels_truncated": mask_labels_truncated,
    "pad_batches": pad_batches,
    "corpus_stats": corpus_stats,
    "set_sizes": set_sizes,
    "perplexity": perplexity,
    "unigram_perplexity": unigram_perplexity,
    "planned_steps": planned_steps,
    "map_batches": map_batches,
    "collate_batches": collate_batches,
}

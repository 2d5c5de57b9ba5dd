import json
import os

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.text import clean_text, wrap_document
from lexiloom.operators import dialogue, encode, stats
from lexiloom.operators.vocab import VOCAB_SCHEMA
from lexiloom.plans import vocabulary
from lexiloom.sources import books, cache, json_records, lines, sinks
from lexiloom.storage import drop_table, scratch_dir, write_table
from lexiloom.streaming import rows as streaming


def put(root, files):
    for name, content in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())
    return str(root)


def test_scan_and_decode(spark, tmp_path):
    root = put(tmp_path, {
        "a/1.txt": "中文；abc\r\n行".encode("gb18030"), "a/b/2.txt": "plain\rx", "3.txt": b"ok\xff\xff.",
        "a/skip.md": "no", "a/UP.TXT": "no", "bom.txt": b"\xef\xbb\xbfhi",
        "wide.txt": "wide é".encode("utf-16"),
    })
    got = {r.rel_path: r for r in books.decode_books(books.scan_books(spark, root)).collect()}
    assert {k: r.text for k, r in got.items()} == {
        "a/1.txt": "中文；abc\n行", "a/b/2.txt": "plain\nx", "3.txt": "ok.", "bom.txt": "hi",
        "wide.txt": "wide é"}
    assert got["a/1.txt"].encoding == "gb18030" and got["wide.txt"].encoding == "utf-16"
    assert (got["a/b/2.txt"].dir, got["a/b/2.txt"].file_name) == ("a/b", "2.txt")
    assert got["3.txt"].dir == ""
    odd = put(tmp_path / "odd", {"x y+z%20é/e.txt": "", "x y+z%20é/f.txt": "f"})
    assert {(r.rel_path, bytes(r.content)) for r in books.scan_books(spark, odd).collect()} == {
        ("x y+z%20é/e.txt", b""), ("x y+z%20é/f.txt", b"f")}
    assert books.scan_books(spark, odd, keep_empty=False).count() == 1
    skipped = {r.rel_path for r in books.unreadable(books.scan_books(spark, root)).collect()
               if not r.rel_path.startswith("odd")}
    assert skipped == {"a/1.txt", "3.txt", "wide.txt"}
    assert books.readable(books.scan_books(spark, root)).count() == 4


def test_clean_books_and_one_per_directory(spark, tmp_path):
    root = put(tmp_path, {"a/1.txt": "Aa-；B", "a/2.txt": "X", "b/1.md": "no", "c/1.txt": "Z"})
    every = {r.rel_path: r.text for r in vocabulary.clean_books(spark, root).collect()}
    assert every == {"a/1.txt": "A\nB", "a/2.txt": "X", "c/1.txt": "Z"}
    some = {r.dir for r in vocabulary.clean_books(spark, root, one_per_dir=True).collect()}
    assert some == {"a", "c"}


def test_joined_corpus(spark, tmp_path):
    root = put(tmp_path / "in", {"z.txt": "top", "a/1.txt": "one", "a/b/2.txt": "two", "a/0.txt": ""})
    scanned = books.readable(books.scan_books(spark, root))
    assert [r.text for r in books.concat_corpus(scanned).collect()] == ["two\n", "\n", "one\n", "top\n"]
    books.write_corpus(scanned, str(tmp_path / "out"), single_file=True)
    parts = [p for p in os.listdir(tmp_path / "out") if p.endswith(".txt")]
    assert len(parts) == 1 and (tmp_path / "out" / parts[0]).read_text() == "two\n\none\ntop\n"
    books.write_books(scanned, str(tmp_path / "p"))
    assert {r.rel_path for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {
        "z.txt", "a/1.txt", "a/b/2.txt", "a/0.txt"}
    books.write_books(scanned, str(tmp_path / "t"), by_dir=True)
    assert os.path.isdir(tmp_path / "t" / "dir=a")


@pytest.mark.parametrize("content", [
    "a\nb\n", "a\nb", "", "\n", "a\n\nb", "a\r\nb\rc\n", "a\r", "x\r\r\ny", "é中\n𠀀",
])
def test_lines_keep_their_breaks(spark, tmp_path, content):
    root = put(tmp_path, {"f.txt": content})
    want = content.replace("\r\n", "\n").replace("\r", "\n").splitlines(keepends=True)
    got = [r.text for r in lines.read_lines(spark, root).collect()]
    assert sorted(got) == sorted(want)
    bare = [r.text for r in lines.read_lines(spark, root, keep_linebreaks=False).collect()]
    assert sorted(bare) == sorted(w.rstrip("\n") for w in want)


def test_lines_of_several_splits(spark, tmp_path):
    body = "\n".join(f"line {i} " + "x" * 50 for i in range(4_000))
    root = put(tmp_path, {"a.txt": body, "b.txt": body + "\n"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [r.text for r in lines.read_lines(spark, root).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(body.splitlines(True) + (body + "\n").splitlines(True))


def test_dispatch_on_extension(spark, tmp_path):
    root = put(tmp_path, {"a.txt": "l1\nl2\n", "b.json": '{"other": 1, "text": "t"}\n', "c.csv": "first,second\nx,y\n"})
    assert lines.read_any(spark, [f"{root}/a.txt"]).count() == 2
    assert lines.text_column(lines.read_any(spark, [f"{root}/b.json"])) == "text"
    table = lines.read_any(spark, [f"{root}/c.csv"])
    assert lines.text_column(table) == "first" and lines.as_text(table).first().text == "x"
    with pytest.raises(ValueError):
        lines.read_any(spark, [f"{root}/a.txt", f"{root}/b.json"])


def test_dialogues(spark, tmp_path):
    data = [["火锅", "哈哈", "不会"], [], ["x"]]
    root = put(tmp_path, {"d.json": json.dumps(data, ensure_ascii=False, indent=1)})
    got = json_records.read_dialogues(spark, f"{root}/d.json").orderBy("conv_id").collect()
    assert [r.utterances for r in got] == data
    rows = dialogue.dialogue_to_instruction(
        json_records.read_dialogues(spark, f"{root}/d.json").drop("file")).orderBy("conv_id").collect()
    assert [(r.input, r.output) for r in rows] == [("火锅", ["哈哈", "不会"]), ("x", [])]
    flat = put(tmp_path / "l", {"d.json": "\n".join(json.dumps(d) for d in data)})
    assert json_records.read_dialogues(spark, flat, "lines").count() == 3


FRAMED = '''junk }
{
 "original_text": "good", "equation": "x=1",
 "ans": "1"
}
{
 "original_text": "brace {3}", "equation": "x=3", "ans": "3"
}
{
 "original_text": "broken", "equation": x,
}
  {"original_text": "line", "equation": "x=2", "ans": "2", "id": 7}
{"original_text": "number", "equation": "x=2", "ans": 3}
{"original_text": "missing", "equation": "x=2"}
{"original_text": "comma", "equation": "x=2", "ans": "4"},
{"original_text": "twice", "equation": "x", "ans": "4"}{"a": 1}
{"original_text": "tail", "equation": "x", "ans": "5"} tail }
{"original_text": "deep", "equation": "x=5",
 "more": {"a": 1
 },
 "ans": "6"
}
'''


def reference_frames(text):
    good, bad, buffer = [], 0, ""
    for line in text.splitlines(keepends=True):
        if line.strip().startswith("{"):
            buffer = ""
        buffer += line
        if line.strip().endswith("}"):
            try:
                item = json.loads(buffer)
                fields = [item["original_text"], item["equation"], item["ans"]]
                if not all(isinstance(f, str) for f in fields):
                    raise KeyError
                good.append(tuple(fields))
            except (json.JSONDecodeError, KeyError):
                bad += 1
    return sorted(good), bad


@pytest.mark.parametrize("split_bytes", [None, "64"])
def test_framed_json(spark, tmp_path, split_bytes):
    root = put(tmp_path, {"m.json": FRAMED})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        rows = json_records.read_framed_json(spark, f"{root}/m.json").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    good = sorted((r.original_text, r.equation, r.ans) for r in rows if r._corrupt is None)
    assert (good, sum(r._corrupt is not None for r in rows)) == reference_frames(FRAMED)


def test_instruction_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("指令", None, ["a", "b"]), ("i", "q", [])],
                               "instruction string, input string, output array<string>")
    sinks.write_instruction_json(df, str(tmp_path / "out"))
    back = json_records.list_json(spark, str(tmp_path / "out"), json_records.instruction_schema(True), "lines")
    assert sorted(back.collect()) == sorted(df.collect())
    raw = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "指令" in raw
    array = put(tmp_path / "arr", {"x.json": json.dumps([{"instruction": "i", "input": "", "output": "o"}]),
                                   "deeper/y.json": "[]", "z.txt": "no"})
    got = json_records.list_json(spark, array, json_records.instruction_schema(False)).collect()
    assert [(r.instruction, r.input, r.output) for r in got] == [("i", "", "o")]


def test_chat_csv_round_trip(spark, tmp_path):
    texts = ["a\nb", 'say "x", y', "", "plain", "back\\slash", '"', ",", "中文\r\nx"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sinks.write_text_csv(df.coalesce(1), str(tmp_path / "c"))
    back = [r.text for r in sinks.read_text_csv(spark, str(tmp_path / "c")).collect()]
    assert sorted(back) == sorted(t.replace("\r\n", "\r\n") for t in texts)


def test_prepared_sets_are_found_by_their_inputs(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(10).withColumn("split", F.when(F.col("id") < 2, "test").otherwise("train"))

    where = str(tmp_path)
    for block in (4, 4, 8):
        assert cache.load_or_build(spark, where, {"block": block}, build, ["split"]).count() == 10
    assert len(built) == 2
    # A folder without its success mark is built again.
    folder = [p for p in tmp_path.iterdir() if p.is_dir()][0]
    (folder / "_SUCCESS").rename(folder / "gone")
    for block in (4, 8):
        cache.load_or_build(spark, where, {"block": block}, build, ["split"])
    assert len(built) == 3
    data = put(tmp_path / "data", {"a.txt": "1"})
    first = cache.input_fingerprint(spark, [data])
    assert first == cache.input_fingerprint(spark, [data])
    put(tmp_path / "data", {"b.txt": "2"})
    assert first != cache.input_fingerprint(spark, [data])


def test_metrics(spark, tmp_path):
    row = stats.metrics_row(train_samples=spark.range(5).agg(F.count("*")),
                            eval_loss=spark.range(1).select(F.lit(0.5)))
    sinks.write_metrics(row, str(tmp_path / "m"))
    got = spark.read.json(str(tmp_path / "m")).first()
    assert (got.train_samples, got.eval_loss) == (5, 0.5)


def test_intermediate_tables(spark):
    table, path = write_table(spark.range(3), "t")
    assert table.count() == 3 and path.startswith(scratch_dir(spark))
    drop_table(spark, path)
    with pytest.raises(ValueError):
        drop_table(spark, "/tmp/elsewhere")


def test_row_operators_take_a_stream(spark, tmp_path):
    schema = "id long, utterances array<string>, text string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, ["a", "b"], "xY")], schema).write.parquet(source)

    vocab = spark.createDataFrame(
        [(i, p, 0.0, "x") for i, p in enumerate(["<unk>", "<s>", "</s>", "▁", "Y", "Z"])], VOCAB_SCHEMA)

    def operator(df):
        chat = dialogue.chat_text("utterances")
        rows = df.select("id", wrap_document(clean_text("text")).alias("text"), chat.alias("chat"))
        return encode.encode(rows, vocab)

    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for _ in range(2):
        streaming.run_available(streaming.open_files(spark, source, schema), operator, out, progress)
    spark.createDataFrame([(2, ["c"], "Z")], schema).write.mode("append").parquet(source)
    streaming.run_available(streaming.open_files(spark, source, schema), operator, out, progress)
    got = {r.id: (r.text, r.chat, r.input_ids) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("<s>Y</s>", "<s>Human: a\n</s><s>Assistant: b\n</s>", [1, 1, 3, 4, 2]),
                   2: ("<s>Z</s>", "<s>Human: c\n</s>", [1, 1, 3, 5, 2])}


def test_conversations_are_numbered_by_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text('["x"]\n\n["y", "z"]\n')
    rows = json_records.read_dialogues(spark, str(tmp_path), "lines").collect()
    assert sorted((r.file[-7:], r.conv_id, r.utterances) for r in rows) == [
        ("a.jsonl", 0, ["x"]), ("a.jsonl", 1, ["y", "z"]), ("b.jsonl", 0, ["x"]), ("b.jsonl", 1, ["y", "z"])]


def test_a_set_that_cannot_be_read_is_not_overwritten(spark, tmp_path):
    where, made = str(tmp_path / "sets"), []

    def build():
        made.append(1)
        return spark.range(3)

    cache.load_or_build(spark, where, {"a": 1}, build)
    folder = next((tmp_path / "sets").iterdir())
    for part in folder.glob("*.parquet"):
        part.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        cache.load_or_build(spark, where, {"a": 1}, build).collect()
    assert made == [1]
    (folder / "_SUCCESS").unlink()
    assert cache.load_or_build(spark, where, {"a": 1}, build).count() == 3 and made == [1, 1]

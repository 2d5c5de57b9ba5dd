"""Trees listed, read and written by tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexiloom.sources import books, sinks, tree


def put(root, names):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as file:
            file.write(name)
    return str(root)


def files(root):
    return {os.path.relpath(os.path.join(at, n), root): open(os.path.join(at, n), "rb").read()
            for at, _, names in os.walk(root) for n in names}


@pytest.mark.parametrize("opened, wide, shares", [(256, 1024, 64), (1, 1024, 64), (3, 2, 4), (0, 1, 1)])
def test_every_share_of_a_tree(tmp_path, monkeypatch, opened, wide, shares):
    """However a tree is dealt, each file is listed once."""
    monkeypatch.setattr(tree, "OPENED", opened)
    monkeypatch.setattr(tree, "WIDE", wide)
    monkeypatch.setattr(tree, "SHARES", shares)
    names = [f"{a}/{b}/{c}.txt" for a in "abcde" for b in ("x", "y y") for c in range(3)]
    names += ["top.txt", "a/.hidden.txt", "_u/v.txt", "a/é%20+.txt", "a/b.md"]
    reader = tree.TreeReader(put(tmp_path, names), ".txt")
    os.makedirs(tmp_path / "empty" / "below")
    found = [(n, size) for part in reader.partitions() for batch in reader.read(part)
             for n, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    assert sorted(found) == sorted((n, len(n.encode())) for n in names if n.endswith(".txt"))


def test_scan_lists_in_tasks(spark, tmp_path):
    root = put(tmp_path, [f"d{i % 40}/{i}.txt" for i in range(300)])
    open(f"{root}/none.txt", "w").close()
    scanned = books.scan_books(spark, root)
    assert {r.rel_path: bytes(r.content) for r in scanned.collect()} == files(root)
    assert {r.path for r in scanned.collect()} == {f"file:{root}/{n}" for n in files(root)}
    assert tree.list_tree(spark, root, ".txt").rdd.getNumPartitions() == 41
    assert scanned.rdd.getNumPartitions() > 1  # small names, yet not all in one task
    assert not scanned.inputFiles()
    assert tree.list_tree(spark, put(tmp_path / "bare", ["x.md"]), ".txt").count() == 0
    with pytest.raises(Exception, match="No such file"):
        tree.list_tree(spark, f"{root}/missing").count()


def test_written_trees(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(f"a{i % 7}/b/{i}.txt", "" if i == 5 else None if i == 6 else f"text {i}\r\né") for i in range(200)]
    df = spark.createDataFrame(rows, "rel_path string, text string").withColumn("more", F.lit(1))
    books.write_books(df, root, as_files=True)
    want = {p: (t or "").encode() for p, t in rows}
    assert files(root) == want
    # Nothing of a write that fails is left, wherever it fails.
    for bad in ([("new.txt", "x"), ("new.txt", "y")], [("new.txt", "x"), ("../out.txt", "y")],
                [("new.txt", "x"), (None, "y")], [("new.txt", "x"), ("/tmp/out.txt", "y")],
                [("new.txt", "x"), ("a1/b/1.txt", "there")], [("new.txt", "x"), ("a1/b", "a folder")]):
        with pytest.raises(Exception):
            tree.write_tree(spark.createDataFrame(bad, "rel_path string, text string"), root)
        assert files(root) == want and not [n for n in os.listdir(root) if n.startswith(".")]
    assert not os.path.exists(tmp_path / "out.txt")
    tree.write_tree(spark.createDataFrame([("a1/b/1.txt", b"\xff")], "rel_path string, text binary"), root, overwrite=True)
    assert files(root) == want | {"a1/b/1.txt": b"\xff"}
    tree.write_tree(df.limit(0), str(tmp_path / "nothing"))
    assert not files(tmp_path / "nothing")


def test_attempts_that_failed(tmp_path):
    """Only what committed attempts wrote is moved."""
    import pyarrow as pa

    writer = tree.TreeWriter(str(tmp_path), False)
    batch = pa.RecordBatch.from_arrays([pa.array(["x/1.txt"]), pa.array([b"one"])], ["rel_path", "content"])

    def lost():
        yield batch
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    assert not (tmp_path / "x").exists()
    writer.commit([writer.write(iter([batch])), writer.write(iter([]))])
    assert files(tmp_path) == {"x/1.txt": b"one"}


@pytest.mark.parametrize("n", [0, 1, 3, 2000])
def test_one_file_from_many_tasks(spark, tmp_path, monkeypatch, n):
    """Parts of any size, empty ones too, meet at their seams."""
    monkeypatch.setattr(tree, "BATCH_BYTES", 7)
    rows = [(i, f"q{i} é", None if i % 3 else "", "b,\n]" * (i % 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, instruction string, input string, output string").repartition(7)
    path = str(tmp_path / "out" / "all.json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_instruction_array(df, path, ["id"])
        tree.write_one_file(df.orderBy("id").select("instruction"), str(tmp_path / "out" / "all.txt"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with open(path, encoding="utf-8") as file:
        assert [(r["instruction"], r["input"], r["output"]) for r in json.load(file)] == [r[1:] for r in rows]
    assert (tmp_path / "out" / "all.txt").read_text() == "".join(r[1] + "\n" for r in rows)
    assert sorted(os.listdir(tmp_path / "out")) == ["all.json", "all.txt"]
    with pytest.raises(FileExistsError):
        sinks.write_instruction_array(df, path, ["id"])

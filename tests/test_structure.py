"""Readers that find JSON borders in splits, against Python's parser on the whole file."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiloom.sources import json_records, structure
from test_sources import FRAMED, reference_frames

ODD = ["", "]", "[[", '"', '\\"]', "a,b", "{}", "}\n{", "\\", "文；𠀀", "] , [", "\t", '"]"']


@pytest.fixture(params=[None, "7", "64"])
def splits(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def write_arrays(folder, make, dump):
    rng, all_data = random.Random(5), {}
    for name, indent in (("a", None), ("b", 1), ("c", None)):
        data = [make(rng) for _ in range(0 if name == "c" else 9)]
        text = json.dumps(data, ensure_ascii=name == "b", indent=indent)
        (folder / f"{name}.json").write_text(text + ("\n" if dump and name != "a" else ""), "utf-8")
        all_data[f"{name}.json"] = data
    return all_data


def test_array_of_conversations(spark, tmp_path, splits):
    want = write_arrays(tmp_path, lambda r: [r.choice(ODD) for _ in range(r.randrange(4))], True)
    got = {}
    for r in json_records.read_dialogues(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.conv_id, r.utterances))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v)) for k, v in want.items() if v}


def test_array_of_records(spark, tmp_path, splits):
    def make(r):
        return {"instruction": r.choice(ODD), "input": r.choice(ODD), "output": [r.choice(ODD) for _ in range(r.randrange(3))],
                "more": {"deep": [{"x": r.choice(ODD)}]}}

    want = write_arrays(tmp_path, make, False)
    (tmp_path / "one.json").write_text(json.dumps({"instruction": "i", "input": "}", "output": ["o"], "x": {"y": 1}}, indent=2))
    (tmp_path / "other.txt").write_text("not read")
    rows = json_records.list_json(spark, str(tmp_path), json_records.instruction_schema(True)).collect()
    records = [r for data in want.values() for r in data]
    assert sorted((r.instruction, r.input, r.output) for r in rows) == sorted(
        [(r["instruction"], r["input"], r["output"]) for r in records] + [("i", "}", ["o"])])


def test_values_between_conversations(spark, tmp_path):
    (tmp_path / "d.json").write_text(' [null, ["a"], 3, "x]", {"k": [1]}, ["b", "c"], []\n, "end" ] \n')
    rows = json_records.read_dialogues(spark, str(tmp_path)).orderBy("conv_id").collect()
    assert [(r.conv_id, r.utterances) for r in rows] == [(0, ["a"]), (1, ["b", "c"]), (2, [])]


@pytest.mark.parametrize("text", ['[["a"], ["b"', '[["a"], ["b]]', '[["a"]]]', '[["a"'])
def test_a_file_that_is_not_whole_is_an_error(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(PySparkException):
        json_records.read_dialogues(spark, str(tmp_path)).collect()


def test_frames_of_random_lines(spark, tmp_path, splits):
    rng = random.Random(3)
    parts = FRAMED.splitlines(keepends=True) + ['{"original_text": "a\\"}", "equation": "\\\\", "ans": "{"}\n', "}\n", " }\n", "\n",
                                                '"open\n', '{"original_text": "a", "equation": [{\n', '}], "ans": "b"}\n']
    for name in range(2):
        (tmp_path / f"{name}.json").write_text("".join(rng.choice(parts) for _ in range(25)))
    want_good, want_bad = [], 0
    for name in range(2):
        good, bad = reference_frames((tmp_path / f"{name}.json").read_text())
        want_good, want_bad = want_good + good, want_bad + bad
    rows = json_records.read_framed_json(spark, str(tmp_path)).collect()
    assert sorted((r.original_text, r.equation, r.ans) for r in rows if r._corrupt is None) == sorted(want_good)
    assert sum(r._corrupt is not None for r in rows) == want_bad


def test_a_file_of_closes_stays_linear(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"original_text": "never closed,\n' + "x }\n" * 20_000)
    rows = json_records.read_framed_json(spark, str(tmp_path))
    n, size = rows.select(F.count("*"), F.sum(F.length("_corrupt"))).first()
    assert n == 20_000 and size < 100_000


def test_stretches_of_a_split(spark, tmp_path, monkeypatch):
    """A split of many rows is no unit of its own: strings and depth are carried from stretch to stretch."""
    monkeypatch.setattr(structure, "_STRETCH_BITS", 2)
    good = "".join(f'{{"original_text": "{i} }}\n{{",\n"ans": "{i}"}}\n' for i in range(20))
    (tmp_path / "a.json").write_text(good)
    lines = json_records.positioned_lines(spark, str(tmp_path))
    state = structure.with_structure(lines, F.col("value").rlike(r"^\{"), F.col("value"), F.col("value").rlike(r"\}$"))
    sizes = state.groupBy(*structure._SPLIT).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) <= 4
    arrays = tmp_path / "arrays"
    arrays.mkdir()
    want = write_arrays(arrays, lambda r: [r.choice(ODD) for _ in range(r.randrange(4))], True)
    got = {}
    for r in json_records.read_dialogues(spark, str(arrays)).collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.conv_id, r.utterances))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v)) for k, v in want.items() if v}
    frames = tmp_path / "frames"
    frames.mkdir()
    (frames / "f.json").write_text(FRAMED * 5)
    want_good, want_bad = reference_frames(FRAMED * 5)
    rows = json_records.read_framed_json(spark, str(frames)).collect()
    assert sorted((r.original_text, r.equation, r.ans) for r in rows if r._corrupt is None) == sorted(want_good)
    assert sum(r._corrupt is not None for r in rows) == want_bad

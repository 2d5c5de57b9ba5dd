"""Registered queries beside their SQL twins, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import queries
from check import TABLES, canonical
from lexiloom.llm import decontaminate, neardup, quality
from lexiloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        result = con.execute(ORACLES[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == canonical(result.fetchall(), columns)


def test_pipeline(spark, sf_dir):
    """Each stage keeps what it should of what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id for r in quality.score_quality(raw).where("quality.kept").collect()}
    assert set(kept["quality rules"]) == good
    cut = kept["line dedup"]
    assert all(r.n_chars == len(r.text) and r.text for r in cut.values())
    lines = [x for r in cut.values() for x in (" ".join(x.lower().split()) for x in r.text.split("\n"))
             if len(x.split()) >= 5]
    assert len(lines) == len(set(lines))
    near = kept["near dedup"]
    sets = {i: set(neardup.shingle_set(r.text, 5).tolist()) for i, r in near.items()}
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0
                   for a in sets for b in sets if a < b)
    items = [decontaminate.normalise(r.text)
             for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = kept["benchmark decontamination"]
    assert not any(t in decontaminate.normalise(r.text) for r in clean.values() for t in items)
    assert len(clean) > 0.9 * len(near)
    mixed = kept["source mix"]
    assert set(mixed) <= set(clean) and all(0 < r.taken <= 2 * r.size for r in mixed.values())
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id: r.taken for r in whole.collect()} == {i: r.taken for i, r in mixed.items()}


def test_stages_hold_few_texts(spark, sf_dir):
    """Stages whose frame the caller runs lower larger Arrow batches, and leave smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    try:
        for stage in (corpus_pipeline.quality_rules, corpus_pipeline.benchmark_decontamination):
            for given, held in (("10000", "1000"), ("0", "1000"), ("64", "64")):
                spark.conf.set(name, given)
                stage(spark, docs, sf_dir)
                assert spark.conf.get(name) == held
    finally:
        spark.conf.set(name, before)


def test_native_lines(spark, sf_dir, capsys):
    """No Python runs inside the plan of the native operator."""
    queries()["op3_deletion_neighbours"](spark, sf_dir).explain()
    assert "Python" not in capsys.readouterr().out and "Pandas" not in capsys.readouterr().out

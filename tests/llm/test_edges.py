"""Every operator on odd rows, on no rows, and with other columns under the names it gives."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import (
    content, decontaminate, language, lines, mixing, neardup, prefixjoin, quality, quotes, toxicity, urls)

SF = "/root/testdata/sf0.001"


def _benchmark(spark):
    return spark.createDataFrame([(1, "a text without an id that is long enough to count"), (None, None), (2, "")],
                                 "item_id bigint, text string")


def _toxic(spark):
    return spark.createDataFrame([(4, 1), (4, 1), (None, 1), (5, None), (6, 0)], "doc_id bigint, toxic int")


OPERATORS = {
    "quality": lambda s, d: quality.score_quality(d),
    "mix": lambda s, d: mixing.mix_sources(d),
    "language": lambda s, d: language.identify(d, language.train(d)),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, toxicity.train(d, _toxic(s))),
    "lines": lambda s, d: lines.drop_duplicate_lines(d, removed="n_removed"),
    "near": lambda s, d: neardup.near_duplicates(d),
    "grams": lambda s, d: prefixjoin.join_classes(d),
    "items": lambda s, d: decontaminate.find_items(d, _benchmark(s)),
    "content": lambda s, d: content.extract_content(d, "text"),
    "urls": lambda s, d: urls.judge_urls(d.withColumn("url", F.concat(F.lit("http://"), "source", F.lit("/"), "text")),
                                         [("allow", "a", "/")], d),
    "quotes": lambda s, d: quotes.link_quotes(d.withColumn("n_chars", F.col("n_chars") % 2), "source", "n_chars",
                                              "text", "lang"),
}
NEW = ["quality", "size", "source_size", "target", "taken", "language", "score", "n_removed", "n_shingles",
       "component_id", "kept", "matches", "content", "host", "path", "rule", "verdict", "reply_to", "_h", "h", "n",
       "id", "key", "_gone", "_text", "class", "place", "label"]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, odd_documents, name):
    out = OPERATORS[name](spark, odd_documents)
    assert len(set(c.lower() for c in out.columns)) == len(out.columns)
    assert len(out.collect()) == odd_documents.count()


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_rows(spark, no_documents, name):
    assert OPERATORS[name](spark, no_documents).collect() == []


@pytest.mark.parametrize("name", list(OPERATORS))
def test_clashing_names(spark, odd_documents, name):
    """Columns that carry an operator's own names change no result, and results replace them."""
    plain = OPERATORS[name](spark, odd_documents)
    clash = OPERATORS[name](spark, odd_documents.withColumns({c: F.lit("other") for c in NEW}))
    new = [c for c in plain.columns if c not in odd_documents.columns and c != "url"]
    got, want = (sorted(map(repr, df.select(*new).collect())) for df in (clash, plain))
    assert got == want


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stage_on_odd_and_no_rows(spark, odd_documents, no_documents, stage):
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, odd_documents.withColumn("extra", F.lit(1)), SF)
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == [*odd_documents.columns, "extra"]
    assert len(out.collect()) <= odd_documents.count()
    assert run(spark, no_documents, SF).collect() == []

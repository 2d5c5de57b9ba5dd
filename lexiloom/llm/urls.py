"""URL filters: rules first, then naive Bayes over words segmented out of hosts and paths.

Names such as ``dailynews`` are cut into words by a unigram Viterbi: word counts of a whole corpus give
the chances. The urls that a rule decides are the labelled examples of a multinomial naive Bayes, which
judges the others by their words. All scoring is per distinct host and path shape.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import write_table

ALLOW, BLOCK = "allow", "block"
#: Verdict, host, start of the path.
Rule = tuple[str, str, str]
#: Names of a host label are at most this long; longer runs of letters stay whole.
LONGEST_NAME = 63
#: Longest word that a name is cut into.
LONGEST_WORD = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = r"\p{L}+|\p{N}+"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both are empty for null and for urls without ``://``."""
    place = F.coalesce(F.locate("://", F.col(url)), F.lit(0))
    after = F.when(place > 0, F.substring(F.col(url), place + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)})


def rule_name(rule: Rule) -> str:
    return f"{rule[1]}{rule[2]}"


def matching_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct of the longest rule that fits and its verdict; null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules of equal
    length the first in code point order wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(rule_name(r)), [-ord(c) for c in rule_name(r)])):
        fits = ((host == rule[1]) | host.endswith(f".{rule[1]}")) & path.startswith(rule[2])
        out = F.when(fits, F.struct(F.lit(rule_name(rule)).alias("rule"), F.lit(rule[0]).alias("verdict"))
                     ).otherwise(out)
    return out


def word_counts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over whole texts, lower case; words too long to be part of a name are left out."""
    words = corpus.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return words.where((F.col("word") != "") & (F.length("word") <= LONGEST_WORD)).groupBy("word").agg(
        F.count("*").alias("n"))


def _cut(name: str, known: dict[str, int], total: int) -> list[str]:
    """Most likely words of a name. An unknown word costs more the longer it is."""
    best = [0.0] + [-math.inf] * len(name)
    came = [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            word = name[start:end]
            n = known.get(word)
            chance = math.log(n / total) if n else math.log(1 / (total + 1)) - 2.5 * len(word)
            if best[start] + chance > best[end]:
                best[end], came[end] = best[start] + chance, start
    out, end = [], len(name)
    while end:
        out.append(name[came[end]:end])
        end = came[end]
    return out[::-1]


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, words`` for every distinct name: a column ``name`` of letters in, Viterbi out.

    All parts of all names meet the word counts in a join, so no vocabulary is held in memory.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    names = names.where(F.length("name") > 0).distinct()
    spread = names.where(F.length("name") <= LONGEST_NAME).select("name", F.explode(
        F.sequence(F.lit(1), F.length("name"))).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("start") + 1))
    parts = spread.select("name", "start", F.explode(sizes).alias("size")).select(
        "name", F.substring("name", F.col("start"), F.col("size")).alias("word")).distinct()
    found = parts.join(counts, "word").groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for name, known in batches:
            yield pd.Series([[n] if len(n) > LONGEST_NAME else _cut(n, dict(k) if k is not None else {}, total)
                             for n, k in zip(name, known)], dtype=object)

    return names.join(found, "name", "left").select("name", cut.asNondeterministic()("name", "known").alias("words"))


def _tokens(shapes: DataFrame, counts: DataFrame) -> DataFrame:
    """``sid, label, n, token``: segmented words of hosts and paths, told apart by a prefix."""
    def found(part: str, column: str) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(column), F.lit(_TOKEN), F.lit(0)),
                           lambda x: F.struct(F.lit(part).alias("part"), x.alias("name")))

    # Only the id of a shape goes with its tokens: a long url has very many of them.
    flat = shapes.select("sid", "label", "n", F.explode(F.concat(
        found("host", "host"), found("path", "shape"))).alias("f")).select("sid", "label", "n", "f.part", "f.name")
    words = segment_names(flat.where(F.col("name").rlike(r"^\p{L}")).select("name"), counts)
    joined = flat.join(words, "name", "left").withColumn("words", F.coalesce("words", F.array("name")))
    return joined.select("sid", "label", "n", "part", F.explode("words").alias("word")).select(
        "sid", "label", "n", F.concat_ws(":", "part", "word").alias("token"))


def _weights(tokens: DataFrame) -> DataFrame:
    """``token, weight``: log odds of allow for each token, with one added to every count."""
    is_allow = F.col("label") == ALLOW
    counted = tokens.where("label is not null").groupBy("token").agg(
        F.sum(F.when(is_allow, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(is_allow, 0).otherwise(F.col("n"))).alias("b"))
    total = counted.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    a, b, size = (x or 0 for x in total)
    return counted.select("token", (F.log((F.col("a") + 1) / (a + size + 1)) -
                                    F.log((F.col("b") + 1) / (b + size + 1))).alias("weight"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], corpus: DataFrame, url: str = "url",
               text: str = "text") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score``; columns of these names are replaced.

    ``verdict`` is the rule's where one fits, else naive Bayes': ``allow`` if ``score``, the log odds of
    it, is not negative. Without examples of both kinds all other urls are allowed. Null urls and urls
    without ``://`` have no host, no path and no tokens, so the prior decides. Digits count by place, not
    by value. Repeated urls are judged once.
    """
    old = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "score")]
    parted = with_parts(pages, url)
    fit = matching_rule(rules, F.col("host"), F.col("path"))
    parts = parted.select(*[parted[c] for c in old], "host", "path", fit.getField("rule").alias("rule"),
                          fit.getField("verdict").alias("_label"))
    shape = F.regexp_replace("path", r"\p{N}+", "0")
    sid = F.md5(F.concat_ws("/", "host", shape))
    shapes, _ = write_table(parts.groupBy("host", shape.alias("shape"), F.col("_label").alias("label")).agg(
        F.count("*").alias("n")).withColumn("sid", F.md5(F.concat_ws("/", "host", "shape"))), "url-shapes")
    counts, _ = write_table(word_counts(corpus, text), "url-words")
    tokens, _ = write_table(_tokens(shapes, counts), "url-tokens")
    prior = shapes.agg(F.sum(F.when(F.col("label") == ALLOW, F.col("n"))),
                       F.sum(F.when(F.col("label") == BLOCK, F.col("n")))).first()
    some, other = prior[0] or 0, prior[1] or 0
    both = some > 0 and other > 0
    base = math.log(some / other) if both else 0.0
    open_tokens = tokens.where("label is null").groupBy("sid", "token").agg(F.count("*").alias("times"))
    weight = F.col("times") * F.col("weight") if both else F.lit(0.0)
    scores, _ = write_table(open_tokens.join(_weights(tokens), "token").groupBy(F.col("sid").alias("_sid")).agg(
        F.sum(weight).alias("sum")), "url-scores")
    joined = parts.join(scores, (sid == scores["_sid"]) & parts["_label"].isNull(), "left")
    score = F.when(F.col("rule").isNull(), F.coalesce("sum", F.lit(0.0)) + base)
    verdict = F.coalesce("_label", F.when(score >= 0, ALLOW).otherwise(BLOCK))
    return joined.select(*old, "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))

"""Registered queries: each operator with its production settings over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    clustering, content, decontaminate, language, lines, mixing, neardup, prefixes, prefixjoin, quality, quotes,
    toxicity, urls)
from .words import held_out


#: Verdict, host and path of the rules of ``op2_host_words``. Fixed values.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pigeonhole_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that occurs in it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", F.col("m.item").alias("item_id"), "m.distance", "m.start", "m.length")


def op2_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES, _table(spark, sf_dir, "documents"))


def op3_deletion_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = lines.drop_duplicate_lines(docs, removed="n_removed")
    return cut.select("doc_id", "n_removed", "text")


def op4_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content.extract_content(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "content.text",
                        F.length("content.text").cast("bigint").alias("n_chars"), "content.n_blocks")


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out()).select("text", "lang"))
    labelled = language.identify(docs.select("doc_id", "text"), model, output="language")
    return labelled.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score",
                           F.size("language.spans").alias("n_spans"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs).select("doc_id", "quality.*")


def op8_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.where(~held_out()), labels.where(~held_out()))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, shingle=2, percent=80)


def op11_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefixjoin.join_classes(docs, width=3, percent=90)


def op12_burst_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixes.number_turns(_table(spark, sf_dir, "conversations"))
    nodes = prefixes.build_trie(*prefixes.share_heads(turns))
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def op13_heap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _clusters_sql(rounds: int) -> str:
    """One pair of tables a round: the vectors nearest to each centroid, and where these move."""
    assigned = """near{i} AS (
  SELECT v.rid, v.v, c.j, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.v, c.c)]) AS dist
  FROM vectors v CROSS JOIN c{i} c
  QUALIFY row_number() OVER (PARTITION BY v.rid ORDER BY dist, c.j) = 1
)"""
    moved = """sums{i} AS (
  SELECT j, p, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM near{i}) GROUP BY j, p
), means{i} AS (
  SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM sums{i} GROUP BY j
), c{next} AS (
  SELECT c.j, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN means{i} m ON m.j = c.j
)"""
    parts = ["""WITH vectors AS (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM vectors
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16
)"""]
    for i in range(rounds):
        parts += [assigned.format(i=i), moved.format(i=i, next=i + 1)]
    parts.append(assigned.format(i=rounds))
    return ",\n".join(parts) + f"""
SELECT v.vec_id, CAST(n.j AS INTEGER) AS cluster, CAST(n.dist AS BIGINT) AS distance,
  CAST(sum(n.dist) OVER (PARTITION BY n.j) AS BIGINT) AS cluster_inertia, CAST(sum(n.dist) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM near{rounds} n JOIN vectors v ON v.rid = n.rid JOIN c{rounds} c ON c.j = n.j
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pigeonhole_edits, op2_host_words, op3_deletion_neighbours, op4_minimum_cut, op5_language_spans,
        op6_mix_sources, op7_compression_bands, op8_quote_links, op9_nnpu_toxicity,
        op10_hyperminhash, op11_prefix_join, op12_burst_tries, op13_heap_bounds)
}

ORACLES: dict[str, str] = {
    "op3_deletion_neighbours": """
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), lines AS (
  SELECT doc_id, pos, line, string_split(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS words
  FROM split
), firsts AS (
  SELECT words, min({'d': doc_id, 'p': pos}) AS place FROM lines WHERE len(words) >= 5 GROUP BY words
), variants AS (
  SELECT words, place, unnest(range(1, len(words) + 1)) AS gap FROM firsts WHERE len(words) >= 10
), cut AS (
  SELECT place, gap, array_to_string(words[1:gap - 1] || words[gap + 1:], ' ') AS rest FROM variants
), pairs AS (
  SELECT a.place, min(b.place) AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.gap = b.gap AND b.place < a.place GROUP BY 1
  UNION ALL
  SELECT a.place, b.place FROM cut a JOIN firsts b ON a.rest = array_to_string(b.words, ' ') AND len(b.words) >= 10 AND b.place < a.place
  UNION ALL
  SELECT b.place, a.place FROM cut a JOIN firsts b ON a.rest = array_to_string(b.words, ' ') AND len(b.words) >= 10 AND a.place < b.place
), gone AS (
  SELECT l.doc_id, l.pos FROM lines l JOIN firsts f ON f.words = l.words
  WHERE f.place <> {'d': l.doc_id, 'p': l.pos} OR f.place IN (SELECT place FROM pairs)
), rest AS (
  SELECT l.doc_id, count(*) FILTER (WHERE g.pos IS NOT NULL) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(r.n_removed, 0) AS n_removed, r.text FROM documents d LEFT JOIN rest r USING (doc_id)
""",
    "op6_mix_sources": """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(text), '') || ':mix'), 1, 15) AS BIGINT) AS h
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS tokens FROM sized GROUP BY source
), ranked AS (
  SELECT source, tokens,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    1.5::DOUBLE * sum(tokens) OVER () AS budget
  FROM totals
), levels AS (
  SELECT (budget - coalesce(sum(2 * tokens) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ranked
  WINDOW w AS (ORDER BY tokens / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, tokens, least(2.0::DOUBLE * tokens, weight * (SELECT max(level) FROM levels)) AS target FROM ranked
), plans AS (
  SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(target / tokens) AS BIGINT) ELSE 0 END AS copies FROM targets
), hashes AS (
  SELECT source, h, sum(size) AS g FROM sized GROUP BY source, h
), running AS (
  SELECT source, h, g, sum(g) OVER (PARTITION BY source ORDER BY h) - g AS below FROM hashes
)
SELECT s.doc_id, s.size, p.tokens AS source_size, p.target,
  s.size * (p.copies + CASE WHEN r.below + r.g <= p.target - p.copies * p.tokens
    OR 2 * (p.target - p.copies * p.tokens - r.below) > r.g THEN 1 ELSE 0 END) AS taken
FROM sized s
JOIN plans p ON p.source IS NOT DISTINCT FROM s.source
JOIN running r ON r.source IS NOT DISTINCT FROM s.source AND r.h = s.h
""",
    "op11_prefix_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS g
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.seen
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.seen) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op12_burst_tries": """
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(concat(length(r), ':', r, x))) AS k FROM turns
), crc(c, s, v, i) AS (
  SELECT DISTINCT c, CAST(c AS VARCHAR), 4294967295::BIGINT, 0 FROM turns
  UNION ALL
  SELECT c, s, xor(u >> 1, (u & 1) * 3988292384), i + 1
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE v END AS u FROM crc WHERE i < 8 * len(s))
), convs AS (
  SELECT c, c - c % 5 AS base, xor(v, 4294967295::BIGINT) % 9 AS h FROM crc WHERE i = 8 * len(s)
), rebuilt AS (
  SELECT v.c, 0 AS part, o.k, o.r, o.x FROM convs v JOIN own o ON o.c = v.base AND o.k <= v.h
  UNION ALL
  SELECT v.c, 1, o.k, o.r, o.x FROM convs v JOIN own o ON o.c = v.c AND o.k > v.h
), lists AS (
  SELECT c, list({'r': r, 'x': x} ORDER BY part, k) AS seq FROM rebuilt GROUP BY c
), seqs AS (
  SELECT v.c, coalesce(l.seq, []) AS seq FROM convs v LEFT JOIN lists l ON l.c = v.c
), steps AS (
  SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM seqs
), members AS (
  SELECT c, d, len(seq) AS n, strlen(seq[d].x) AS size, min(c) OVER (PARTITION BY d, seq[1:d]) AS rep FROM steps
), nodes AS (
  SELECT rep, d, count(*) AS n_convs, coalesce(any_value(size), 0) AS size,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
  FROM members GROUP BY rep, d
), linked AS (
  SELECT n.*, p.rep AS parent FROM nodes n LEFT JOIN members p ON p.c = n.rep AND p.d = n.d - 1
), children AS (
  SELECT parent AS rep, d - 1 AS d, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY ALL
), below AS (
  SELECT a.rep, a.d, count(*) FILTER (WHERE c.n IS NULL) AS leaves, sum((n.n_convs - 1) * n.size) AS saved
  FROM nodes n JOIN members a ON a.c = n.rep AND a.d <= n.d LEFT JOIN children c ON c.rep = n.rep AND c.d = n.d
  GROUP BY a.rep, a.d
)
SELECT n.rep AS conv_id, n.d AS depth, n.parent AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM linked n JOIN below b USING (rep, d) LEFT JOIN children c USING (rep, d)
""",
    "op13_heap_bounds": _clusters_sql(rounds=3),
}

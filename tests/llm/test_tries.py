"""Prefix tries and centroid clustering against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lexiloom.llm import clustering, prefixes

TURNS = "conv_id bigint, turn bigint, role string, text string"


def _rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            known = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), known, role, text))
    own = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def _nodes(rows):
    whole = _rebuilt(rows)
    members, children = defaultdict(list), defaultdict(int)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
            leaves[path[:d]] += not children[path]
    return {(min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], leaves[path],
             saved[path], hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(path)).encode())
             .hexdigest()) for path, convs in members.items()}


def _trie(df, **settings):
    built = prefixes.build_trie(*prefixes.share_heads(prefixes.number_turns(df)), **settings)
    return [tuple(r)[:8] for r in built.collect()]


@pytest.mark.parametrize("settings", [{}, {"container": 2, "piece": 4}, {"container": 5, "piece": 7}])
def test_trie(spark, settings):
    """Long shared beginnings, equal conversations, ties, nulls and repeated rows; bursts and pieces of any size."""
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.choice([0, 1, 3, 9, 14, 30])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["u", "a", None]) if t > 25 else "u",
                         rng.choice(["x", "é", None, "yy"]) if rng.random() < 0.15 else "z"))
    rows += rows[:7] + [(None, 1, "u", "x"), (1000, None, None, None)]
    got = _trie(spark.createDataFrame(rows, TURNS), **settings)
    assert len(got) == len(set(got)) and set(got) == _nodes(rows)


def test_trie_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], TURNS)
    assert _trie(empty) == []
    assert _trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)) == []
    one = spark.createDataFrame([(7, 0, "user", "x" * 300_000)], TURNS)
    assert set(_trie(one)) == _nodes([(7, 0, "user", "x" * 300_000)])


def test_trie_with_other_columns_and_texts(spark):
    """Columns under the names used inside change nothing, and nodes get back the turn they stand for."""
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], TURNS + ", t string, conv int")
    turns = prefixes.number_turns(df)
    nodes = prefixes.build_trie(turns, turns.select("conv"))
    got = {(r.conv, r.depth, r.role, r.text) for r in prefixes.node_texts(nodes, df).collect()}
    assert got == {(1, 0, None, None), (1, 1, "user", "hi"), (2, 2, "bot", "yo")}


def _clusters(vectors, k, rounds):
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    v = np.array([x for _, x in order])
    centroids = v[:k].copy()

    def nearest():
        d = np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        at, _d = nearest()
        centroids = np.array([v[at == j].sum(0) // (at == j).sum() if (at == j).any() else c
                              for j, c in enumerate(centroids)])
    at, d = nearest()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((order[i][0], int(at[i]), int(d[i]), int(d[at == at[i]].sum()), int(d.sum()), digest[at[i]])
                  for i in range(len(v)))


@pytest.mark.parametrize("k, rounds, span", [(16, 3, 40), (5, 6, 3), (3, 2, 1), (400, 2, 9)])
def test_clusters(spark, k, rounds, span):
    """Many ties (small spans), repeated vectors and rows, more centroids than vectors, several rounds."""
    rng = np.random.default_rng(k)
    vectors = [(i, rng.integers(-span, span + 1, 64).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(60)] + vectors[:10]
    df = spark.createDataFrame([(i, [x / 64 for x in v]) for i, v in vectors], "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, clustering.cluster_vectors(df.repartition(3), k, rounds).collect()))
    assert got == _clusters(vectors, k, rounds)


def test_only_expired_vectors_are_scanned(spark, sf_dir):
    """Later generations hold less than all vectors: most keep their cluster unseen once centroids settle."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = clustering.whole_vectors(df, "vec_id", "embedding", 64, 64).cache()
    heaps, _ = clustering._fit(vectors, clustering._first_centroids(vectors, 4, 1), 12)
    sizes = [g.count() for g in heaps.generations]
    assert sizes[0] == vectors.count() == heaps.all().count() and sizes[-1] < sizes[0]


def test_unusable_vectors(spark):
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, good[:-1]), (4, [None, *good[1:]]), (5, [float("nan"), *good[1:]]),
            (6, [float("inf"), *good[1:]]), (None, good), (7, [1e300, *good[1:]])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, cluster string")
    got = {r.vec_id: (r.cluster, r.distance, r.inertia) for r in clustering.cluster_vectors(df, 2).collect()}
    assert set(got) == {1, 7, None} and all(x[1] == 0 for i, x in got.items() if i != 7)
    assert clustering.cluster_vectors(df.limit(0)).collect() == []

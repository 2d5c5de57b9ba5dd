"""Near duplicates, repeated lines and benchmark items against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import components, decontaminate, lines, neardup, prefixjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    width = min(k, len(words))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if width else set()


def _roots(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _group(rng, base, n, edits, vocabulary):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(*edits)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_components(spark, k):
    """Groups near the threshold, a dense group, exact copies, short texts: every link counts."""
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size, edits in ((120, (0, 9)), (60, (2, 7)), (25, (8, 14))):
        texts += _group(rng, [rng.choice(vocabulary) for _ in range(100)], size, edits, vocabulary)
    for _ in range(80):
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))))
    texts += ["a b c d e", "A b C d e", "a b c d e f", "b c d e f", "a\tb\x0bc d\ne"] + texts[:30]
    rows = list(enumerate(texts, 1000))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in neardup.near_duplicates(df, k, 80).collect()}
    sets = {i: _set(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = _roots(sets, links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in sets.items())
    kept = neardup.drop_near_duplicates(df.union(df.limit(3)), k, 80).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i in want if want[i] == i)


@pytest.mark.parametrize("k, percent, block", [(3, 90, 20_000), (5, 80, 7)])
def test_prefix_join(spark, monkeypatch, k, percent, block):
    """Links of groups near the threshold that share a hot part, in one block and in many."""
    monkeypatch.setattr(prefixjoin, "_BLOCK", block)
    monkeypatch.setattr(prefixjoin, "_SHARED", block)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for size, edits in ((70, (0, 4)), (40, (1, 3)), (20, (3, 6))):
        texts += _group(rng, [rng.choice(vocabulary) for _ in range(90)], size, edits, vocabulary)
    for _ in range(60):
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))))
    texts += ["a b", "A B", "a b c", "b", "a\tb\x0bc d\ne", "", None] + texts[:30]
    rows = list(enumerate(texts, 1000))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in prefixjoin.join_classes(df, k, percent).collect()}
    sets = {i: _set(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = _roots(sets, links)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(links) > 100 and any(want[i] != i for i in want)


def test_prefix_join_odd_rows(spark, odd_documents):
    """Null ids and texts, empty texts, repeated rows, one id with two texts, each with its defined result."""
    got = sorted(map(tuple, prefixjoin.join_classes(odd_documents, 3, 90).collect()), key=repr)
    long = len({(f"word{i % 977}x{i % 31}", f"word{(i + 1) % 977}x{(i + 1) % 31}", f"word{(i + 2) % 977}x{(i + 2) % 31}")
                for i in range(59_998)})
    want = [(None, 0, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, long, 4), (5, long, 4), (5, long, 4), (None, 12, None),
            (6, 1, 6), (6, 8, 6), (7, 1, 7), (8, 2, 8), (9, 1, 9)]
    assert got == sorted(want, key=repr)


def test_prefix_join_blocks_as_arrays():
    """Members of lists as arrays, those of a slice too: blocks meet without an object per member."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("node", "label", "n", "i")]))
    lists = pa.array([[(9, 9, 9, 9)], [(1, 2, 3, 4), (5, 6, 7, 8)], [(2, 2, 2, 2)]], kind)
    members, at = prefixjoin._unpack(lists.slice(1))
    assert [members[:, i:j].T.tolist() for i, j in zip(at, at[1:])] == [[[1, 2, 3, 4], [5, 6, 7, 8]], [[2, 2, 2, 2]]]


@pytest.mark.parametrize("cross", [0, 50])
def test_prefix_join_groups_in_one_step_or_by_member(spark, monkeypatch, cross):
    def found():
        rows = [(i, " ".join(f"w{j}" for j in range(20 + i % 9)) + f" e{i}") for i in range(40)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return sorted(map(tuple, prefixjoin.join_classes(df, 1, 95).collect()))

    want = found()
    monkeypatch.setattr(prefixjoin, "_CROSS", cross)
    assert found() == want


def test_prefix_join_other_partner(spark):
    """Two sets that only share n-grams nobody else has, while each shares more of its prefix with a third set."""
    rows = []
    for k in range(12):
        def names(kind, n):
            return [f"{kind}{k}x{i}" for i in range(n)]

        common, left, right = names("c", 89), names("l", 95), names("r", 95)
        shared, own, other = names("s", 6), names("a", 5), names("b", 5)
        sets = [common + shared + own, common + shared + other, own + left, other + right]
        # These make the words of the last lists frequent, and with their own words they meet nothing.
        sets += [common + left + right + names(f"f{i}x", 100) for i in range(4)]
        rows += [(8 * k + i, " ".join(words)) for i, words in enumerate(sets)]
    got = prefixjoin.join_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 1, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - (i % 8 == 1) for i, _ in rows}


def _written(monkeypatch, labels, look):
    """What ``look`` makes of the tables of a prefix join before they are written."""
    seen, write = {label: [] for label in labels}, prefixjoin.write_table

    def looked(df, label):
        if label in seen:
            seen[label].append(look(df))
        return write(df, label)

    monkeypatch.setattr(prefixjoin, "write_table", looked)
    return seen


def test_prefix_join_reads_texts_of_likely_pairs_only(spark, monkeypatch):
    """Sets that share a rare n-gram and little else are told apart by their parities; similar ones are still linked."""
    rng = random.Random(5)
    sets = [[f"w{i}" for i in rng.sample(range(400), 60)] + [f"s{k}", f"s{k + 1}"] for k in range(40)]
    sets.append(sets[7][:-2] + ["other", "words"])
    rows = [(i, " ".join(words)) for i, words in enumerate(sets)]
    seen = _written(monkeypatch, ["join-tried", "join-across", "join-wanted"], lambda df: df.where("b >= 0").count())
    got = prefixjoin.join_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 1, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 7 if i == 40 else i for i in range(41)}
    assert sum(seen["join-tried"]) + sum(seen["join-across"]) > 30
    assert sum(seen["join-wanted"]) == 1


def test_prefix_join_exchanges_shared_places_once(spark, monkeypatch, capsys):
    def exchanges(df):
        capsys.readouterr()
        df.explain()
        return sum("REPARTITION_BY_COL" in line and "Reused" not in line for line in capsys.readouterr().out.splitlines())

    rows = [(i, " ".join(f"w{j}" for j in range(20 + i % 9)) + f" e{i}") for i in range(40)]
    seen = _written(monkeypatch, ["join-across"], exchanges)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans show reuse only once they have run
    try:
        prefixjoin.join_classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 1, 95).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert seen["join-across"] == [1]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 3000)), st.sets(st.integers(0, 3000)), st.sampled_from([50, 80, 90, 100]))
def test_parity_filter(x, y, percent):
    """The lower bound never exceeds the true distance, also of sets with other numbers of buckets."""
    x |= set(range(len(y) * 20))
    a, b = (prefixjoin.mix(np.array(sorted(s), np.uint64)) for s in (x, y))
    one, two = prefixjoin.parities(a, percent), prefixjoin.parities(b, percent)
    assert prefixjoin.parity_distance(one, two) == prefixjoin.parity_distance(two, one) <= len(x ^ y)
    assert prefixjoin.parity_distance(one, one) == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.sampled_from([50, 80, 90, 100]))
def test_suffix_filter(x, y, percent):
    """The lower bound never exceeds the true distance, and the verdict is that of the whole sets."""
    a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
    for limit in (0, 3, 100):
        assert prefixjoin.suffix_distance(a, b, limit) <= len(x ^ y)
    if x and y:
        assert prefixjoin.similar(a, b, percent) == (100 * len(x & y) >= percent * len(x | y))


def test_register_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        for n in (300, 5_000, 200_000):
            both = rng.integers(0, 1 << 63, int(2 * n * share / (1 + share)), dtype=np.uint64) * np.uint64(2)
            rest = rng.integers(0, 1 << 63, (2, n - len(both)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = (np.unique(np.concatenate((both, r))) for r in rest)
            found, used = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None],
                                           np.array([len(a)]), np.array([len(b)]))
            assert abs(found[0] - share) < 5 * (share * (1 - share) / used[0]) ** 0.5 + 0.01


def test_chance_collisions():
    rng = np.random.default_rng(2)
    a, b = (np.array([neardup.registers(np.unique(rng.integers(0, 1 << 63, 5_000, dtype=np.uint64) << np.uint64(1)))
                      for _ in range(400)]) for _ in range(2))
    seen = ((a == b) & (a > 0)).mean()
    expected = float(neardup._collision(np.array([5_000 / 256]), np.array([5_000 / 256]))[0])
    assert 0.7 * expected < seen < 1.4 * expected


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.a: r.b for r in components.components(df)[0].collect()}
    want = _roots({x for e in links for x in e}, links)
    assert got == {i: r for i, r in want.items() if i != r}


def _apart(a, b):
    """Word edit distance, cut off above 1."""
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) == len(b):
        return min(2, sum(x != y for x, y in zip(a, b)))
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return 1 if any(long[:i] + long[i + 1:] == short for i in range(len(long))) else 2


def test_line_words_without_a_string_per_character(spark):
    """White space is replaced by bytes; ``translate`` would look up every character."""
    df = spark.createDataFrame([("A\tb\x0bC \x0cd\re\nÉ  f",), (None,), ("",)], "line string")
    words = df.select(lines.plain_words(F.col("line")).alias("w"))
    assert [r.w for r in words.collect()] == [["a", "b", "c", "d", "e", "é", "f"], None, []]
    assert "translate" not in words._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_hashed_without_words(spark):
    """Equal hashes, halves and counts as by word arrays, which are not made."""
    odd = ["", " ", "\t", "a", " a", "A  ", "a b", "a\tB", "ab", "\u00e9\u00c9 f", "\u4f60\u597d ok", "\u4f60 \u597d  OK", "\u201ca b\u201d",
           "\x7f a", "\x85 a", " ".join("abcdefghij"), "  ".join("ABCDEFGHIJ"), "\x0c".join("abcdefghijk") + "\r",
           "x b c d e f g h i j k", "a b c d e f g h i j"]
    df = spark.createDataFrame([(1, "\n".join(odd)), (2, None), (3, "")], "doc_id bigint, text string")
    hashed = lines._hashed_lines(df, "doc_id", "text")
    assert "array_remove" not in hashed._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.id, r.pos): r for r in hashed.collect()}
    assert found.keys() == {(1, i) for i in range(len(odd))} | {(3, 0)}
    plain = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "pos int, line string").select(
        "pos", lines.plain_words(F.col("line")).alias("w"))
    words = {r.pos: tuple(r.w) for r in plain.collect()}
    rows = [(w, found[1, i]) for i, w in words.items()]
    assert all(r.n == len(w) for w, r in rows)
    assert all((v == w) == (q.h == r.h) for v, q in rows for w, r in rows)
    ends = {"a b c d e f g h i j": 2, "a b c d e f g h i j k": 4, "x b c d e f g h i j k": 4}
    assert all(len(r.halves) == ends.get(" ".join(w), 0) for w, r in rows)
    ten, eleven, other = ({x for w, r in rows if " ".join(w) == k for x in r.halves} for k in ends)
    assert len(ten & eleven) == 1 and len(eleven & other) == 2


def test_only_shifted_lines_get_keys_by_order(spark, monkeypatch):
    """Words are ordered by a window only for lines that may have one more word than another."""
    base = [f"w{i}" for i in range(12)]
    inserted = base[:5] + ["w3"] + base[5:]
    swapped = inserted[::-1][:6] + inserted[:7]
    texts = [base, base[:4] + ["x"] + base[5:], inserted, swapped, ["z"] * 12, ["z"] * 11,
             [f"v{i}" for i in range(12)], [f"v{i}" for i in range(11)] + ["y"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    made, variants = [], lines._variants
    monkeypatch.setattr(lines, "_variants", lambda chosen: made.append(
        {" ".join(r.words) for r in chosen.collect()}) or variants(chosen))
    got = {r.id: r.keeper.id for r in lines.removed_lines(df).collect()}
    assert got == {1: 0, 2: 0, 5: 4, 7: 6}
    assert {" ".join(texts[i]) for i in (0, 2, 4, 5)} <= made[0]
    assert not made[0] & {" ".join(texts[i]) for i in (1, 6, 7)}


def test_removed_lines(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(30)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.choice((3, 5, 9, 10, 11, 12, 25)))] for _ in range(25)]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                at = rng.randrange(len(line))
                line[at:at + rng.randint(0, 1)] = rng.choice(([], [rng.choice(vocabulary)]))
            text.append((" ".join(line).upper() if rng.random() < 0.2 else "  ".join(line)) or "")
        docs.append((i, "\n".join(text)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    seen, want = [], {}
    for i, text in docs:
        for pos, line in enumerate(text.split("\n")):
            words = line.lower().split()
            if len(words) < lines.LEAST_WORDS:
                continue
            for place, earlier in seen:
                exact = words == earlier
                if exact or min(len(words), len(earlier)) >= lines.NEAR_WORDS and _apart(words, earlier) <= 1:
                    want[i, pos] = place
                    break
            seen.append(((i, pos), words))
    found = lines.removed_lines(df).collect()
    got = {(r.id, r.pos): (r.keeper.id, r.keeper.pos) for r in found}
    assert {r.edits for r in found} == {0, 1}
    assert got.keys() == want.keys()
    # A repeated line may name its first copy where an even earlier line is one word away.
    assert all(got[k] >= want[k] and got[k] < k for k in got)
    cut = {r.doc_id: r.text for r in lines.drop_duplicate_lines(df).collect()}
    assert cut == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in want) for i, t in docs}


def _sellers(pattern, text):
    column = list(range(len(pattern) + 1))
    out = []
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(column[i] + (p != c), column[i + 1] + 1, new[i] + 1))
        column = new
        out.append(column[-1])
    return out


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=80), st.text("abc", min_size=1, max_size=120))
def test_bit_parallel_distance(pattern, text):
    assert decontaminate.distances(pattern, text) == _sellers(pattern, text)
    least, start, end = decontaminate.best_match(pattern, text)
    assert least == min(_sellers(pattern, text))
    assert 0 <= start <= end


def test_found_items(spark):
    rng = random.Random(7)
    letters = "abcdefghij "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(24, 140)))) for i in range(30)]
    docs = []
    for i in range(120):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        for _ in range(rng.randint(0, 2)):
            piece = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(piece))
                piece[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "Y"])
            cut = rng.randint(0, len(text))
            text = text[:cut] + "".join(piece) + text[cut:]
        docs.append((i, text))
    found = decontaminate.find_items(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                     spark.createDataFrame(items + items[:2], "item_id bigint, text string"))
    got = {(r.doc_id, m.item): m.distance for r in found.collect() for m in r.matches}
    want = {}
    for i, text in docs:
        for j, item in items:
            p, t = decontaminate.normalise(item), decontaminate.normalise(text)
            if len(p) < decontaminate.EXACT_BELOW:
                if p and re.search(rf"(?<!\w){re.escape(p)}(?!\w)", t):
                    want[i, j] = 0
            elif t:
                least = min(_sellers(p, t))
                if least <= int(len(p) * decontaminate.EDIT_RATE):
                    want[i, j] = least
    assert len(want) > 40 and len(set(want.values())) > 3
    assert got == want


def test_short_items(spark):
    """Items too short for edits occur as whole words, unchanged but for case and white space."""
    items = [(1, "What is 2+2?"), (2, "the  Moon"), (3, "  "), (4, "四加四"), (5, "x"), (6, None)]
    docs = [(1, "please tell me: what is 2+2? thanks", {1: (16, 12)}), (2, "the moonlight, bathe moon", {}),
            (3, "THE\nMOON", {2: (0, 8)}), (4, "他问四加四是几", {4: (2, 3)}), (5, "what is 2+3? xx", {}),
            (6, "somewhat is 2+2? the moons, the moon", {2: (28, 8)}), (7, "", {}), (8, None, {}),
            (9, "ax x " + "xx " * 1000, {5: (3, 1)})]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {r.doc_id: {m.item: (m.start, m.length) for m in r.matches}
           for r in decontaminate.find_items(df, bench).collect()}
    assert got == {d[0]: d[2] for d in docs}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()) == [2, 5, 7, 8]


def test_item_blocks(spark, monkeypatch):
    """More items than one automaton holds give the same matches."""
    docs = spark.createDataFrame([(i, f"{'filler words ' * i}item number {i % 9} of a benchmark with a text") for i in range(40)],
                                 "doc_id bigint, text string")
    items = spark.createDataFrame([(i, f"item number {i} of a benchmark with a text") for i in range(9)],
                                  "item_id bigint, text string")
    whole = decontaminate.find_items(docs, items).select("doc_id", "matches").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    blocks = decontaminate.find_items(docs, items).select("doc_id", "matches").collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, blocks)) and all(r.matches for r in whole)
    assert decontaminate.drop_contaminated(docs, items).isEmpty()
    assert decontaminate.drop_contaminated(docs, items.where(F.lit(False))).count() == 40


def test_lines_without_spaces(spark):
    """Chinese, Japanese and Thai lines go as copies and for one letter, as words do elsewhere."""
    rng = random.Random(4)
    docs, want, copies = [], [], []
    for low, high in ((0x4E00, 0x9FA5), (0x3041, 0x3096), (0x0E01, 0x0E2E), (0x20000, 0x20100)):
        def line(n):
            return "".join(chr(rng.randrange(low, high)) for _ in range(n))

        long, short, tiny = line(200), line(7), line(4)
        docs += ["\n".join((long, short, tiny)), "\n".join((long, short, tiny)), long[:90] + "x" + long[91:],
                 long[:30] + long[31:], long[:50] + " " + long[50:], line(200), short[:3] + "x" + short[4:]]
        want += [0, 2, 1, 1, 1, 0, 0]
        copies += ["\n".join((long, short, tiny)), tiny, "", "", "", docs[-2], docs[-1]]
    docs.append("a line of latin letters with ünd ö and é marks\nA line of Latin letters with ünd ö and é marks")
    want.append(1)
    copies.append(docs[-1].split("\n")[0])
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    out = {r.doc_id: r for r in lines.drop_duplicate_lines(df, removed="n").collect()}
    assert [out[i].n for i in range(len(docs))] == want
    assert [out[i].text for i in range(len(docs))] == copies

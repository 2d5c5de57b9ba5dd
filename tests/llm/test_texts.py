"""Quality, language, toxicity, content, urls, quotes and mixing against plain versions."""

import base64
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiloom.llm import content, language, mixing, quality, quotes, toxicity, urls, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality


def _base(text):
    found = WORD.findall(text or "")
    windows = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    inside = {j for i in range(len(found) - 7) if windows[tuple(found[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(found) < 20 or 100 * len(inside) > 30 * len(found)
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed)


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t\x0b\u00a0\u2003é#|", max_size=200))
def test_base_counts(text):
    assert quality._counts(words.utf8(text)) == _base(text)[:5]


def test_histogram_takes_few_texts_at_once(spark, monkeypatch):
    """Whatever batches the session has, and they stay the session's."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    histogram = quality._histogram
    monkeypatch.setattr(quality, "_histogram", lambda *a: seen.append(spark.conf.get(name)) or histogram(*a))
    spark.conf.set(name, "10000")
    try:
        assert quality.compression_limits(spark.createDataFrame([("a text of some words " * 9,)], "text string"))
        assert seen == ["1000"] and spark.conf.get(name) == "10000"
    finally:
        spark.conf.set(name, before)


def test_hash_tables_grow_with_texts(monkeypatch):
    """A worker that sees short texts holds no tables for long ones; hashes do not depend on them."""
    monkeypatch.setattr(words, "_powers", {})
    short = words.word_hashes(b"some words of a text")
    assert sum(t.nbytes for t in words._powers.values()) <= 1 << 20
    long = words.word_hashes(b"some words of a text " + b"x" * 200_000)
    assert len(words._powers["up"]) > 200_000
    assert (long[:5] == short).all() and (words.word_hashes(b"some words of a text") == short).all()


def test_quality(spark, documents):
    rng = random.Random(1)
    clean = [r.text for r in documents.select("text").collect()]
    vocabulary = sorted({w for t in clean for w in t.split()})
    noise = [base64.b64encode(rng.randbytes(1500)).decode() for _ in range(5)]
    noise = [" ".join(n[i:i + 7] for i in range(0, len(n), 7)) for n in noise]
    stutter = [" ".join(w for _ in range(300) for w in [rng.choice(vocabulary[:9])]) for _ in range(5)]
    texts = clean + noise + stutter
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r.quality for r in quality.score_quality(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i])[:6] == _base(t)
        data = t.encode()
        assert rows[i].ratio == len(zstandard.ZstdCompressor(3).compress(data)) / len(data)
        assert not (rows[i].base_failed and rows[i].kept)
    n = len(clean)
    assert not any(rows[i].kept for i in range(n, len(texts)))
    assert sum(rows[i].kept for i in range(n)) > 0.8 * sum(not rows[i].base_failed for i in range(n))
    kept = quality.filter_quality(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, q in rows.items() if q.kept}


def test_copies_move_no_band(spark, documents):
    """A class full of copies and near copies of one text keeps the other texts in."""
    texts = [r.text for r in documents.select("text").collect()]
    one = max((t for t in texts if len(t) < 1500), key=len)
    near = [one.replace(" ", f" x{i} ", 1) for i in range(200)] + [one] * 200
    df = spark.createDataFrame([(t,) for t in texts + near], "text string")
    plain = quality.compression_limits(spark.createDataFrame([(t,) for t in texts], "text string"))
    moved = quality.compression_limits(df)
    assert all(abs(plain[c][0] - moved[c][0]) < 0.12 for c in plain)


def test_rare_scripts_have_bands(spark, documents):
    """Texts letter by letter in another script, one in twenty, are kept as the Latin ones are."""
    texts = [r.text for r in documents.select("text").collect()]
    passed = {r.doc_id for r in quality.score_quality(spark.createDataFrame(
        list(enumerate(texts)), "doc_id int, text string")).where("quality.kept").collect()}
    turned = {c: chr(0x430 + i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    turned |= {c.upper(): v.upper() for c, v in turned.items()}
    other = [t.translate(str.maketrans(turned)) if i % 20 == 0 else t for i, t in enumerate(texts)]
    kept = {r.doc_id for r in quality.score_quality(spark.createDataFrame(
        list(enumerate(other)), "doc_id int, text string")).where("quality.kept").collect()}
    rare = {i for i in passed if i % 20 == 0}
    assert len(rare) >= 5 and len(rare & kept) >= 0.9 * len(rare)
    assert len(passed & kept) >= 0.95 * len(passed)


def test_last_bytes_are_judged(spark, documents):
    """Noise and repetition behind the last full chunk are seen as anywhere else."""
    texts = [r.text for r in documents.select("text").collect()]
    limits = {-2: quality.compression_limits(documents)[-2]}  # chunks of Latin letters
    clean = ""
    for t in texts:  # as even as a text can be made of the corpus
        ok = quality._ratios(quality._compressor(), (clean + t).encode())[1]
        if all(limits[-2][0] <= x <= limits[-2][1] for c, x in ok if c == -2):
            clean += t + "\n"
    clean = clean.encode()[:8 * quality.CHUNK].decode(errors="ignore")
    clean += "." * (8 * quality.CHUNK - len(clean.encode()))
    noise = base64.b64encode(random.Random(5).randbytes(3000)).decode()
    noise = " ".join(noise[i:i + 7] for i in range(0, len(noise), 7))[:4000]
    rows = [clean, clean + noise, clean + "ab" * 2000, clean + texts[0][:50]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    out = df.select("doc_id", quality.quality(df, limits, max_repeat_percent=100).alias("q")).orderBy("doc_id").collect()
    assert [r.q.kept for r in out] == [True, False, False, True]


# language


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-9, 0)] * 3), min_size=1, max_size=7), st.floats(0, 6))
def test_viterbi(scores, switch):
    scores = np.array(scores)

    def value(path):
        return sum(scores[i, s] for i, s in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

    best = max(value(p) for p in itertools.product(range(3), repeat=len(scores)))
    assert math.isclose(value(language.label_words(scores, switch)), best, abs_tol=1e-6)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(~words.held_out()))
    rows = language.identify(docs.where(words.held_out()), model).collect()
    assert sum(r.lang == r.language.lang_pred for r in rows) >= 0.97 * len(rows)
    texts = {r.lang: " ".join(r.text.split()[:40]) for r in rows if len(r.text.split()) >= 60}
    mixed = texts["en"] + " " + texts["de"]
    lang, share, spans = language.label_text(mixed, model)
    assert [s[2] for s in spans] == ["en", "de"] and 0.3 < share < 0.7
    assert language.label_text("123 !?", model) == ("und", 0.0, [])


def test_scripts_narrow_candidates(spark):
    rows = [("hello there my friend", "en"), ("привет мой друг", "ru"), ("γεια σου φίλε", "el"), (None, "xx"), ("nothing", None)]
    model = language.train(spark.createDataFrame(rows * 3, "text string, lang string"))
    assert model.languages == ["el", "en", "ru", "xx"]
    assert [s[2] for s in language.label_text("hello привет φίλε", model)[2]] == ["en", "ru", "el"]


# toxicity


def test_nnpu_risk():
    """Half of the positives are among the unlabelled: these are found as well."""
    rng = np.random.default_rng(0)

    def bag(bad):
        return np.unique(np.append(rng.integers(0, 200, 30), rng.integers(300, 306, 3) if bad else []).astype(int))

    positive = [bag(True) for _ in range(200)]
    hidden = [bag(True) for _ in range(100)]
    clean = [bag(False) for _ in range(900)]
    weights, bias = toxicity.fit_nnpu(positive + hidden + clean, np.array([True] * 200 + [False] * 1000), 0.1, bits=10)
    score = [1 / (1 + math.exp(-bias - weights[b].sum())) for b in hidden + clean]
    assert np.mean([s >= 0.3 for s in score[:100]]) > 0.95 and np.mean([s >= 0.3 for s in score[100:]]) < 0.1


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs.where(~words.held_out()), labels.where(~words.held_out()))
    held = docs.where(words.held_out()).join(labels, "doc_id")
    rows = toxicity.score_toxicity(held.select("doc_id", "text", "toxic"), model).collect()
    hit = [r.toxic for r in rows if r.score >= 0.3]
    assert sum(hit) >= 0.85 * sum(r.toxic for r in rows) and sum(hit) >= 0.75 * len(hit)


# content


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.data())
def test_minimum_cut(scores, data):
    n = len(scores)
    pairs = list(itertools.combinations(range(n), 2))
    edges = [(*p, data.draw(st.floats(0, 2))) for p in pairs if data.draw(st.booleans())]

    def cost(side):
        return (sum(max(0, -s) if c else max(0, s) for s, c in zip(scores, side))
                + sum(w for a, b, w in edges if side[a] != side[b]))

    best = min(cost(p) for p in itertools.product((True, False), repeat=n))
    assert math.isclose(cost(content.minimum_cut(scores, edges)), best, abs_tol=1e-6)


def test_main_text():
    page = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head>
    <body><header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=1>Menu one</a><li><a href=2>Two</a></ul></nav>
    <div id="cookie-notice">We use cookies to make this site a better place for all.</div>
    <article><h1>The &lt;title&gt;</h1><p>First  paragraph &amp; more\n of it, with <b>bold <i>and</b> words.<p>Short.
    <div class="adBox ad">Buy this thing, it is the best thing that you can buy today.</div>
    <blockquote>A quotation of some length, which belongs to the text.</blockquote>
    <form><label>Your mail</label><input><button>Send</button></form>
    <section class="comments"><p>I do not agree with the author of this article at all, says a reader.</p></section>
    </article><aside>Related: other articles that you may want to read as well.</aside><!-- <p>no</p> -->
    <footer>&copy; all rights reserved"""
    want = ["The <title>", "First paragraph & more of it, with bold and words.", "Short.",
            "A quotation of some length, which belongs to the text."]
    assert content.main_text(page)[0].split("\n") == want


ARTICLE = "<h1>The title</h1><p>A first paragraph of some words, as they stand in an article.<p>And a second one, which goes on."
TEXT = "The title\nA first paragraph of some words, as they stand in an article.\nAnd a second one, which goes on."


@pytest.mark.parametrize("page", [
    "<html><head><title>No</title><meta name=a><script>var no = 1</script><link href=x><body><article>" + ARTICLE,
    "<head><style>p{}</style><article>" + ARTICLE, "<head><title>No</title></head><body><article>" + ARTICLE,
    "<body><form action=x><article>" + ARTICLE + "</article><label>Your mail</label><button>Send</button></form>",
    "<body><form action=x><div class=content>" + ARTICLE + "</div><label>Your mail</label></form>",
    "<body><div class='layout has-sidebar'><article>" + ARTICLE + "</article><div class=sidebar>Read this other thing, too.</div></div>",
    "<div id=page-header-wide><form><div class='layout has-sidebar'><main>" + ARTICLE + "</main><nav>Menu of it</nav></div></form></div>",
    "<article>" + ARTICLE + "</article><div class=sidebar><article><p>Another thing, of a few words.</article></div>"
    "<section class=comments><article><p>I do not agree with the author of this at all, says one of the readers, and goes on for so long that"
    " the comment has more words than the article that it is about, which should not make it the text of the page.</article></section>",
    "<article>" + ARTICLE + "</article><form hidden><article><p>Not to be seen, by any reader at all.</article></form>",
])
def test_wrappers_and_open_heads(page):
    assert content.main_text(page)[0] == TEXT


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = content.extract_content(pages).collect()
    assert rows
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(content.html.unescape(re.sub(r"<[^>]+>", " ", b)).split())
                  for b in re.split(r"</?p>|</?h1>", article)]
        assert r.content.text == "\n".join(b for b in blocks if b)


# urls


def test_url_parts_and_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/")]
    cases = {
        "http://WWW.Example.com/en/1?q=/x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/#t": ("a.example.com", "/en/", "example.com/en/", "block"),
        "https://a.example.com/EN/": ("a.example.com", "/EN/", "com/", "allow"),
        "x://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://net/es/2": ("net", "/es/2", "net/es/", "block"),
        "http://planet/es/2": ("planet", "/es/2", None, None), "http://a.com?x://b.net/es/": ("a.com", "", None, None),
        "http://É.NET/es/\nx": ("É.net", "/es/\nx", "net/es/", "block"), "no url": ("", "", None, None),
        None: ("", "", None, None), "://": ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    rows = urls.judge_urls(df, rules, spark.createDataFrame([("planet words",)], "text string")).collect()
    for r in rows:
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")


def test_segmentation(spark):
    counts = {"daily": 40, "news": 60, "new": 90, "day": 50, "sport": 20, "sports": 15, "s": 5, "a": 70, "il": 2}
    total = sum(counts.values())

    def chance(parts):
        return sum(math.log(counts[p] / total) if p in counts else math.log(1 / (total + 1)) - 2.5 * len(p) for p in parts)

    names = ["dailynews", "newsports", "adaily", "xyz", "daysnew", "z" * 70]
    got = {r.name: r.words for r in urls.segment_names(
        spark.createDataFrame([(n,) for n in names], "name string"),
        spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()}
    assert got["dailynews"] == ["daily", "news"] and got["z" * 70] == ["z" * 70]
    for name in names[:5]:
        cuts = [[name[a:b] for a, b in zip((0, *c), (*c, len(name)))] for k in range(len(name))
                for c in itertools.combinations(range(1, len(name)), k)]
        assert math.isclose(chance(got[name]), max(map(chance, cuts)))


def test_bayes_verdicts(spark):
    """Hosts that no rule decides go by the words they share with those that one does."""
    good, bad = ["daily", "news", "sport"], ["casino", "poker", "bonus"]
    rows = [f"http://{a}{b}.com/{c}/{i}" for i, (a, b, c) in enumerate(itertools.product(good, good, good))]
    rows += [f"http://{a}{b}.net/{c}/{i}" for i, (a, b, c) in enumerate(itertools.product(bad, bad, bad))]
    rows += ["http://newssport.org/daily/5", "http://pokercasino.org/bonus/7"]
    corpus = spark.createDataFrame([(" ".join(good * 9 + bad * 9),)], "text string")
    out = urls.judge_urls(spark.createDataFrame([(r,) for r in rows], "url string"),
                          [("allow", "com", "/"), ("block", "net", "/")], corpus).where("rule is null").collect()
    assert {r.host: r.verdict for r in out} == {"newssport.org": "allow", "pokercasino.org": "block"}


# quotes


def _plain_links(rows):
    """Reply and reply order of one conversation, message by message."""
    said = []
    reply, branch, replied = [], [], set()
    for i, (_, text) in enumerate(rows):
        own, passages = quotes.parse(text)
        found = []
        for level, passage in passages:
            at = [j for j in range(i) if quotes.normalise(passage) in said[j]] if quotes.normalise(passage) else []
            if at and level == 1:
                found.append(max(at))
        said.append(set(quotes.sources(own)))
        parent = found[0] if found else i - 1 if i else None
        reply.append(parent)
        branch.append(branch[parent] if parent is not None and parent not in replied else i)
        replied.add(parent)
    order = sorted(range(len(rows)), key=lambda i: (branch[i], i))
    return [(reply[i], branch[i], order.index(i)) for i in range(len(rows))]


def test_quote_links(spark, monkeypatch):
    monkeypatch.setattr(quotes, "_CHUNK", 8)
    rng = random.Random(11)
    rows, want = [], {}
    for conv, n in ((1, 1), (2, 60), (3, 25), (None, 9)):
        talk = []
        for i in range(n):
            text = f"message {rng.randrange(8)} says\nline {rng.randrange(30)} of it\n\nand more {i}"
            if i and rng.random() < 0.6:
                other = quotes.parse(talk[rng.randrange(i)][1])[0].split("\n")
                part = other if rng.random() < 0.5 else other[:2]
                mark = rng.choice(("> ", ">> ", "> "))
                text = "On Monday somebody wrote:\n" + "\n".join(mark + x.upper() for x in part) + "\n" + text
            talk.append((i, text))
        rows += [(conv, i, "user", t) for i, t in talk]
        for i, w in enumerate(_plain_links(talk)):
            want[conv, i] = w
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.reply_to, r.branch, r.position) for r in out} == want
    assert sum(r.n_linked for r in out) > 20 and len({r.branch for r in out}) > 5
    assert not any(">" in r.text or "wrote:" in r.text for r in out)


def test_partial_quotes(spark):
    """Parts of paragraphs link as a search of the plain texts says."""
    talk = ["The red fox ran.  It was fast!\nNobody saw it leave the old yard\nuntil noon came\n\nSecond part here\n\nThird part there",
            "The red fox sat. It was slow.\nNobody saw it", "ok then", "他说今天下雨。我们不去公园了。明天再说吧。", "nothing of note"]
    cases = {"> nobody saw it leave the old yard\n> until noon came\nyes": 0, "> The red fox ran. It was fast!\n> Nobody saw it leave the old yard\n> until noon came\n>\n> Second part here": 0,
             "> It was fast!\nindeed": 0, "> saw it leave the\n> old yard until noon\nhm": 0, "> The red fox ran.\n> until noon came\nboth": 0,
             "> 我们不去公园了。\n好": 3, "> until noon came\n> The red fox ran.\nwrong order": None, "> Nobody saw\nwho": 1,
             "> red fox ran. It\nmid": 0, "> no such words\nnone": None, "> the\nshort": 1, "> OK\nshort": 2}
    rows = []
    for c, quote in enumerate(cases):
        rows += [(c, i, "user", t) for i, t in enumerate([*talk, quote])]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    got = {r.conv_id: (r.n_linked, r.reply_to) for r in out if r.turn == len(talk)}
    assert [got[c] for c in range(len(cases))] == [
        (int(w is not None), len(talk) - 1 if w is None else w) for w in cases.values()]
    # One line of a quote: the plain search of the words between borders.
    for c, (quote, w) in enumerate(cases.items()):
        lines = [x[2:].lower() for x in quote.split("\n") if x.startswith("> ")]
        if len(lines) == 1:
            plain = [i for i, t in enumerate(talk) if re.search(rf"(?<![a-z]){re.escape(lines[0])}(?![a-z])", " ".join(t.lower().split()))]
            assert (max(plain) if plain else None) == w


def test_tables_are_no_quotes(spark):
    table = "Prices:\n| name | price |\n| --- | --- |\n| tea | 3 |\n|  |  |\n| all |"
    talk = [("first of all\nsecond thing", "first of all\nsecond thing", 0, 0), (table, table, 0, 0),
            ("| second thing\nyes", "yes", 1, 1), ("On Monday she wrote:\n| nobody said this\nno", "On Monday she wrote:\n| nobody said this\nno", 0, 0),
            ("a\n| unknown\nb\n| second thing\nc\n> lost\nd", "a\n| unknown\nb\nc\n> lost\nd", 2, 1),
            ("> | tea | 3 |\nso", "so", 1, 1), ("| | second thing\ndeep", "deep", 1, 1)]
    df = spark.createDataFrame([(1, i, "user", t[0]) for i, t in enumerate(talk)],
                               "conv_id bigint, turn bigint, role string, text string")
    out = quotes.link_quotes(df).orderBy("turn").collect()
    assert [(r.text, r.n_quotes, r.n_linked) for r in out] == [t[1:] for t in talk]
    assert [r.reply_to for r in out] == [None, 0, 0, 2, 0, 1, 5]  # the last by its level


# mixing


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 5, 40, 300))), rng.choice(["a", "a", "a", "b", "c", "é", None, "z"]), i)
            for i in range(3000)] + [(5000, None, "a", 0), (5001, "x " * 7, "only", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, taken bigint")
    out = mixing.mix_sources(df).collect()
    size = defaultdict(int)
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, budget = {}, 1.5 * sum(size.values())
    while True:  # share, cut what is above twice its size, share the excess anew
        free = [s for s in names if s not in target]
        share = {s: (budget - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * size[s]]
        if not above:
            target |= share
            break
        target |= {s: 2 * size[s] for s in above}
    taken = defaultdict(int)
    for r in out:
        assert r.size == len((r.text or "").split()) and r.source_size == size[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    largest = max(len((t or "").split()) for _, t, _, _ in rows)
    assert all(abs(taken[s] - target[s]) <= largest / 2 for s in names)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_unlinked_passages_stay(spark):
    """What begins with quote marks and has no source is code, a list or somebody else's words."""
    talk = ["first of all", "try\n>>> print(1)\n1\n> $ ls\n» note", "> 5 is larger\n>\n> first of all\nyes",
            "On Monday she wrote:\n> lost words\nno", "> first of all", ">\nonly marks"]
    df = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(talk)],
                               "conv_id bigint, turn bigint, role string, text string")
    out = quotes.link_quotes(df).orderBy("turn").collect()
    assert [r.text for r in out] == [talk[0], talk[1], talk[2], talk[3], "", "only marks"]
    assert [(r.n_quotes, r.n_linked, r.reply_to) for r in out] == [
        (0, 0, None), (2, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 0), (0, 0, 4)]

"""Whitening, the prefix trie and HTML extraction against brute force, enumeration and labelled pages that weren't learned."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import dom, html_extract, trie, whitening
from quillon.llm.layouts import Layout

SF = "/root/testdata/sf0.001"


# whitening


def whitened(spark, vectors, k=4, **columns):
    rows = [(i, v) for i, v in enumerate(vectors)]
    return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ["vec_id"], k=k)


def brute_whitening(vectors, k=4):
    x = np.floor(np.asarray(vectors, np.float32).astype(float) * 256).astype(np.int64)
    u = np.unique(x, axis=0)
    centred = u - u.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(u))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    dev = ((len(u) * x - u.sum(axis=0)) ** 2).sum(axis=1)
    return (x - u.mean(axis=0)) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / len(u)), dev, len(u)


def test_whitening_query_against_a_full_decomposition(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    want, share, dev, n = brute_whitening(np.stack(source.embedding))
    got = whitening.op11_whitening(spark, SF).orderBy("vec_id", "component").toPandas()
    w = got.whitened.to_numpy().reshape(-1, 4)
    assert (got.n == n).all() and (got.deviation.to_numpy().reshape(-1, 4) == dev[:, None]).all()
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4), share, rtol=1e-9) and got.identity_error.max() < 1e-9


def test_whitening_stops_early_or_expands(spark):
    rng = np.random.default_rng(1)
    frame = lambda x: spark.createDataFrame([(r,) for r in x.tolist()], "_vector array<long>")
    falling = np.round(rng.standard_normal((400, 40)) * 1000.0 / 3.0 ** np.arange(40)).astype(int)
    model = whitening.fit(frame(falling))
    assert not model.full and model.passes <= 4
    flat = rng.integers(-200, 200, (400, 40))
    model = whitening.fit(frame(flat))
    assert model.full and model.passes == whitening.POWER + 2 and model.error < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    got = whitened(spark, [[1.0, 0.0], [1.0, 0.0], [0.5], None, [nan, 1.0], [1.0, None], [inf, 0.0], [0.0, 0.25], []]).collect()
    rows = {(r.vec_id, r.component): r for r in got}
    assert sorted(rows) == [(i, c) for i in (0, 1, 2, 7, 8) for c in (1, 2)] and got[0].n == 4
    assert rows[0, 1].whitened == rows[1, 1].whitened and all(r.identity_error < 1e-9 for r in got)
    flat = whitened(spark, [[0.5, 0.5]] * 3).collect()
    assert [r.n for r in flat] == [1] * 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in flat)
    line = whitened(spark, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
    assert whitened(spark, []).count() == 0 and whitened(spark, [[], None]).count() == 0
    vast = whitened(spark, [[3e38], [1.0], [-3e38]]).collect()
    assert [r.deviation for r in sorted(vast, key=lambda r: r.vec_id)][0] is None and all(np.isfinite(r.whitened) for r in vast)


def test_whitening_of_odd_columns(spark):
    rows = [(None, [0.5, 1.0], "x", 1), (2, [0.0, 3.0], "y", 2), (2, [0.0, 3.0], "y", 2)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, whitened int"), ["vec_id"])
    assert got.columns == ["vec_id", *whitening._RESULTS] and got.count() == 6


# prefix trie


def brute_trie(rows):
    """Every prefix of every rebuilt conversation, node by node."""
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            conv[c].append(((turn is not None, turn or 0), mark, len(re.findall(r"[^\x20\x09-\x0D]+", text))))
    conv = {c: [(d, w) for _, d, w in sorted(v)] for c, v in conv.items()}
    nodes, words = defaultdict(list), {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 4
        turns = conv.get(c - c % 20, [])[:h] + conv[c][h:]
        for d in range(len(turns) + 1):
            key = tuple(k for k, _ in turns[:d])
            nodes[key].append((c, len(turns)))
            words[key] = turns[d - 1][1] if d else 0
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for key, members in nodes.items():
        for d in range(len(key) + 1):
            saved[key[:d]] += (len(members) - 1) * words[key]
            leaves[key[:d]] += not kids[key]
    return sorted(
        (min(m)[0], len(k), min(nodes[k[:-1]])[0] if k else -1, len(m), kids[k], leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(c for c, n in m if n == len(k))).encode()).hexdigest())
        for k, m in nodes.items()
    )


def nodes_of(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, df.collect()))


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, block_rows, chunk", [(1, 1, 1), (2, 3, 2), (3, 4, 100), (4, 1000, 3)])
def test_trie_against_all_prefixes(spark, seed, block_rows, chunk):
    draw, rows = random.Random(seed), []
    for c in range(draw.choice([3, 60])):
        for k in range(draw.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c if draw.random() < 0.95 else None, draw.choice([k, k, k, None]), draw.choice(["user", "a", None]), draw.choice(["x", "x", "x y", "", None, " "])))
    got = trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS), block_rows, chunk)
    assert nodes_of(got) == brute_trie(rows)


def test_trie_of_a_hot_conversation_over_many_blocks(spark):
    rows = [(c, t, "user", f"hello {t}") for c in range(200) for t in range(5)] + [(c, t, "user", f"hello {t} {c * (t > 2)}") for c in range(200, 260) for t in range(6)]
    got = trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS), 10, 3)
    assert nodes_of(got) == brute_trie(rows)


def test_trie_of_one_long_chain(spark):
    """Prefixes of each other, so that every block's minima matter."""
    rows = [(20 * c, t, "user", str(t)) for c in range(1, 40) for t in range(c)] + [(800 + 20 * c, t, "user", str(t)) for c in range(40) for t in range(40 - c)]
    assert nodes_of(trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS), 4)) == brute_trie(rows)


def test_trie_edges(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    turnless = [(c, 0, "user", "x") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    got = nodes_of(trie.prefix_trie(spark.createDataFrame(turnless, CONVERSATIONS)))
    assert got == brute_trie(turnless) and len(got) == 1 and got[0][5] == 1
    odd = [(1, 0, "user", "a b " * 50_000, 7), (1, 0, "user", "a b " * 50_000, 8), (-7, None, None, None, 9)]
    got = trie.prefix_trie(spark.createDataFrame(odd, CONVERSATIONS + ", depth int"))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"] and nodes_of(got) == brute_trie([r[:4] for r in odd])


# HTML extraction


def test_messages_are_the_marginals_of_all_assignments():
    draw = random.Random(4)
    pages = []
    for _ in range(6):
        page = dom.Page()
        for i in range(draw.randint(0, 6)):
            page.add(draw.randint(0, i), draw.choice(["", "p", "div"]), (), "x", 0.0, None)
        pages.append(page)
    forest = html_extract.Forest(pages, {})
    rng = np.random.default_rng(5)
    scores, edges = rng.normal(size=forest.size), rng.normal(size=(2, 2, 2))
    got, pairs, partition = html_extract.messages(forest, scores, edges)
    total = 0.0
    for page, start in zip(pages, forest.starts):
        n = len(page.parent)
        weight, one, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for states in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(scores[start + i] * s for i, s in enumerate(states)) + sum(edges[forest.kind[start + i], states[page.parent[i]], states[i]] for i in range(1, n)))
            weight += w
            one += w * np.array(states)
            for i in range(1, n):
                joint[i, states[page.parent[i]], states[i]] += w
        total += np.log(weight)
        assert np.allclose(got[start : start + n], one / weight) and np.allclose(pairs[start + 1 : start + n], joint[1:] / weight)
    assert abs(total - partition) < 1e-9


def made(documents, first, n, shift):
    texts = [r.text for r in documents.where("length(trim(text)) > 0").orderBy("doc_id").limit(first + n).collect()][first:]
    return [dom.parse(Layout(t, texts[(i + 1) % n].split(), 1000 * i + shift).page()) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(spark, documents):
    return html_extract.train(documents)


def test_layouts_that_were_not_learned(documents, model):
    pages = made(documents, 0, 200, 77)
    forest, chance = model.marginals(pages)
    runs = forest.kind == 1
    wrong = ((chance > 0.5) != html_extract.truth(pages))[runs]
    assert runs.sum() > 3000 and wrong.mean() < 0.01


def test_learning_raises_the_likelihood(documents):
    pages = made(documents, 0, 30, 5)
    def loss(m):
        forest, wanted = html_extract.Forest(pages, m.vocabulary), html_extract.truth(pages)
        scores = forest.scores(m.weights)
        kids = np.flatnonzero(forest.parent >= 0)
        said = scores @ wanted + m.edges[forest.kind[kids], wanted[forest.parent[kids]], wanted[kids]].sum()
        return html_extract.messages(forest, scores, m.edges)[2] - said
    losses = [loss(html_extract.learn(pages, steps)) for steps in (1, 10, 100)]
    assert losses[0] > losses[1] > losses[2] > 0


SITE = """<!doctype html><html><head><title>x</title><style>a{}</style><script>var a = "<p>no</p>";</script></head><body>
<div class="cookie-consent"><p>We use cookies to improve your experience. <a href=/p>Learn more</a></p><button>OK</button></div>
<header class="site-header"><a class="logo" href="/">My Site</a><nav><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul></nav></header>
<main><article><header><h1>The big &amp; long&nbsp;story</h1></header><p>First paragraph of the
 story is here, and it goes on for a while.</p><aside class="pullquote ad"><p>Buy our product now, it is very good for you.</p></aside>
<p>Second <em>para</em>graph with a <a href="/x>y">link</a><br>inside it.<!-- <p>gone</p> --></p><p>Short.</p><ul><li>Item one of the list.<li>Item two of the list.</ul>
<div class="share-links"><a href=1>Tweet</a> <a href=2>Share</a></div></article>
<section id="comments"><h3>3 comments</h3><div class="comment"><p>I think this is a great article, thanks for writing it up for us all.</p></div>
<div class="comment"><p>Me too. I really liked the second paragraph the most of all.</p></div></section></main>
<aside class="sidebar"><h4>Popular</h4><ul><li><a href=1>Ten ways to do things</a><li><a href=2>What happened next</a></ul></aside>
<form class=newsletter><label>Email</label><input><p>Sign up for our newsletter today.</p></form>
<footer><p>&copy; 2024 My Site. All rights reserved.</p></footer></body></html>"""
SITE_TEXT = [
    "The big & long story", "First paragraph of the story is here, and it goes on for a while.", "Second paragraph with a link inside it.",
    "Short.", "Item one of the list.", "Item two of the list.",
]
PLAIN = """<body><div id=top><a href=1>Home</a> | <a href=2>News</a></div><div id=main><h1>Title of it</h1><p>Some text here that is long enough
to be a text, it says.<p>And another one without any end tag but with some words</div><div id=right><h3>Links</h3><a href=x>one</a><br><a href=y>two</a></div>"""


def test_pages_written_by_hand(model):
    got = model.main_texts([dom.parse(SITE), dom.parse(PLAIN), dom.parse("<p>Only a paragraph of text, and nothing else.</p>")])
    assert got[0].split("\n\n") == SITE_TEXT
    assert got[1].split("\n\n") == ["Title of it", "Some text here that is long enough to be a text, it says.", "And another one without any end tag but with some words"]
    assert got[2] == "Only a paragraph of text, and nothing else."


def test_trees_of_broken_pages():
    texts = lambda html: [(p.tag[p.parent[i]], t) for p in [dom.parse(html)] for i, t in enumerate(p.text) if t]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("root", "e")]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == [("td", "a"), ("td", "b"), ("td", "c"), ("root", "d")]
    assert texts("a < b <p>c</div>d</p>e<!-- f") == [("root", "a < b"), ("p", "c"), ("p", "d"), ("root", "e")]
    assert texts("<script>a<p>b</script>c<title>d</title><style>e") == [("root", "c")]
    assert texts("<head><meta><title>t</title><body>x<select><option>y</select>z") == [("body", "xz")]
    assert texts("<p title='a>b' hidden>x&lt;y&amp</p") == [("p", "x<y&")]
    assert texts("") == texts("<div><p></p></div>") == [] and dom.parse(None).text == [""]
    assert dom.parse('<div class="Side-barLeft x" id=a style="display: none">').tokens[1] == ("side", "bar", "left", "x", "a", "hidden")


def test_extraction_edges(spark, model):
    long = "<div>" * 3000 + "<p>" + "Some words of a text. " * 20_000
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "", 2), (3, "v", SITE, 3), (3, "v", SITE, 3), (4, "w", long, 4), (5, "", "<<<>>&&; <a", 5)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model, ["page_id", "url"]).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got)[:3] == [(0, 0), (1, 0), (1, 0)] and len(got) == 7
    assert all(r.n_chars == len(r.text) for r in got) and [r.text.split("\n\n") for r in got if r.page_id == 3] == [SITE_TEXT] * 2
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(empty, model, ["page_id", "url"]).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert html_extract.train(blank).main_texts([dom.parse(SITE)])[0].split("\n\n").count(SITE_TEXT[1]) == 1

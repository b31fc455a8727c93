import itertools
import math
import random
import re
import time

from tessera.llm import html_extraction as hx


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><!-- <p>x</p> -->
    <nav><ul><li><a href="/a>b">One</a><li>Two</ul></nav><article class='story main'><h1>Fish &amp; <b>chips</b></h1>
    <p>a&nbsp; b<br>c<p>d <i>e</i>&#33;<table><tr><td>x<td>y</table>1 < 2</article><p"""
    got = hx.blocks(page)
    assert [b.text for b in got] == ["One", "Two", "Fish & chips", "a b c", "d e!", "x", "y", "1 < 2"]
    assert got[0].linked == 1 and got[1].linked == 0
    assert {"in:article", "is:story", "is:main"} <= hx.features(got)[2]


def test_gradient_and_viterbi_match_enumeration():
    rng = random.Random(1)
    c = hx.Chain()
    c.t = [rng.uniform(-1, 1) for _ in range(4)]
    for n in (1, 2, 5):
        scores, labels = [rng.uniform(-2, 2) for _ in range(n)], [rng.randint(0, 1) for _ in range(n)]
        value = lambda y: sum(s for s, v in zip(scores, y, strict=True) if v) + sum(c.t[2 * a + b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        every = list(itertools.product((0, 1), repeat=n))
        z = sum(math.exp(value(y)) for y in every)
        node, edge = c.gradient(scores, labels)
        for i in range(n):
            assert math.isclose(node[i], sum(math.exp(value(y)) for y in every if y[i]) / z - labels[i], abs_tol=1e-9)
        for j in range(4):
            want = sum(math.exp(value(y)) * sum(2 * a + b == j for a, b in itertools.pairwise(y)) for y in every) / z - sum(2 * a + b == j for a, b in itertools.pairwise(labels))
            assert math.isclose(edge[j], want, abs_tol=1e-9)
        assert value(c.viterbi(scores)) == max(map(value, every))


def test_held_out_pages():
    chain = hx.trained()
    right = total = 0
    for page, article in hx.training_pages(150, seed=77):
        own, labels = hx.labelled(page, article)
        got = chain.viterbi(chain.emissions(own))
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.98


def test_pages_table(spark):
    d = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    out = hx.op3_html(spark, d).collect()
    assert len(out) == len(html)
    for r in out:
        page = html[r.page_id]
        a = page.index("<article>")
        want = "\n".join(b.text for b in hx.blocks(page[a : page.find("</article>") if "</article>" in page else None]))
        assert r.text == want and r.n_chars == len(want)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "no tags at all", "c"), (4, "<", "d"), (5, "<p>" * 3000 + "x", "e"), (6, '<a b="', "f"), (7, "<div>" + "word " * 300_000, "g"), (1, None, "a")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = hx.extract(df).collect()
    assert len(out) == 8 and {r.text for r in out if r.page_id in (1, 2)} == {""}
    assert all(r.n_chars == len(r.text) for r in out)
    assert hx.extract(df.limit(0)).collect() == []


def test_hidden_elements_and_form_controls():
    texts = lambda page: [b.text for b in hx.blocks(page)]
    assert texts("<article><p>a<select><option>One<option>Two</select> b<p>c<textarea>x</textarea><button>Go</button></article>") == ["a b", "c"]
    assert texts("<article><p>a</p><noscript><p>b</p>") == ["a", "b"]
    assert texts("<p>a<svg><path d='M0'><p>b") == ["a", "b"]
    assert texts("<p>a</p><svg><g>1<svg>2</svg>3</g></svg><p>b</p><noscript>no</noscript>") == ["a", "b"]
    assert texts("<p>a</p><script>var x = '<p>no</p>'") == ["a"]
    assert texts("</svg><select><p>a") == ["a"]


def test_scores_of_nested_elements_match_the_features():
    chain = hx.trained()
    pages = [p for p, _ in itertools.islice(hx.training_pages(40, seed=5), 40)]
    pages.append("".join(f'<div class="c{i % 7} story">' for i in range(300)) + "<p>deep</p>" + "</div>" * 290 + "<p>less deep</div>tail")
    for page in pages:
        found = hx.blocks(page)
        assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(chain.scores(found), chain.emissions(hx.features(found)), strict=True))


def test_work_grows_with_the_length_not_the_depth():
    chain, took = hx.trained(), []
    for n in (2000, 16_000):
        page = "".join(f'<div class="a"><b>x{i}</b></i>' for i in range(n)) + "<svg>" * n + "<li>" * n
        began = time.process_time()
        assert hx.main_text(page, chain) is not None
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]


#: Pages written by hand, none by the generator: {} marks the blocks of the article.
HAND = [
    """<!doctype html><html><head><title>The mill</title></head><body class="blog"><div id="top"><a href="/">Hill Notes</a> <a href="/about">About</a></div>
    <div id="wrap"><div class="post"><h2>{The old mill}</h2><p>{The mill by the river was built in 1822, and for a century it ground the flour of three villages.}</p>
    <p>{Its wheel stopped in the war. Nobody repaired it, though the owner promised to.}</p><blockquote>{We will turn again, he wrote.}</blockquote></div>
    <div id="comments"><h3>2 comments</h3><p>Lovely piece, thank you!</p><p>My aunt worked there.</p></div></div><div id="footer">Copyright 2019 Hill Notes. All rights reserved.</div></body></html>""",
    """<html><body><header><h1>City Herald</h1><nav><a href="/n">News</a> <a href="/s">Sport</a> <a href="/w">Weather</a></nav></header><main><article><h1>{Bridge closed for repairs}</h1>
    <p class="byline">{By A. Reporter, 4 May}</p><p>{The council closed the north bridge on Monday after engineers found cracks in two of its piers.}</p>
    <div class="advert"><p>Buy two tyres, get one free!</p></div><p>{Traffic will be led over the ring road until autumn, a spokeswoman said.}</p>
    <ul><li>{Buses 4 and 7 stop at the market.}</li><li>{Cyclists may use the footbridge.}</li></ul></article></main>
    <aside><h3>Most read</h3><ol><li><a href="/1">Storm warning</a></li><li><a href="/2">Team wins cup</a></li></ol></aside><footer><p>Privacy policy | Terms | Contact</p></footer></body></html>""",
    """<body><div class="cookie-banner">We use cookies to make this site better. <button>Accept</button></div><table><tr><td class="menu"><a href=a>Home</a><br><a href=b>Recipes</a><br><a href=c>Login</a></td>
    <td class="content"><h1>{Lentil soup}</h1><p>{Wash the lentils, cover them with water and let them simmer for half an hour.}<h2>{You need}</h2><ul><li>{200 g of lentils}<li>{one onion}<li>{salt, pepper, and a bay leaf}</ul>
    <p>{Serve hot, with bread.}</td></tr></table><form action="/subscribe"><label>Your email</label><input><button>Subscribe</button></form></body>""",
    """<html><body><nav class="breadcrumb"><a href="/">Docs</a> &raquo; <a href="/api">API</a></nav><section class="content" role="main"><h1>{Reading a table}</h1><p>{Call <code>read</code> with the path of the file; the result is a frame.}</p>
    <pre>{frame = read("a.csv")}</pre><p>{Columns keep the order that they have in the file, and names are not changed.}</p></section>
    <div class="sidebar"><ul><li><a href="1">Writing a table</a></li><li><a href="2">Joins</a></li><li><a href="3">Windows</a></li></ul></div><div class="footer">© 2020 The authors. <a href="l">License</a></div></body></html>""",
]


def test_pages_written_by_hand():
    right = found = wanted = 0
    for marked in HAND:
        own = [b.text for b in hx.blocks(marked)]
        labels = [t.startswith("{") for t in own]
        page = re.sub(r"[{}]", "", marked)
        got = hx.main_text(page, hx.trained()).split("\n")
        want = [t.strip("{}").replace("} ", " ") for t, k in zip(own, labels, strict=True) if k]
        right, found, wanted = right + len({*got} & {*want}), found + len(got), wanted + len(want)
    print(f"precision {right / found:.3f} recall {right / wanted:.3f} of {wanted} blocks")
    assert right / found >= 0.9 and right / wanted >= 0.9

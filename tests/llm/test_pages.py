import random

import pytest

from contentgauge.llm import boost, pages


@pytest.fixture(scope="module")
def trees():
    return pages.trained()


def test_labels_of_unseen_layouts(trees):
    draw, right, total = random.Random(99), 0, 0
    for _ in range(200):
        page, label = pages.labelled(pages.training_page(draw))
        got = pages.decode(page, trees.margin(pages.features(page)))
        right += sum(a == b for a, b in zip(got, label.tolist()))
        total += len(label)
    assert right / total > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one.</a></li><li><a href="/b">Menu two</a></li><li><a href=/c>Three</a></li></ul></nav><!-- ad 1 -->
<div class="ad">Buy the best things here today for little money.</div>
<div id="cookie-notice"><p>We use cookies to make this site work, please accept all of them.</p></div>
<article><h1>A title &amp; more</h1><p>First&nbsp;paragraph of the <b>sto</b>ry with some words,<br>and more of them.
<p>Second &lt;one&gt; follows here, with <a href="x">a link</a> in it.</p><ul><li>point one is here</li><li>point two, too</li></ul></article>
<aside><h3>Related</h3><ul><li><a href="/x">Other story</a></li><li><a href="/y">One more</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div><p>I liked this story very much, thank you for it.</p></div></section>
<form><p>Sign up</p><input name=q><button>Go</button></form>
<footer>&copy; example.com &middot; All rights reserved.</footer></body></html>"""


def test_article_without_what_surrounds_it(frame):
    rows = [(1, PAGE, "u"), (2, None, "u"), (3, "", "u"), (3, "plain text\n only &amp; this", "u"), (4, "<p>un<b>closed", "u"),
            (None, "<body><article><p>" + "word " * 50_000 + "</p></article>", "u")]
    out = pages.extract(frame(rows, "page_id int, html string, text string")).collect()
    got = sorted(((r.page_id or 0, r.text) for r in out))
    assert got[0] == (0, " ".join(["word"] * 50_000))
    assert got[1] == (1, "A title & more First paragraph of the story with some words, and more of them. "
                         "Second <one> follows here, with a link in it. point one is here point two, too")
    assert got[2] == (2, "")
    assert got[3:5] == [(3, ""), (3, "plain text only & this")] and got[5][0] == 4
    assert pages.extract(frame([], "page_id int, html string")).collect() == []


def test_nothing_below_a_dropped_node_is_kept():
    draw = random.Random(1)
    for _ in range(50):
        page = pages.Page(pages.training_page(draw))
        margin = pages.np.array([draw.uniform(-3, 3) for _ in page.tag])
        label = pages.decode(page, margin)
        assert all(label[p] or not label[k] for k, p in enumerate(page.parent) if p >= 0)


def test_decoding_is_the_most_likely_consistent_labelling():
    page = pages.Page("<div><p>a</p><div><p>b</p><p>c</p></div></div>")
    draw, n = random.Random(2), len(page.tag)
    for _ in range(40):
        margin = pages.np.array([draw.uniform(-2, 2) for _ in range(n)])

        def score(label):
            return sum(-pages.np.logaddexp(0, -m if keep else m) for m, keep in zip(margin[1:], label[1:]))

        every = [[True] + [bool(b >> k & 1) for k in range(n - 1)] for b in range(1 << (n - 1))]
        best = max((x for x in every if all(x[page.parent[k]] or not x[k] for k in range(1, n))), key=score)
        assert pages.decode(page, margin) == best


def test_boosting_learns_a_rule():
    draw = pages.np.random.default_rng(0)
    x = draw.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boost.fit(x[:1500], y[:1500], columns=1.0)
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


@pytest.mark.parametrize("source, text", [
    ("<p>a<p>b", "a b"), ("<script>x</script>y", "y"), ("a<!-- b -->c", "ac"), ("<textarea>x<p></textarea>y", "y"),
    ("x < y &lt; z", "x < y < z"), ("<p title='a>b'>t</p>", "t"), ("<![CDATA[q]]>", "q"), ("<p>a</b></i>b", "ab"), ("</p></p>a", "a"),
    ("<style>never closed", ""), ("a&#x41;&eacute;&nope;", "aAé&nope;"), ("t<br>u<hr/>v<img alt=x>w", "t u vw"),
])
def test_parser(source, text):
    page = pages.Page(source)
    assert page.text([True] * len(page.tag)) == text

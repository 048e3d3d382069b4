"""Main text of pages: the scan against every run, and pages of many shapes."""

import os
import random

import pytest

from casework.llm import queries, webtext

SF = "/root/testdata/sf0.001"
LONG = "This is the first paragraph of a story that goes on for a while, with enough words to be found."
MORE = "Here is a second one, which also says a thing or two about the matter at hand and then ends."
CLUTTER = (
    '<nav><a href="/">Home</a> <a href="/x">News and more news</a></nav><header><p>My Site, the best of all sites</p></header>',
    '<aside>Popular: seven things you never knew about cats and dogs</aside><form>Your name <input> <button>Send it now</button></form>',
    '<div class="cookie-notice">We use cookies to make this site better for everyone, accept them all.</div>',
    '<section id="comments"><h2>Comments</h2><article class="comment"><p>I do not agree with this at all, but thanks for it.</p></article></section>',
    "<footer>&copy; 2024 All rights reserved by the owner of this site</footer>",
)


def sequences(n=300):
    r = random.Random(5)
    kinds = ["word", "word:link", "p", "/p", "div", "/div", "a", "nav.furniture"]
    for _ in range(n):
        f = [r.choice(kinds) for _ in range(r.randint(0, 14))]
        yield f, [r.randint(0, 9) if x.startswith("word") else 1 for x in f]


def test_scan_finds_the_largest_of_all_runs():
    weights = {"p": -0.5, "/p": 0.0, ".furniture": -9.0, **webtext.FIRST_WORDS}
    for features, amounts in sequences():
        score = [webtext.weight(f, weights) * n for f, n in zip(features, amounts)]
        best = max([0.0, *(sum(score[i : j + 1]) for i in range(len(score)) for j in range(i, len(score)))])
        run = webtext.best_run(features, amounts, weights)
        assert (run is None) == (best == 0) and (run is None or abs(sum(score[run[0] : run[1] + 1]) - best) < 1e-9)


def test_learned_weights_return_the_labelled_runs_and_keep_their_signs():
    pages = []
    for k in range(40):
        t = webtext.tokens(f"<div>Menu of {'many ' * (k % 7)} things</div><div><h1>A title</h1><p>{LONG}<p>{'Two words ' * (k % 5)}end</div><table><tr><td>Rest {'x ' * (k % 9)}</table>")
        own = [i for i, (f, n) in enumerate(zip(t.features, t.amounts)) if f == "word" and n]
        pages.append((t.features, t.amounts, own[1], own[-2]))
    weights = webtext.learn(pages, epochs=50)
    assert sum(webtext.best_run(f, n, weights) == (a, b) for f, n, a, b in pages) >= 38
    assert all(w > 0 if f.startswith("word") else w <= 0 for f, w in weights.items())


@pytest.mark.parametrize("shape", range(6))
def test_text_without_furniture(shape):
    head = "<!DOCTYPE html><html><head><title>Story - Site</title><style>p{}</style><script>if (a<b) x='</p>';</script></head><body>"
    body = f"<h1>The story</h1><p>{LONG}</p>\n<p>  {MORE}\n\t<b>Bold</b>&nbsp;&amp; <i>it</i>alic&hellip;<!-- no --></p>"
    want = f"The story\n\n{LONG}\n\n{MORE} Bold & italic…"
    c = CLUTTER
    page, text = [
        (f"{c[0]}<article>{body}</article>{c[3]}{c[4]}", want),
        (f"{c[0]}{c[2]}<main><article><header><h1>The story</h1></header>{body[18:]}{c[1]}<p>Last.</p>{c[3]}</article></main>{c[4]}", want + "\n\nLast."),
        (f"{c[0]}<div class='wrap'><div class='post-content has-sidebar'>{body}</div><div class='sidebar'>{LONG}</div></div>{c[4]}", want),
        (f"{c[0]}<div><div>{body}</div></div>{c[1]}{c[3]}{c[4]}", want),
        (f"<form id=aspnet>{c[0]}<main>{body}</main></form>{c[4]}", want),
        (f"{c[0]}<article>{body}<ul><li>One item<li>Two items</ul><table><tr><td>a<td>b</table>", want + "\n\nOne item\n\nTwo items\n\na\n\nb"),
    ][shape]
    assert webtext.main_text(head + page, {**webtext.FIRST_WORDS, "p": -1.0, "/p": -1.0, "h1": -1.0, "/h1": -1.0}) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<p></p><br>", ""), ("just words", "just words"), ("<!-- open", ""), ("<p>a &unknown; &#65;&am", "a &unknown; A&am"), ("<script>never closed words", ""),
        ("words <a href='x", "words"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<P CLASS=x>Up<BR/>per</P>", "Up per"), ("</div></p>odd</b>", "odd"), ("<p>a<p>b", "a\n\nb"),
        ("<div hidden>secret words here</div><p>shown</p>", "shown"),
    ],
)
def test_awkward_pages(html, text):
    assert webtext.main_text(html, {"p": 0.0, "/p": 0.0, "br": 0.0, "b": 0.0}) == text


def test_deep_and_long_pages_end():
    assert webtext.main_text("<b>" * 50_000 + "word " * 10 + "</i>" * 50_000, {}) == " ".join(["word"] * 10)
    assert len(webtext.main_text("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>", {})) == 20_000 * (len(LONG) + 2) - 2


def test_pages_table(spark):
    html = f"{CLUTTER[0]}<article><h1>T</h1><p>{LONG}<p>{MORE}</article>{CLUTTER[4]}"
    rows = [(1, "u", html, "x"), (1, "u", html, "x"), (None, None, None, None), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weights = webtext.fit(webtext.labelled(pages))
    got = sorted(webtext.extract(pages, weights).collect(), key=lambda r: (r[0] or 0, r[1] or ""))
    text = f"T\n\n{LONG}\n\n{MORE}"
    assert [tuple(r) for r in got] == [(None, None, "", 0), (1, "u", text, len(text)), (1, "u", text, len(text)), (2, "v", "", 0)]
    assert webtext.extract(pages.limit(0), webtext.fit(webtext.labelled(pages.limit(0)))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_held_out_pages_give_their_articles(spark):
    """Weights of 20 pages find the marked article of all others, before it is used to widen the run."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = webtext.fit(webtext.labelled(pages, sample=20))
    near = []
    for (html,) in pages.select("html").collect():
        begin, end = webtext.marked(html)
        page = webtext.tokens(html)
        low, high = webtext.best_run(page.features, page.amounts, weights)
        near.append(page.starts[low] == begin and page.starts[high] + len(page.texts[high]) == end)
    assert sum(near) >= 0.95 * len(near)
    assert queries.op13_html_text(spark, SF).where("n_chars = 0").count() == 0

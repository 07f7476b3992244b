import html
import re
import time
from collections import Counter

import pytest

from larkspur.llm import html_text


def expected(page):
    """Brute force for the table's pages: the article's text, split at block tags."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h[1-6]|div|ul|ol|li)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", b) if "<br>" in b else b).replace("<b>", "").replace("</b>", "").split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_all_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    out = html_text.extract(pages).collect()
    assert len(out) == len(source)
    wrong = [r.page_id for r in out if r.text != expected(source[r.page_id])]
    assert wrong == []


def test_noise_inside_and_around(spark):
    body = "".join(f"<p>Paragraph {i} &amp; some&nbsp;more <i>words</i> of   the article.</p>" for i in range(6))
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav>"
        f"<div class='cookie-notice'>We use cookies</div><article><h1>Title</h1>{body}<div class=\"ad\">Buy</div><form>Name <input></form>"
        "<script>var a='<p>no</p>';</script><p>Last <b>one<br>here</article><aside>Side words here</aside><section class='comments'><p>I say so</p></section><footer>Foot</footer></body></html>"
    )
    want = "\n".join(["Title", *(f"Paragraph {i} & some more words of the article." for i in range(6)), "Last one here"])
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>" + "word " * 200_000 + "</p>"), (1, "u", page), (5, "u", "<<<><p"), (6, "u", "no tags at all")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "0 as n_chars", "1 as id")
    got = html_text.extract(frame).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == want
    assert texts[2] == texts[3] == "" and texts[6] == "no tags at all" and texts[None].count("word") == 200_000
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(frame.limit(0)).count() == 0


BODY = "".join(f"<p>Paragraph {i} has <a href='x'>some linked words</a> of text here.</p>" for i in range(4))
WANT = "\n".join(f"Paragraph {i} has some linked words of text here." for i in range(4))
SHAPES = {
    "comments as nested articles": (f"<main><article><h1>T</h1>{BODY}</article><section class='comments'><article class='comment'><p>I am a reader comment of many words</p></article></section></main>", f"T\n{WANT}"),
    "nested inside the article": (f"<article>{BODY}<div class='comment-list'><article><p>nested one</p></article></div></article>", WANT),
    "blocks without main elements": (f"<div class='site-header'>Logo Login</div><div class='page has-sidebar'><div id='content' class='with-search'><h1>T</h1>{BODY}</div><div class='sidebar'>Side</div></div><div class='footer'>Foot</div>", f"T\n{WANT}"),
    "main without article": (f"<div class=cookie-banner>We use cookies</div><div>Other words outside</div><main>{BODY}<div id='comments'><p>hi there</p></div></main><footer>x</footer>", WANT),
    "form around the page": (f"<form id='aspnetForm'><div class='menu'>Home About</div><div>{BODY}</div></form>", WANT),
    "menu never closed": (f"<nav><ul><li>Home<li>About<article>{BODY}</article>", WANT),
    "missing quote": (f'<article><p title="broken>Eight nine ten.</p>{BODY}<p class="x">end</p></article>', f"Eight nine ten.\n{WANT}\nend"),
    "marks that only look like noise": ("<article><div class='post-header'><h1>T</h1></div><p class='share-price'>Five</p><div class='search-tips'>Six</div><div class='image-form'>Seven</div><ul><li>a</li><li>b</li></ul></article>", "T\nFive\nSix\nSeven\na\nb"),
    "quotes with signs": ('<article><p data-x="<b>no</b>" title=\'a > b\'>yes &eacute; &lt;i&gt; 1 < 2</p></article>', "yes é <i> 1 < 2"),
    "noise of every kind": (f"<article>{BODY}<aside>a</aside><div role='complementary'>b</div><button>c</button><div class='newsletter-form'>d</div><div class='relatedPosts'>e</div><style>f</style><textarea>g</textarea><div class='ad-slot'>h</div></article>", WANT),
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("weights", [html_text.Weights({}), html_text.Weights({"place:a": 9.0, "place:o": -8.0, "text:p": 9.0, "tag:/ul": -9.0, "tag:ul": -9.0})])
def test_shapes(name, weights):
    page, want = SHAPES[name]
    assert html_text.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>", weights) == want


def test_classes_outside_the_main_text_are_learned(spark):
    page = f"<body><div class='zeta'>{'plug words ' * 10}</div><article><h1>T</h1>{BODY}<div class='eta'>kept</div></article></body>"
    pages = spark.createDataFrame([(i, "u", page) for i in range(30)], "page_id long, url string, html string")
    weights = html_text.learn(pages)
    assert weights.outside == {"zeta"} and weights.odds["place:a"] > 0
    assert html_text.main_text(f"<div><p>before</p><div class='zeta'>plug</div>{BODY}</div>", weights) == f"before\n{WANT}"


def test_words_against_the_table(spark, sf):
    """Precision and recall over words, on pages whose main element was renamed, so that nothing in them names it."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_text.learn(pages)
    found = right = wanted = 0
    for r in pages.collect():
        want = expected(r.html).split()
        got = html_text.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>"), weights).split()
        found, wanted = found + len(got), wanted + len(want)
        right += sum((Counter(got) & Counter(want)).values())
    assert right / found > 0.97 and right / wanted > 0.99


@pytest.mark.parametrize("piece", ["<b>x", "<div>x", "<p>x<b>", "</b>", "<div class=comments><main>y"])
def test_time_is_linear_in_unclosed_tags(piece):
    began = time.perf_counter()
    html_text.main_text(piece * 100_000, html_text.Weights({}))
    assert time.perf_counter() - began < 10  # about one second; the square of this took minutes


def test_mains_inside_comments_and_around_them():
    page = "<main>a<div class=comments><article>b</article></div></main><div class=comments>c<main>d</main></div>"
    stream = html_text.read(page)
    noisy, place = html_text.judge(stream)
    got = {t: (n, p) for k, t, n, p in zip(stream.kind, stream.text, noisy, place, strict=True) if k == "text"}
    assert got == {"a": (False, "a"), "b": (True, "a"), "c": (True, "o"), "d": (True, "o")}

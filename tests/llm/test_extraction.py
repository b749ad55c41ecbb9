import math
import random
from collections import Counter

import pytest
from fixtures import empty

from paperlake.llm.extraction import Page, extract, importance

COLUMNS = "page_id long, url string, html string, text string, host string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head>
<body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use</div>
<nav><ul><li>a<li>b</ul></nav><article><header><h1>Tit &amp; le</h1><span class=by>by me</span></header>
<p>One&nbsp;two <b>three<br><p>Four</p> tail text<div>Five <a href=x>six</a></div><ul><li>L1<li>L2</ul>
<aside>no</aside><form>no<p>no</p></form><script>var x="</p>"</script><!-- ad -->
<div class="comments"><p>Nice!</p></div><section id="comments"><article class=comment>c</article></section>
<div id=share-bar>Share</div><table><tr><td>x<td>y</table></article><footer>f</footer>"""


def test_article_of_a_page():
    assert Page(PAGE).text() == "Tit & le\nOne two three\nFour\ntail text\nFive six\nL1\nL2\nx\ny"


def test_words_that_name_parts_of_articles_do_not_decide():
    html = (
        '<article><h1>T</h1><p>a</p><h2 id="related-work">Related work</h2><p>b</p>'
        '<section id="discussion"><p>c</p></section><p class="notice">d</p>'
        '<figure id="share-price">e</figure><div class="social"><a>x</a></div>'
        '<div class="related"><p>f</p></div><p class="ad">no</p><section class="comments"><p>no</p></section>'
    )
    assert Page(html).text() == "T\na\nRelated work\nb\nc\nd\ne\nf"
    assert Page('<div class="notice"><p>no</p></div><p>yes').text() == "yes"


def test_odd_markup():
    assert Page("").text() == ""
    assert Page("<p>a<p>b &am &amp c &#233;&#x41;").text() == "a\nb &am & c éA"
    assert Page('<div><div class="ad">x</div>text <i>in</i>line</div>').text() == "text inline"
    assert Page("<nav>menu<article><p>inside</article>").text() == "inside"
    assert Page("<article><p>one</p><article><p>reply</p></article>two</article>").text() == "one\ntwo"
    assert Page("<main><h2>M</h2>text</main>out").text() == "M\ntext"
    assert Page("<article>a</article><p>x</p><article>b</article>").text() == "a\nb"
    assert Page("plain\n\n text").text() == "plain text"
    assert Page("<p>cut <b").text().startswith("cut")
    assert Page("<div>" * 3000 + "deep").text() == "deep"


def rows():
    found = []
    for i in range(12):
        body = f"<p>story {i} of its own</p>" + "<p>more</p>" * (i % 4)
        html = f"<body><div class=top><span>Same on all pages</span></div><div class=body>{body}</div></body>"
        found.append((i, f"http://a.example/{i}", html))
    found += [(50, None, None), (51, "nohost", ""), (52, "http://b.example/", found[0][2])]
    found += [(53, "http://a.example/0", found[0][2])] * 2
    return [(*row, "clash", "clash") for row in found]


def test_branches_alike_on_all_pages_are_removed(spark):
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows(), COLUMNS)).collect()}
    for i in range(12):
        assert got[i] == "\n".join([f"story {i} of its own", *["more"] * (i % 4)])
    assert got[50] == got[51] == ""
    assert got[52].startswith("Same on all pages\nstory 0")
    assert got[53] == got[0]


def entropy(values):
    counts = Counter(values).values()
    return -sum(n / len(values) * math.log(n / len(values)) for n in counts) / math.log(len(values))


def article(i, rng):
    """A page whose article has a license table, a notice and a list alike on all pages."""
    paragraphs = "".join(f"<p>text {rng.randrange(10**6)}</p>" for _ in range(rng.randrange(1, 4)))
    return (
        f"<body><article><h1>title {i}</h1><h2>Summary</h2>{paragraphs}"
        '<table class="licence"><tr><td>Free to read</td></tr></table>'
        '<p class="notice">We keep records</p><ul class="rights"><li>All rights</li></ul>'
        f'<p class="share">own {i}</p></article><footer>f</footer></body>'
    )


def test_importance_matches_a_tree_in_memory(spark):
    rng = random.Random(3)
    htmls = [article(i, rng) for i in range(15)]
    table = spark.createDataFrame([("h", html) for html in htmls * 2], "host string, html string")
    got = {r.path & (2**64 - 1): r.importance for r in importance(table).collect()}
    merged = {}
    for html in htmls:
        for path, (style, content) in Page(html).styles().items():
            merged.setdefault(path, []).append((style, content))
    assert got.keys() == merged.keys()
    for path, both in merged.items():
        style, content = (entropy(x) for x in zip(*both, strict=True))
        assert got[path] == pytest.approx(0.3 * style + 0.7 * content, abs=1e-9)


def test_unimportant_branches_of_any_tag_in_an_article_go(spark):
    rng = random.Random(4)
    pages = [(i, f"http://a.example/{i}", article(i, rng), "", "") for i in range(15)]
    for r in extract(spark.createDataFrame(pages, COLUMNS)).collect():
        lines = r.text.split("\n")
        assert lines[:2] == [f"title {r.page_id}", "Summary"]
        assert lines[-1] == f"own {r.page_id}"
        assert all(line.startswith("text ") for line in lines[2:-1]) and len(lines) > 3


def test_copies_of_a_page_count_once(spark):
    table = spark.createDataFrame(
        [("h", "<article><div>copy</div><p>x</p></article>")] * 30 + [(None, None)], "host string, html string"
    )
    assert {r.pages for r in importance(table).collect()} == {1}


def test_repeated_article_text_is_kept(spark):
    html = "<article><p>The same article</p><p>again</p></article><footer>{}</footer>"
    table = spark.createDataFrame(
        [(i, "http://a.example/", html.format(i), "", "") for i in range(20)], COLUMNS
    )
    assert {r.text for r in extract(table).collect()} == {"The same article\nagain"}


def test_empty_table(spark):
    assert extract(empty(spark, COLUMNS)).count() == 0

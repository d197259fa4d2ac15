import html
import random
import re

import pytest
from pyspark.sql import functions as F

from vlprep.llm import queries
from vlprep.llm.htmltext import blocks, extract, main_text

LONG = "The first paragraph of the text is here and it is long enough to be told as text, with the words that it takes for that."


def article(page):
    """What stands between the article's tags, cut at tags of blocks: enough for the test pages, whose articles hold no other parts."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    cut = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
    plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", c)).split()) for c in cut]
    return "\n".join(p for p in plain if p)


def test_query_against_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op11_html_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        want = article(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("   \n", ""),
        ("no markup at all", "no markup at all"),
        ("<p>a &lt; b &amp;amp; c&nbsp;&#100; &copy 1 &nonsense;</p>", "a < b &amp; c d © 1 &nonsense;"),
        ("<p>1 < 2 and 3 <4 <- 5</p>", "1 < 2 and 3 <4 <- 5"),
        ("<article><p>one<br>two\n  three<p>four<b>five</b>six</article>", "one two three\nfourfivesix"),
        ("<article><p>x<script>var a = '</p><p>no';</script>y<style>p{}</style><!-- no --> z</p></article>", "xy z"),
        ("<article><h1>Head</h1><p>Short.</p><p>A.</p></article><p>" + LONG, "Head\nShort.\nA."),
        ("<main><nav><a href=/>Home</a></nav><h1>Head</h1><p>" + LONG + "</p></main>", "Head\n" + LONG),
        ("<article><p>in</p><aside>no</aside><form>no <input value='no'></form><div class='cookie-notice'>no</div><p>out</p></article>", "in\nout"),
        ("<article><header><h1>Head</h1><div>by someone</div></header><p>x</p><footer>no</footer></article>", "Head\nx"),
        ("<header><h1>Site</h1></header><article><p>x</article><ol class='comment-list'><li><article>A reader.</article></ol>", "x"),
        ("<body class='has-sidebar'><article class='post with-comments'><p>x <span class=ad>buy</span>y</p></article>", "x y"),
        ("<article><p>x</p><ul><li><a href=/a>One more</a><li><a href=/b>And more</a></ul><p>y</p></article>", "x\ny"),
        ("<article><p>before <a title=\"a > b\" href='/x'>link</a> after</p><p id=\"unclosed>z</p></article>", "before link after\nz"),
        ("<article><p>x</p><div hidden>no</div><div style='display: none'>no</div><p>y", "x\ny"),
        ("<article>text<!-- never ends <p>no", "text"),
        ("<article>text<script>never ends <p>no", "text"),
        ("<article>text<p class='cut", "text"),
        ("<div id=top><a href=/>Home</a></div><h1>Head</h1><div>" + 2 * LONG + "</div><p>End.</p><div>© 2020</div>", "Head\n" + 2 * LONG + "\nEnd."),
        ("<ARTICLE><P>X</P></ARTICLE><FOOTER>no</FOOTER>", "X"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
        ("<article><p>a<br><br>b</p></article>", "a\nb"),
        ("<p> wide space\t</p>", "wide space"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_every_kept_character_stands_in_the_page():
    """Texts of marked articles come back whole, whatever inline markup breaks them."""
    rng = random.Random(5)
    for _ in range(300):
        lines = [" ".join("".join(rng.choice("abc é<&>\"'") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        body = "".join(f"<{t}>" + html.escape(x).replace(" ", rng.choice([" ", "  ", "\n", " <b></b>"])) + f"</{t}>" for x, t in ((x, rng.choice(["p", "h2", "div", "li"])) for x in lines))
        page = f"<html><nav><a href=/>a</a></nav><article>{body}</article><footer>no</footer></html>"
        assert main_text(page) == "\n".join(" ".join(x.split()) for x in lines if x.split())


def test_open_blocks_follow_their_neighbours():
    menu = "<div><a href=/a>One</a> <a href=/b>Two</a></div>"
    page = f"{menu}<div>Near the menu</div>{menu}<div>{2 * LONG}</div><p>Near the text</p><div>{2 * LONG}</div>"
    assert main_text(page) == f"{2 * LONG}\nNear the text\n{2 * LONG}"


def test_unknown_language_is_judged_by_length():
    words = " ".join(["kalimera"] * 60)
    assert main_text(f"<div><a href=/>a b</a></div><div>{words}</div>") == words


def test_time_grows_with_the_page():
    for piece in ("<div>", '<a title="x>', "<p don't>", "='", "<b", "</p>", "<!-", "<li>", "&amp", "<p><b>", "<div class=ad>"):
        main_text(piece * 20_000)  # takes minutes if it is quadratic


def test_odd_tables(spark):
    rows = [(1, None, None, "k"), (1, "u", "<p>x", "k"), (1, "u", "<p>x", "k"), (None, "u", "", "k"), (2, "u", "<article>" + "<p>word word</p>" * 50_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `_page` string").withColumn("c0", F.lit("mine"))
    got = extract(pages, keep=["page_id", "url", "_page", "c0"]).collect()
    assert len(got) == 5 and {r.c0 for r in got} == {"mine"}
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 1, 50_000 * 10 - 1]
    assert extract(pages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="rename"):
        extract(pages.withColumn("text", F.lit("")), keep=["text"])


def test_blocks_say_where_they_stand():
    found = blocks("<main><p>a</p><article><h2>b</h2></article></main><nav>c</nav>")
    assert [(b.text, b.container, b.heading, b.aside) for b in found] == [("a", 1, False, False), ("b", 2, True, False), ("c", 0, False, True)]

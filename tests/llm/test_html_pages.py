"""Main text of malformed pages, and of whole test pages against their article."""

import html
import re
import time

import pytest

from tests.llm import brute
from veilspark.llm import html_extract

FIRST = "The first paragraph of the story has enough plain words in it to read as prose, with a stop."
REST = "The second one goes on about the same thing for as long, and it ends the story, more or less."


def page(broken: str) -> str:
    return f'<html><head><title>t</title></head><body><nav><a href="/">Home</a> <a href="/b">More</a></nav><article><h1>A heading</h1><p>{FIRST}</p>{broken}<p>{REST}</p><p>{FIRST}</p></article><footer>&copy; nobody</footer></body></html>'


BROKEN = [
    "<img alt=John's>", '<img alt=5">', '<img alt="never closed><br>', "<select><option>1<option>2", "<select name=a>", '<object data="x.swf"><param name=a>', "<object><object></object>", "<svg><path d='M0'/>", "<svg viewBox=x><g>", "<script>var a = 1;",
    "<style>p{margin:0}", "<noscript>", "<template>", "<template><noscript></template>", "<!-- never closed", "<!-->", "<!--->", "<!-- closed -- > -->", "<?php echo 1 ?>", "<svg><foreignObject><p>inside</p></foreignObject></svg>", "<svg/>", "<textarea>", "<iframe>", "<select><option>1</select>", "<object>plug in<object>again</object></object>",
    "<script>if (a < b) document.write('<b>x</b>')</script>", "</div></section></li>", "<p", "<a href=x", "< 5 and > 3",
]


@pytest.mark.parametrize("broken", BROKEN)
def test_malformed_pages_keep_their_article(broken):
    (text,) = html_extract.extract([page(broken)], html_extract.trained())
    assert text.startswith("A heading " + FIRST) and text.count(FIRST) == 2, text
    # a tag without its end takes the start tag after it along, never its text
    assert REST in text and "Home" not in text and "nobody" not in text and "margin" not in text and "var a" not in text and "plug in" not in text and "inside" not in text, text


def test_hidden_content_is_read_in_linear_time():
    trees = html_extract.trained()
    for part in ("<object>", "<svg>", "<select>", "<script>", "<noscript><p>", "<svg><foreignObject>", "</x>", "<b>", "<!--", '<a b="'):
        began = time.perf_counter()
        html_extract.parse(part * 20_000)
        assert time.perf_counter() - began < 10, part
    assert html_extract.extract(["<svg>" * 3000 + f"<p>{FIRST}</p>"], trees) == [FIRST]


def articles(spark, folder):
    """(page, what a plain reading of its <article> gives)."""
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|li|ul|div)\b[^>]*>", inner)
        yield r, " ".join(t for b in blocks if (t := re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", "\n", b)))).strip()))


def test_whole_test_pages_equal_their_article(spark):
    from veilspark.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op4_html_extraction"](spark, folder).collect()}
    pages = list(articles(spark, folder))
    assert len(got) == len(pages) > 200
    for r, want in pages:
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_columns_may_clash(spark):
    pages = brute.table(spark, [(1, "u", f"<p>{FIRST}</p>", "mine", "k0")], "page_id long, url string, html string, text string, k0 string")
    assert [tuple(r) for r in html_extract.extract_main_text(pages, keep=("k0", "page_id")).collect()] == [("k0", 1, FIRST, len(FIRST))]

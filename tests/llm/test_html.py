"""HTML extraction: parsing, exact marginals, held-out pages and odd rows."""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pytest

from famloom.llm import html_text, queries
from famloom.llm.labelled_pages import labelled_pages

SCHEMA = "page_id bigint, url string, html string, text string, n_chars string, main string"


def article_of(page):
    inside = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page, re.S)[1]
    inline = re.sub(r"</?(b|i|a)\b[^>]*>", "", inside)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inline)).split())


def test_query_finds_the_articles(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op12_html_text"](spark, folder).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        assert row.url == pages[row.page_id].url and row.n_chars == len(row.text)
        assert row.text == article_of(pages[row.page_id].html)


def test_held_out_layouts():
    held = labelled_pages(200, seed=99)
    texts = html_text.main_texts(held, html_text.default_model())
    right = 0
    for page, text in zip(held, texts):
        tree = html_text.parse(page)
        right += text == html_text.main_text(tree, [y == 1 and not n for y, n in zip(tree.label, tree.never)])
    assert right >= 180  # whole pages, to the letter


def test_marginals_are_exact():
    model = html_text.default_model()
    tree = html_text.parse("<div class=nav><a>x y</a>z</div><p>some words. <b>more</b></p>")
    woods = html_text.forest([tree], model.names)
    count = len(tree.parent)
    unary = np.bincount(woods.rows, weights=model.weights[woods.columns], minlength=count)
    total, ones = 0.0, np.zeros(count)
    for labels in itertools.product((0, 1), repeat=count):
        score = sum(unary[i] for i in range(count) if labels[i])
        score += sum(model.edges[woods.kind[i], labels[woods.parent[i]], labels[i]] for i in range(1, count))
        total += np.exp(score)
        ones += np.exp(score) * np.array(labels)
    got, joint = html_text.marginals(woods, model.weights, model.edges)
    assert np.allclose(got, ones / total) and np.allclose(joint[1:, :, 1].sum(axis=1), got[1:])


@pytest.mark.parametrize(
    "page,texts",
    [
        ("<p>a<p>b<b>c</b>d<br>e", ["a", "b", "c", "d\n", "e"]),
        ("<script>x='</p>'</script>y<style>z", ["y"]),
        ("1 < 2 &amp; 3&nbsp;<a title='a>b'>x</a><!-- no --><![CDATA[no]]>", ["1 ", "< 2 & 3\xa0", "x"]),
        ("a<div cla", ["a"]),
        ("<title>no</title><textarea>no</TEXTAREA >yes", ["yes"]),
        ("<ul><li>a<li>b</ul></b></p>c", ["a", "b", "c"]),
        ("<p title=it's>a</p><p title='x>b", ["a", "b"]),
    ],
)
def test_parse(page, texts):
    tree = html_text.parse(page)
    assert "".join(t for t in tree.text) == "".join(texts)
    assert all(p < i for i, p in enumerate(tree.parent))


def test_list_items_and_paragraphs_close():
    tree = html_text.parse("<div><p>a<b>b<p>c<table><tr><td><p>d<td>e</table></div>f")
    by_text = {t: tree.tag[tree.parent[i]] for i, t in enumerate(tree.text) if t}
    assert by_text == {"a": "p", "b": "b", "c": "p", "d": "p", "e": "td", "f": "#page"}


def test_odd_rows(spark):
    long = "<article><h1>T</h1>" + "<p>Word and word again, in a long page.</p>" * 60_000 + "</article>"
    deep = "<div>" * 5_000 + "<p>Down here.</p>"
    rows = [
        (1, "u", None, "x", "y", "z"), (2, None, "", None, None, None), (None, None, None, None, None, None),
        (3, "u", "<nav>a</nav><form>b</form><script>c</script>", "", "", ""),
        (4, "u", long, "", "", ""), (4, "u", long, "", "", ""), (5, "u", deep, "", "", ""),
        (6, "u", "<<<>>&#0;&#x110000;</", "", "", ""),
        (7, "u", "<nav>Home</nav><article><p>Caf&eacute;\n &amp;\t<i>b</i>ar.</p><p>Two.</p></article>", "", "", ""),
    ]
    got = html_text.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and [r.page_id for r in got] == [r[0] for r in rows]
    texts = [r.text for r in got]
    assert texts[:4] == [""] * 4 and texts[8] == "Café & bar. Two."
    assert texts[4] == texts[5] == "T" + " Word and word again, in a long page." * 60_000
    assert html_text.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0

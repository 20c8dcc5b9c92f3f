"""Main texts of pages: whole pages of several makes, single rules, odd input."""

from __future__ import annotations

import pytest
from tessera.llm.main_text import main_text, main_texts

P = ["The first paragraph is long enough, has commas, and says something.", "A second one follows, which is shorter.", "And the third ends it, after some more words, as it must."]
ALL = " ".join(P)
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in P)
NOISE = "Much longer than the article, with commas, and commas, and still more of them, on and on, " * 5


def test_named_article_wins_over_longer_text():
    page = f"<body><nav><ul><li><a href=/a>A</a></ul></nav><div class=x><p>{NOISE}</p></div><article><h1>T</h1><p>Short.</p></article><footer>{NOISE}</footer>"
    assert main_text(page) == "T Short."
    assert main_text(f"<article></article><div class=ad>{NOISE}</div>") == ""


@pytest.mark.parametrize(
    "noise",
    [
        f"<aside><p>{NOISE}</p></aside>", f"<div id='comments'><p>{NOISE}</p></div>", f"<section class='user-comments'><article><p>{NOISE}</p></article></section>",
        f"<div class=leftSidebar><p>{NOISE}</p></div>", f"<form><p>{NOISE}</p></form>", f"<div role=alert>{NOISE}</div>", f"<div style='display: none'>{NOISE}</div>",
        f"<header><p>{NOISE}</p></header>", f"<div class='ad banner'>{NOISE}</div>", f"<script>document.write('<p>{NOISE}</p>')</script>", f"<!-- <p>{NOISE}</p> -->",
        f"<div class=cookie-notice><div><p>{NOISE}</p></div></div>", f"<div hidden>{NOISE}</div>", f"<style>p {{ {NOISE} }}</style>", f"<noscript>{NOISE}</noscript>",
    ],
)
@pytest.mark.parametrize("page", ["<main>{a}</main>{n}", "{n}<div id=content>{a}</div>", "<div><div>{a}</div></div>{n}", "<div id=content>{a}{n}</div>", "{n}{a}"])
def test_what_is_no_article_goes(page, noise):
    assert main_text("<html><head><title>t</title></head><body class='has-sidebar no-comments'>" + page.format(a=PARAGRAPHS, n=noise)) == ALL


def test_scoring_without_names():
    menu = "".join(f"<li><a href=/{i}>A link with a long name, number {i}</a></li>" for i in range(30))
    page = f"<div><ul>{menu}</ul></div><div><div>{PARAGRAPHS}</div><div><p>{P[0]} Beside it, as long.</p><p>{P[1]}</p></div></div><div>Imprint</div>"
    assert main_text(page) == f"{ALL} {P[0]} Beside it, as long. {P[1]}"  # a sibling with enough points stays
    assert main_text(f"<div><h1>Title</h1><div>{PARAGRAPHS}</div><div><a href=x>Back, and so on</a></div></div>") == f"Title {ALL}"
    related = "".join(f"<li><a href=/{i}>See {i}</a>" for i in range(5))
    assert main_text(f"<main>{PARAGRAPHS}<ul>{related}</ul><ul><li>one point<li>two</ul><table><tr><td>a<td>b</table></main>") == f"{ALL} one point two a b"


def test_text_of_blocks():
    assert main_text("<article><p>a&amp;amp; &lt;b&gt; &eacute;&#233;&nbsp;x<br>y\n\t z<b>bo</b>ld<p>next</article>") == "a&amp; <b> éé x y zbold next"
    assert main_text("<article><header><h2>Head</h2></header><p>x<footer>y</footer></article>") == "Head x"
    assert [main_text(x) for x in (None, "", " \n", "<p></p>", "<html><body></body></html>")] == [""] * 5
    assert main_text("plain, without any tag &lt;") == "plain, without any tag <"
    assert main_text("<article><p>cut off <a href='x") == "cut off"


def test_long_and_deep_pages_take_linear_time():
    assert main_text("<div>" * 50_000 + PARAGRAPHS) == ALL
    assert main_text("<article>" + "<p>x, y. " * 100_000) == " ".join(["x, y."] * 100_000)
    for odd in ("<a<a" * 50_000, '<a "' * 50_000, "<!--" * 50_000, "<td><li><ul>" * 20_000, "<b>" * 50_000 + "<p>" * 50_000, "&" * 100_000, "<" * 100_000):
        main_text(odd)


def test_query_over_rows(spark):
    rows = [(1, "u", f"<article>{PARAGRAPHS}</article>"), (1, "u", f"<article>{PARAGRAPHS}</article>"), (None, None, None), (2, "", ""), (3, "v", "<p>" + "é𝄞" * 500_000)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [tuple(r) for r in main_texts(df, "page_id", "url").collect()]
    assert sorted(got, key=str) == sorted([(1, "u", ALL, len(ALL))] * 2 + [(None, None, "", 0), (2, "", "", 0), (3, "v", "é𝄞" * 500_000, 1_000_000)], key=str)
    out = main_texts(df.limit(0), "page_id", "url")
    assert out.collect() == [] and out.columns == ["page_id", "url", "text", "n_chars"]

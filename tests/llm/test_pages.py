"""Main texts of hand-made pages: readers' comments, sidebars, tables, lists, broken markup, empty tables."""

import pytest

from claimforge.llm import html_text

STORY = "<p>The story begins, as stories do, with a long and winding sentence.</p>" * 3
TOLD = "\n\n".join(["The story begins, as stories do, with a long and winding sentence."] * 3)
SAID = "<p>A reader says something, at length, and again, and again.</p>" * 40

WITHOUT_READERS = {
    "article comments in the article": f"<article class=story>{STORY}<section id=comments><article class=comment>{SAID}</article></section></article>",
    "plain articles in comments": f"<article>{STORY}</article><section id=comments><article>{SAID}</article></section>",
    "story in a div": f"<div class=story>{STORY}</div><section id=comments><article>{SAID}</article></section>",
    "heading in comments": f"<div class=story>{STORY}</div><div class=comments><h1>Comments</h1>{SAID}</div>",
    "responses": f"<article>{STORY}</article><div class=responses>{SAID}</div>",
    "discussion": f"<article>{STORY}</article><div class=discussion>{SAID}</div>",
    "thread": f"<div>{STORY}</div><div id=disqus_thread>{SAID}</div>",
    "list": f"<article>{STORY}</article><ol class=comment-list><li class='comment depth-1'>{SAID}</li></ol>",
    "comment as article alone": f"<main>{STORY}<article class='comment even'>{SAID}</article></main>",
    "sidebar longer": f"<article>{STORY}</article><div class=sidebar>{SAID}</div>",
    "sidebar with heading": f"<article>{STORY}</article><div class=sidebar><h1>x</h1>{SAID}</div>",
    "sidebar with article": f"<article>{STORY}</article><div class=sidebar><article>{SAID}</article></div>",
    "page with comments": f"<div class='page-with-comments'><article>{STORY}</article><div class=comments>{SAID}</div></div>",
}
KEPT = {
    "comments open": f"<article class='post comments-open'>{STORY}</article>", "layout": f"<div class='sidebar-layout'><article>{STORY}</article></div>",
    "widget alone": f"<div class='widget'>{STORY}</div>", "with comments": f"<div class='with-comments'>{STORY}</div>", "no comments": f"<div class='no-comments'>{STORY}</div>",
    "unclosed": f"<article>{STORY}", "no body": STORY, "upper case": f"<ARTICLE>{STORY.replace('<p>', '<P>')}</ARTICLE>", "stray ends": f"</div></p><div>{STORY}</section></div>",
}


@pytest.mark.parametrize("name", WITHOUT_READERS)
def test_readers_and_sidebars_are_left_out(name):
    assert html_text.main_text(f"<html><body>{WITHOUT_READERS[name]}</body></html>") == TOLD


@pytest.mark.parametrize("name", KEPT)
def test_articles_stay(name):
    assert html_text.main_text(KEPT[name]) == TOLD


def test_blocks_of_an_article():
    page = f"<article><h1>Head</h1>{STORY}<section id=discussion><p>We talk it over, at length.</p></section><ul><li>one</li><li>two</li></ul><table><tr><td>a<td>b</table><pre>x\n  y</pre></article>"
    assert html_text.main_text(page).split("\n\n") == ["Head", *TOLD.split("\n\n"), "We talk it over, at length.", "one", "two", "a b", "x y"]


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text long, n_chars string"
    assert html_text.extract_main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, f"<p>{'x' * 50}</p>", 1, "a"), (1, "u", None, None, None), (1, "u", None, None, None), (2, "u", "<p>" + "word, " * 100_000, 1, "b")]
    got = html_text.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.n_chars, len(r.text)) for r in got) == [(False, 1, 0, 0), (False, 1, 0, 0), (False, 2, 599_999, 599_999), (True, 0, 50, 50)]

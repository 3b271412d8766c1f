"""Pages of op4 that the given ones don't show."""

import pytest

from latecomer.llm import html_text


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>t</title><body><article><p>text here</p></article>", "text here"),
    ("<head><meta charset=x><script>var a</script><article><p>text here</p></article>", "text here"),
    ("<head><title>t</title>text here", "text here"),
    ("<head><title>t</title></head><body><p>text here", "text here"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>",
     "so x = 2 holds")])
def test_open_heads_and_formulas(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("name", ["related-work", "how-to-share-files", "naval-history", "promotion", "social-impact",
                                  "search", "consent", "comments-on-method"])
def test_ids_made_from_titles_drop_nothing(name):
    page = f"<article><p>first part</p><section id={name}><h2 id={name}>Title</h2><p>second part</p></section></article>"
    assert html_text.main_text(page) == "first part Title second part"
    page = f"<main><p>first part</p><div class=post-header>Title</div><h2 id={name} class=header>Two</h2></main>"
    assert html_text.main_text(page) == "first part Title Two"


def test_names_of_boilerplate_still_drop():
    page = ("<div id=site-nav>n</div><div class=sponsored>s</div><article><p>first part</p><div class='box ad'>a</div>"
            "<section class=comments><p>c</p></section></article>")
    assert html_text.main_text(page) == "first part"

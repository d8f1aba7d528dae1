"""Article text under furniture words and outside one container."""

import pytest

from fleetgauge.llm import html

LONG = "This is a long paragraph of an article with many words and without any markup in it."
MORE = "Another part of the same article that goes on for some more words than a heading has."


@pytest.mark.parametrize("open_, close", [
    ("<html class='no-cookie'><body>", "</body></html>"), ("<body class='has-sidebar'>", "</body>"), ("<body><main class='no-comments'>", "</main></body>"),
    ("<body><div id='page-with-menu'>", "</div></body>"), ("<body><div id='page-with-menu'><div class='content with-sidebar'>", "</div></div></body>")])
@pytest.mark.parametrize("article", ["article", "section", "div"])
@pytest.mark.parametrize("label", ["", " class='post-sidebar'"])
def test_furniture_words_around_articles(open_, close, article, label):
    page = (f"{open_}<nav>Home</nav><{article}{label}><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></{article}>"
            f"<div class='related-posts'>Read this too</div>{close}")
    assert html.main_text(page) == f"Title\n{LONG}\n{MORE}"


@pytest.mark.parametrize("page", [
    "<article><div class='post-header'><h1>T</h1><p>by me</p></div><p>{0}</p></article>",
    "<article><header><div><h1>T</h1></div><nav><h2>N</h2></nav></header><p>{0}</p></article>",
    "<body><div class='post-header'><h1>T</h1><p>by me</p></div><div>{0}</div></body>"])
def test_titles_in_headers(page):
    assert html.main_text(page.format(LONG)) == f"T\n{LONG}"


@pytest.mark.parametrize("page, want", [
    ("<body><h1>Title</h1><div>{0}{0}</div></body>", "Title\n{0}{0}"),
    ("<body><p>Lead.</p><div>{0}{0}</div><p>End.</p></body>", "Lead.\n{0}{0}\nEnd."),
    ("<body><div>{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}</div><div>{1}</div></body>", "{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}{0}\n{1}"),
    ("<main><h1>Title</h1><article><p>{0}</p></article></main>", "Title\n{0}"),
    ("<article><p>{0}</p></article><article><p>{0}</p></article>", "{0}\n{0}"),
    ("<main><p>{1}</p><article><p>{0}</p><p>{0}</p></article></main>", "{1}\n{0}\n{0}"),
    ("<body><ul><li><a href='x'>Home</a></li></ul><div><h1>Title</h1><p>{0}</p></div></body>", "Title\n{0}")])
def test_text_outside_one_container(page, want):
    assert html.main_text(page.format(LONG, MORE)) == want.format(LONG, MORE)

"""Hand-written page shapes: what is article, what is furniture, and what the clusters decide."""

import numpy as np
import pytest

from fleetgauge.llm import html

P = "This is a long paragraph of an article with many words and without any markup in it."
Q = "Another part of the same article that goes on for some more words than a heading has."
C = "I do not agree with what was said above and here is my own long view of the matter, as a reader."
NAV = "<div><a href='/'>Home</a></div><div><a href='/n'>News</a></div><div><a href='/c'>Contact</a></div>"
STUBS = "".join(f"<div><span>{word}</span></div>" for word in ("Home", "News", "Sport", "12 views", "Print"))
COOKIES = "This website uses cookies so that we can give you the best experience on all of our pages."
BODY = f"<h1>Title</h1><p>{P}</p><p>{Q}</p>"
WANT = f"Title\n{P}\n{Q}"

SHAPES = {
    # Reader comments, also where they are longer than the article.
    "comments inside": f"<article>{BODY}<section class='comments'><p>{C}</p></section></article>",
    "long comments inside": f"<article>{BODY}<section class='comments'>{f'<p>{C}</p>' * 9}</section></article>",
    "comments beside": f"<body><article>{BODY}</article><div class='comments'>{f'<p>{C}</p>' * 9}</div></body>",
    "comment list": f"<body><div>{BODY}</div><ol class='comment-list'>{f'<li><p>{C}</p></li>' * 9}</ol></body>",
    "comment articles": f"<main><article>{BODY}</article>{f'<article class=comment><p>{C}</p></article>' * 5}</main>",
    "comments by id": f"<body><div id='text'>{BODY}</div><div id='disqus_thread'><p>{C}</p></div></body>",
    "comments by heading": f"<article>{BODY}<h2>3 Comments</h2>{f'<p>{C}</p>' * 3}</article>",
    "comments by heading in a section": f"<article>{BODY}<section><h3>Kommentare</h3>{f'<div><p>{C}</p></div>' * 3}</section></article>",
    "reply form": f"<article>{BODY}<div id='respond'><form><label>Name</label><input><textarea></textarea></form></div></article>",
    # Notices.
    "cookies in a plain block": f"<body><div><p>{COOKIES}</p></div><article>{BODY}</article></body>",
    "cookies without an article": f"<body><div><p>{COOKIES}</p></div><div>{BODY}</div></body>",
    "cookies as a paragraph": f"<body><p>{COOKIES}</p><div>{BODY}</div></body>",
    "copyright in a plain block": f"<body><div>{BODY}</div><div>© 2020 The Company and its partners, all rights reserved in every land.</div></body>",
    "marked notice": f"<body><div class='notice'>Our office stays closed today.</div><article>{BODY}</article></body>",
    "newsletter": f"<article>{BODY}<div class='newsletter-signup'><p>Get all the news of the week by mail.</p></div></article>",
    # Menus, adverts and the like.
    "menu without words": f"<body>{NAV}<div>{BODY}</div></body>",
    "menu below": f"<body><div>{BODY}</div>{NAV}</body>",
    "tagged menu": f"<body><nav>{NAV}</nav><div>{BODY}</div><footer>{P}</footer></body>",
    "advert inside": f"<article><h1>Title</h1><p>{P}</p><div class='ad-leaderboard'><p>{C}</p></div><p>{Q}</p></article>",
    "advert paragraph": f"<article><h1>Title</h1><p>{P}</p><p class='advert'>Buy now</p><p>{Q}</p></article>",
    "advert longer than the article": f"<body><div class='ad'>{C * 5}</div><article>{BODY}</article></body>",
    "sidebar": f"<body><div class='left-sidebar'><p>{C}</p></div><div>{BODY}</div></body>",
    "related posts": f"<article>{BODY}<div class='related-posts'><p>Read this too</p></div></article>",
    "search form": f"<body><form><label>Search</label><input></form><article>{BODY}</article></body>",
    "script and style": f"<article><style>p {{}}</style><h1>Title</h1><script>var a = '<p>x';</script><p>{P}</p><p>{Q}</p></article>",
    "hidden": f"<article>{BODY}<p hidden>{C}</p></article>",
    # Articles under words and forms that mark nothing here.
    "page in a form": f"<body><form action='x'><div>{BODY}</div></form></body>",
    "page in a form with an article": f"<body><form><article>{BODY}</article><label>Name</label></form></body>",
    "open comments": f"<body class='comments-open'><div class='has-comments'>{BODY}</div></body>",
    "article called comments": f"<body><div class='comments'>{BODY}</div></body>",
    "plain": BODY,
    "two blocks": f"<body><div><h1>Title</h1><p>{P}</p></div><div><p>{Q}</p></div></body>",
    "title in a block": f"<body><div><h1>Title</h1></div><div><p>{P}</p><p>{Q}</p></div></body>",
    "title above the article": f"<body><h1>Title</h1><article><p>{P}</p><p>{Q}</p></article></body>",
    # Blocks that no word and no link tells apart.
    "menu of buttons": f"<body>{STUBS}<div>{BODY}</div></body>",
    "stubs below": f"<body><div>{BODY}</div>{STUBS}</body>",
    "stubs on both sides": f"<body>{STUBS}<div><div>{BODY}</div></div>{STUBS}</body>",
    "stubs in a table": f"<table><tr><td>{STUBS}</td><td>{BODY}</td></tr></table>",
    "stubs in sections": f"<div><section>{STUBS}</section><section>{BODY}</section></div>",
    "table": f"<table><tr><td>{NAV}</td><td>{BODY}</td></tr></table>",
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    assert html.main_text(SHAPES[name]) == WANT


@pytest.mark.parametrize("inner, want", [
    (f"<div class='related-work'><p>{C}</p></div>", C), (f"<section id='discussion'><p>{C}</p></section>", C), ("<p class='alert'>Mind the gap.</p>", "Mind the gap."),
    ("<p>Some <label>labelled</label> words.</p>", "Some labelled words."), ("<p>A <span class='notice'>marked</span> word.</p>", "A marked word."),
    ("<p>Ok.</p>", "Ok."), ("<ul><li>one</li><li><a href='x'>two</a></li></ul>", "one\ntwo"), (f"<p>{COOKIES}</p>", COOKIES),
    ("<div><div><p>Short.</p></div></div>", "Short.")])
def test_article_text_stays(inner, want):
    assert html.main_text(f"<body>{NAV}<article>{BODY}{inner}</article></body>") == f"{WANT}\n{want}"


@pytest.mark.parametrize("replaced", [lambda v: np.ones(len(v), bool), lambda v: np.arange(len(v)) % 2 == 0])
def test_clusters_decide(monkeypatch, replaced):
    pages = [SHAPES[n] for n in ("menu of buttons", "stubs below", "stubs on both sides", "stubs in a table", "stubs in sections")]
    monkeypatch.setattr(html, "_upper_cluster", replaced)
    assert sum(html.main_text(page) != WANT for page in pages) == len(pages)

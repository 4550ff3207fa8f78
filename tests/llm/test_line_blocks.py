"""Main text of hand-made pages."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pytest

from paceline.llm.line_blocks import extract_main_text, main_text, page_lines, stretches_of

MAIN = "This is the first paragraph of the story, long enough to carry some weight of its own.", "And here comes the second &amp; last one, which is about as long as the other."
TEXT = "\n".join(MAIN).replace("&amp;", "&")
BODY = "".join(f"<p>{x}</p>" for x in MAIN)
MENU = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Item number {k} of the menu</a></li>" for k in range(9)) + "</ul></nav>"

PAGES = {
    "article": (f"<html><head><title>T</title><style>p{{a:b}}</style></head><body>{MENU}<div class='ad'>Buy now this thing that is so good for you.</div><article><h1>Title</h1>{BODY}</article><footer>&copy; us</footer></body></html>", f"Title\n{TEXT}"),
    "no article": (f"<body><header>Our site</header>{MENU}<div id='content'>{BODY}</div><div class='side-bar'><p>Something else entirely, at some length.</p></div><footer>&copy; all of it</footer>", TEXT),
    "comments": (f"<main>{BODY}<section id='comments'><article class='comment'>What a fine story this is, I say!</article></section></main>", TEXT),
    "form and notice": (f"<main><p class='cookie-notice'>We use cookies.<p>{MAIN[0]}<form><label>Name</label><input></form><aside>Related</aside><p>{MAIN[1]}</main>", TEXT),
    "script with markup": (f"<article>{BODY}<script>var t='</p><p>not text';</script></article>", TEXT),
    "unclosed": (f"<article><p><b>{MAIN[0]}<br><p>{MAIN[1]}<script>x", TEXT),
    "links in a text": (f"<article><p>{MAIN[0]} <a href=x>With a link.</a></p></article>", f"{MAIN[0]} With a link."),
    "header of the article": ("<article><header><h1>Head</h1></header><p>Body.</p></article>", "Head\nBody."),
    "white space and references": ("<p> a \n\t b&nbsp;c &lt;d&gt; &#233;&#x41; &unknown; </p>", "a b c <d> éA &unknown;"),
    "comparison signs": ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    "quoted markup": ("<p title='a > b'>x</p>", "x"),
    "hidden": ("<p>x</p><div hidden>y</div><div aria-hidden='true'>z</div><div style='a'>w</div>", "x\nw"),
    "comment never closed": ("<p>x</p><!-- y", "x"),
    "menu of links alone": ("<div>" + "<p><a>some link or other</a></p>" * 5 + f"</div>{BODY}", TEXT),
    "short lines within": (f"<article><p>{MAIN[0]}</p><p>Yes.</p><div class=ad>no</div><p>No.</p><p>{MAIN[1]}</p></article>", TEXT.replace("\n", "\nYes.\nNo.\n")),
    "empty": ("", ""),
    "markup alone": ("<html><body><br><hr></body></html>", ""),
    "plain": ("just words", "just words"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, wanted = PAGES[name]
    assert main_text(page) == wanted


COMMENTS = "".join(f"<li><article class='comment'><p>What a fine story this is, say I, who am reader number {k} of all.</p></article></li>" for k in range(9))
MORE_PAGES = {
    "wrapped in a form": (f"<form action=x>{MENU}<input type=hidden><div>{BODY}</div><footer>&copy; us all, and all of it</footer></form>", TEXT),
    "menu never closed": (f"<nav><ul><li><a href=x>Home</a></ul>{BODY}<p>{MAIN[0]}</p>", f"{TEXT}\n{MAIN[0]}"),
    "comments as articles": (f"<div class='post'>{BODY}</div><ol class='comment-list'>{COMMENTS}</ol>", TEXT),
    "comments alone": (f"<section id=comments><p>{MAIN[0]}</p></section>", MAIN[0]),
    "teaser as article": (f"<div>{BODY * 3}</div><article><h3><a href=x>Another story</a></h3><p>In short words.</p></article>", "\n".join([TEXT] * 3)),
    "quotes in attributes": (f"<p data-x=it's>{MAIN[0]}</p><p>{MAIN[1]}</p><p class=\"a\"\">{MAIN[0]}</p>", f"{TEXT}\n{MAIN[0]}"),
    "linked heading and paragraph": (f"<div><h2><a href=x>A linked heading</a></h2>{BODY}<p><a href=y>A paragraph that is a link</a></p></div>", f"A linked heading\n{TEXT}\nA paragraph that is a link"),
    "formula and button": (f"<p>{MAIN[0]} <math><mi>x</mi></math> and <button>press</button> it.</p>", f"{MAIN[0]} x and press it."),
    "button by itself": (f"<div>{BODY}<button>Submit now</button></div>", TEXT),
    "name that hints": (f"<div class='section-social'>{BODY}</div><div>{BODY}{BODY}</div>", "\n".join([TEXT] * 3)),
    "name that hints at a menu": (f"<div class='menu-text'>{BODY}</div><div>{BODY}</div>", f"{TEXT}\n{TEXT}"),
    "advert in a list left open": (f"<div><p>{MAIN[0]}<ul><li>One item of the list is here.<li class=ad>Buy this.<li>Another item is here.</ul></div>", f"{MAIN[0]}\nOne item of the list is here.\nAnother item is here."),
    "short article, long footer": (f"<article><h1>Head</h1></article><footer>{MAIN[0]}</footer>", "Head"),
    "long notice": (f"<div class='cookie-notice'>{BODY}</div><p>A short word, that is all.</p>", "A short word, that is all."),
    "cells left open": (f"<table><tr><td>{MAIN[0]}<td class=ad>Buy this now, it is good.<tr><td>{MAIN[1]}</table>", TEXT),
    "end tag inside a cell": (f"<div class=ad><table><tr><td></div>Buy this now.</table></div>{BODY}", TEXT),
    "select never closed": (f"<p>{MAIN[0]}</p><select><option>a<p>{MAIN[1]}</p>", f"{MAIN[0]}\na\n{TEXT.splitlines()[1]}"),
}


@pytest.mark.parametrize("name", MORE_PAGES)
def test_more_pages(name):
    page, wanted = MORE_PAGES[name]
    assert main_text(page) == wanted.replace("&amp;", "&")


MEGABYTE = {
    "cells": "<table><tr>" + "<td>cell of it" * 75_000, "items": "<ul>" + "<li>one" * 140_000, "names": "<dl>" + "<dt>a<dd>b" * 100_000, "lists": "<ul><li>" * 120_000,
    "tags in tags": "<b " * 330_000 + "'", "quotes": '<b "' * 250_000, "open values": '<b x="' * 160_000, "attributes": "<p " + "a=b " * 250_000 + ">x", "signs": "< " * 500_000,
    "deep": "<div>" * 200_000 + "x", "stray ends": "<div>" * 100_000 + "</p></span></section>" * 24_000, "comments": "<!-- " * 200_000, "options": "<select>" * 120_000 + "x",
    "pictures": "<svg>x" * 160_000, "paragraphs": "<p>word" * 140_000, "references": "&amp" * 250_000, "asides": "<aside>x" * 120_000, "articles": "<article><h1>y" * 70_000,
}


@pytest.mark.parametrize("name", MEGABYTE)
def test_a_megabyte_of_anything_is_read_in_time(name):
    tracemalloc.start()
    began = time.process_time()
    main_text(MEGABYTE[name])
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    assert time.process_time() - began < 25  # some seconds at most; quadratic work would take minutes


def test_stretches_against_plain_sums():
    """All window sums one by one."""
    draw = random.Random(2)
    for _ in range(300):
        weights = [draw.choice([0, 0, 0, 1, 5, 90]) for _ in range(draw.randint(1, 40))]
        window, expected, run = draw.randint(1, 4), [], None
        for k in range(len(weights) + 1):
            total = sum(weights[max(0, k - window + 1) : k + 1]) if k < len(weights) else 0
            if total and run is None:
                run = k
            if not total and run is not None:
                expected.append([j for j in range(run, k) if weights[j]])
                run = None
        assert stretches_of(np.array(weights), window) == expected


def test_far_and_slight_stretches_go():
    """Without an article a stretch counts by its weight."""
    page = f"<div>Tiny one</div>{MENU}{BODY}{MENU}<div>Tiny two</div>"
    assert main_text(page) == TEXT


def test_lines_of_a_page():
    assert [x[0] for x in page_lines("<div>a<div>b</div>c</div><td>d<td>e")] == ["a", "b", "c", "d", "e"]


def test_table(spark):
    rows = [(1, "u1", PAGES["article"][0], 5), (1, "u1", PAGES["article"][0], 5), (2, None, None, 5), (None, "u3", "", 5), (4, "u4", f"<article><p>{'long words ' * 50_000}</article>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted(map(tuple, extract_main_text(pages).collect()), key=str)
    long = ("long words " * 50_000).strip()
    article = PAGES["article"][1]
    assert found == sorted([(1, "u1", article, len(article))] * 2 + [(2, None, "", 0), (None, "u3", "", 0), (4, "u4", long, len(long))], key=str)
    assert extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("attributes", [
    "class='has-sidebar'", "class='no-sidebar'", "class='content-with-sidebar'", "class='post comments-open'", "class='entry-content share-enabled'",
    "class='related-work'", "style='overflow:hidden'", "data-hidden='false'", "title='a hidden gem'", "data-role='search'", "data-x='class=ad'",
])
def test_names_that_say_something_else(attributes):
    for tag in ("div", "section", "article"):
        assert main_text(f"{MENU}<div>{BODY}</div><{tag} {attributes}>{BODY}</{tag}>" if tag != "article" else f"{MENU}<{tag} {attributes}>{BODY}</{tag}>") == (TEXT if tag == "article" else f"{TEXT}\n{TEXT}")


def test_a_name_around_most_of_the_text_is_no_sidebar():
    assert main_text(f"<div class='sidebar'><article>{BODY}</article></div><div class='ad'>Buy this now, it is good.</div>") == TEXT
    assert main_text(f"<div class='widget'>{BODY}</div><p>By them.</p><div class='main-nav'>Somewhere else</div>") == f"{TEXT}\nBy them."


def test_slight_stretches_of_prose_or_of_one_container_stay():
    """Without an article, three set-apart lines and a much longer text before them cost no closing line."""
    adverts, long = "<div class='ad'>Buy now.</div>" * 4, "".join(f"<p>{x}</p>" for x in MAIN * 8)
    wanted = "\n".join([TEXT] * 8)
    assert main_text(f"<p>A short word to begin with.</p>{adverts}{long}{adverts}<p>And that was all of it.</p>") == f"A short word to begin with.\n{wanted}\nAnd that was all of it."
    assert main_text(f"<div>{long}{adverts}<p>The end</p></div>{MENU}<div>Tiny</div>") == f"{wanted}\nThe end"

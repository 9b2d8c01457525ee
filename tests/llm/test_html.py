"""Main text of pages whose containers are named like noise or have no article."""

import time

import pytest

from tickloom.llm import html_text

LONG = "A sentence of the article, with commas, of some length, to score well. " * 4
WANT = "\n".join([LONG.strip()] * 2)
TEXT = f"<p>{LONG}</p><p>{LONG}</p>"
NOISE = '<div class="comments"><p>A reader, writes, here.</p></div>'


def test_containers_named_like_noise():
    for page in (
        f'<article class="post comments-open">{TEXT}{NOISE}</article>',
        f'<div id="page" class="has-widget"><article>{TEXT}</article>{NOISE}</div>',
        f'<main class="ad-free">{TEXT}{NOISE}</main>',
        f'<main><article class="post comments-open">{TEXT}{NOISE}</article></main>',
        f'<div class="has-widget">{TEXT}{NOISE}</div>',
    ):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == WANT


def test_noise_stays_out():
    comments = f'<div class="comments"><article class="comment"><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article></div>'
    assert html_text.main_text(f"<html><body><article>{TEXT}</article>{comments}{NOISE * 40}</body></html>") == WANT


def test_parts_of_a_text_without_article():
    page = f"<html><body><div><h2>One</h2><section>{TEXT}</section><h2>Two</h2><section><p>Short.</p></section><ul><li>Item</li></ul><table><tr><td>Cell</td></tr></table></div></body></html>"
    assert html_text.main_text(page) == f"One\n{WANT}\nTwo\nShort.\nItem\nCell"


GOOD = "<p>The first good paragraph of the article, which has commas, and is long enough to count as text.</p><p>A second good paragraph follows here, again with commas, and a number of words in it.</p>"
BOTH = "The first good paragraph of the article, which has commas, and is long enough to count as text.\nA second good paragraph follows here, again with commas, and a number of words in it."
NAV = "<nav><ul><li><a href=/a>Home page</a></li></ul></nav>"


@pytest.mark.parametrize("page, want", [
    (f"<body>{NAV}<form action=x>{GOOD}<input name=q></form></body>", BOTH),
    (f"<body>{NAV}<div class='content has-ads'>{GOOD}</div></body>", BOTH),
    (f"<body><div class='post with-related'>{GOOD}</div><div class='related-posts'><p>Other, quite other things to read, or not.</p></div></body>", BOTH),
    (f"<body><div class='entry comments-open'>{GOOD}<div class='comments'><p>I disagree, strongly, with all of it.</p></div></div></body>", BOTH),
    (f"<body><article class='post sponsored'>{GOOD}</article></body>", BOTH),
    (f"<body><div class='site sidebar-right'><div class=text>{GOOD}</div><div class=sidebar><p>Aside, with commas, and words.</p></div></div></body>", BOTH),
    (f"<body><article><header><h1>The title</h1><p>By somebody, today</p></header>{GOOD}</article></body>", f"The title\n{BOTH}"),
    (f"<body><header><h1>Site</h1><p>Our motto, which is long, and has commas.</p></header><div>{GOOD}</div><footer><p>All rights, of course, reserved.</p></footer></body>", BOTH),
    (f"<body><div class=post>{GOOD}</div><div class=comment-list>{'<p>A reader says this, and that, and more of it, at length.</p>' * 20}</div></body>", BOTH),
    (f"<body><div><h2>One</h2><section>{GOOD}</section><h2>Two</h2><section><p>short</p></section></div></body>", f"One\n{BOTH}\nTwo\nshort"),
    (f"<body><div class=cookie-notice><p>We use cookies, as all do, to know you better.</p></div><main>{GOOD}</main></body>", BOTH),
    ("<body><div class=comments><p>Only readers, no article, speak here.</p></div></body>", ""),
    (f"<script>if (a<b && c > '</p>') x = \"</div>\";</script><div>{GOOD}</div>", BOTH),
    (f"<div>{GOOD}</div><p title='a > b'>", BOTH),
])
def test_pages_without_a_bare_article(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("markup", ["<a " * 350_000, "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "</section>" * 100_000, '<a "' * 100_001 + ">", "<a '\">" * 100_001, "<b>" * 50_000 + "<p>x" * 50_000, "<!-" * 300_000, "&" * 500_000])
def test_broken_markup_is_read_in_linear_time(markup):
    began = time.process_time()
    html_text.main_text(markup)
    assert time.process_time() - began < 30  # quadratic ways take minutes to hours

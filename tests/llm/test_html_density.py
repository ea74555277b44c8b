"""Extraction: names inside and outside the article, densities against their definition, odd pages in linear time."""

import math
import random
import time

import pytest

from coppice.llm import html_density
from coppice.llm.html_density import main_text

ARTICLE = ["Title of it"] + [f"Paragraph {i} of the article, with as many words as a paragraph of a page usually has in it." for i in range(5)]
AROUND = [("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<section><article>", "</article></section>"),
          ("<div class=post>", "</div>"), ("<main><div>", "</div></main>")]


def page(opened, closed, after=""):
    return f"<html><body>{opened}<h1>{ARTICLE[0]}</h1>{''.join(f'<p>{x}</p>' for x in ARTICLE[1:])}{closed}{after}</body></html>"


@pytest.mark.parametrize("comments", [
    '<div id="comments" class="comments-area"><ol class="comment-list"><li class="comment"><article class="comment-body">{}</article></li></ol></div>',
    '<section id="comments" class="comments-area"><article class="comment-body">{}</article><article class="comment">{}</article></section>',
    "<section class=comments><article>{}</article></section>", "<div class=user-comments><p>{}</div>",
])
@pytest.mark.parametrize("around", AROUND)
def test_reader_comments_go(around, comments):
    comments = comments.replace("{}", "<p>A reader writes about it at quite some length, in more words than most of them do.</p>")
    assert main_text(page(*around, after=comments)) == "\n".join(ARTICLE)
    assert main_text(page(around[0], comments + around[1])) == "\n".join(ARTICLE)


@pytest.mark.parametrize("part", [
    '<div class="form-of-government"><p>Kept</p></div>', '<blockquote class="related-quote">Kept</blockquote>',
    '<table class="form-table"><tr><td>Kept</table>', '<figure class="ad-hoc"><p>Kept</p></figure>', '<div class="related-work"><p>Kept</p></div>',
])
@pytest.mark.parametrize("around", AROUND)
def test_parts_whose_names_only_contain_a_word_stay(around, part):
    part = part.replace("Kept", "A part of the article that is kept.")
    assert main_text(page(around[0], part + around[1])) == "\n".join([*ARTICLE, "A part of the article that is kept."])


def test_notices_in_articles_stay_and_mostly_links_go():
    assert main_text(page("<article>", "<p class=notice>Note this.</p></article>")).endswith("\nNote this.")
    for part in ("<div class='related-work'><a href=/a>Another one</a> <a href=/b>Yet another</a></div>", "<div class=ad>Buy this</div>",
                 "<div class=cookie-notice>We use cookies.</div>", "<div class='share-buttons'><p>Tell others</p></div>"):
        assert main_text(page("<article>", f"{part}</article>")) == "\n".join(ARTICLE)


def test_an_article_under_names_stays_if_it_is_the_page():
    for name in ("widget", "sidebar", "has-sidebar"):
        assert main_text(page(f"<div class={name}><article>", "</article></div>", "<div class=ad>Buy this now</div>")) == "\n".join(ARTICLE)
    teaser = "<section class=related><article><p>A teaser of quite another article of this site.</p></article></section>"
    for around in AROUND[:3]:
        assert main_text(page(*around, after=teaser)) == "\n".join(ARTICLE)
    assert main_text(page("<main>", f"{teaser}</main>")) == "\n".join(ARTICLE)


def test_an_imprint_beside_the_densest_part_goes():
    assert main_text(page("<div>", "</div>", "<div>Imprint: The Company Ltd, Some Street 5, 12345 Some Town</div>")) == "\n".join(ARTICLE)


def grown(draw, depth):
    """A random tree of (tag, parts)."""
    parts = []
    for _ in range(draw.randint(1, 4)):
        kind = draw.random()
        if depth and kind < 0.6:
            parts.append(("div", grown(draw, depth - 1)))
        elif kind < 0.75:
            parts.append(("a", ["l" * draw.randint(1, 9)]))
        else:
            parts.append("x" * draw.randint(1, 60))
    return parts


def markup(parts):
    return "".join(x if isinstance(x, str) else f"<{x[0]}>{markup(x[1])}</{x[0]}>" for x in parts)


def counted(parts):
    """Characters, those in links, tags and link tags below a list of parts, by the definition."""
    total = [0, 0, 0, 0]
    for x in parts:
        if isinstance(x, str):
            total[0] += len(x)
        else:
            chars, linked, tags, links = counted(x[1])
            is_link = x[0] == "a"
            for i, v in enumerate((chars, chars if is_link else linked, tags + 1, links + is_link)):
                total[i] += v
    return total


def density(parts, share):
    chars, linked, tags, links = counted(parts)
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - linked, 1) * linked + share * chars + math.e)
    ratio = chars / max(linked, 1) * max(tags, 1) / max(links, 1)
    return chars / max(tags, 1) * max(math.log(ratio), 0) / math.log(max(base, math.e))


@pytest.mark.parametrize("seed", range(30))
def test_densities_and_their_largest_sum(seed):
    tree = grown(random.Random(seed), 4)
    whole = counted(tree)
    share = whole[1] / max(whole[0], 1)
    body = html_density._measure(html_density.parse(f"<body>{markup(tree)}</body>"), True)

    sums, todo = [], [(tree, body)]
    while todo:
        parts, node = todo.pop()
        assert math.isclose(node.density, density(parts, share), abs_tol=1e-9)
        below = [x[1] for x in parts if not isinstance(x, str) and x[0] == "div"]
        sums.append((sum(density(x, share) for x in below), node))
        assert math.isclose(node.total, sums[-1][0], abs_tol=1e-9)
        todo += zip(below, (n for n in node.parts if not isinstance(n, str) and n.tag == "div"))
    most = max(s for s, _ in sums)
    chosen = html_density._content(body)
    assert not most or any(math.isclose(s, most) and n in chosen for s, n in sums)


@pytest.mark.parametrize("text, want", [
    ("<div>" * 100_000 + "deep", "deep"), ("<title" * 20_000, ""), ("<p><div>" * 30_000 + "x", "x"), ("<article>" * 30_000 + "x", "x"),
    ("<table><tr><td>x" * 10_000, None), ("<a '" * 50_000, ""), ("</b>" * 100_000 + "x", "x"), ("<ul><li>x" * 10_000, None),
    ("<b>" * 50_000 + "</i>" * 50_000 + "x", "x"), ("<p>" + "long text " * 100_000, ("long text " * 100_000).strip()),
])
def test_odd_long_pages_end_soon(text, want):
    start = time.process_time()
    found = main_text(text)
    assert time.process_time() - start < 20
    assert found == want if want is not None else found.count("x") == 10_000

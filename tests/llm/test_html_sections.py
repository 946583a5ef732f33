import random
import re
import time

import pytest

from lodestore.llm import html_text

LONG = "This paragraph {} is long enough to be text and says something about the matter at hand, with commas and more words."


def paragraphs(*numbers):
    return "".join(f"<p>{LONG.format(i)}</p>" for i in numbers)


def lines(*numbers):
    return "\n".join(LONG.format(i) for i in numbers)


def test_sibling_sections_without_an_article():
    page = f"<body><div class=wrap><div class=s1>{paragraphs(1, 2, 3, 4, 5)}</div><div class=s2>{paragraphs(6, 7, 8, 9)}</div></div></body>"
    assert html_text.extract(page) == lines(*range(1, 10))


def test_sections_at_several_depths():
    links = "".join(f"<a href=/{i}>Link number {i}</a> " for i in range(8))
    page = f"<body><div>{links}</div><div><h1>Heading</h1><section>{paragraphs(1, 2, 3, 4, 5)}</section><div>{links}</div><div><div><section>{paragraphs(6, 7, 8)}</section></div></div>{paragraphs(9)}</div><div><span>Tiny</span> <span>x</span></div></body>"
    assert html_text.extract(page) == "Heading\n" + lines(*range(1, 10))


def test_one_section_stays_alone():
    page = f"<body><div><a href=/>Home</a> <a href=/a>About</a></div><div class=c>{paragraphs(1, 2, 3)}</div><div><b>Short</b> <i>end</i></div></body>"
    assert html_text.extract(page) == lines(1, 2, 3)


def article(inner, extra=""):
    text = "".join(f"<p>{'A sentence of the article with plain words in it. ' * 6}{i}</p>" for i in range(4))
    return f"<html><body><nav><a href=x>Home</a> <a href=y>Blog</a></nav>{extra}<article><h1>Title</h1>{text}{inner}</article><footer>Site</footer></body></html>"


def test_nothing_of_an_article_is_lost():
    for inner, want in (
        ('<h2 id="related-work">Related work</h2><p id="search">One.</p>', "Related work\nOne."),
        ('<h2 class="comments">Comments on it</h2>', "Comments on it"),
        ('<section id="notices"><p>About notices.</p></section>', "About notices."),
        ('<ul><li><a href=1>one</a></li><li><a href=2>two</a></li><li><a href=3>three</a></li></ul>', "one\ntwo\nthree"),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given.</p>", "Let x=1 be given."),
        ("<header><p>By Ann</p></header>", "By Ann"),
    ):
        got = html_text.extract(article(inner))
        assert got.startswith("Title\nA sentence") and got.endswith(want), inner
    for inner in ('<div class="comments"><p>First!</p></div>', '<div id="sidebar"><p>More</p></div>', '<ul class="share"><li>Tweet</li></ul>', '<p class="advert">Buy</p>'):
        assert html_text.extract(article(inner)) == html_text.extract(article(""))


def test_a_header_without_a_heading_in_main_is_the_sites():
    text = "<p>" + "Plain words of the main text stand here in a row. " * 8 + "</p>"
    page = "<body><main><header><a href=a>Home</a> <a href=b>Blog</a> Site name</header>{}<div><h1>T</h1>" + text * 3 + "</div></main></body>"
    assert html_text.extract(page.format("")).startswith("T\nPlain")
    assert html_text.extract(page.format("<header><h2>Sub</h2> by Ann</header>")).startswith("Sub\nby Ann\nT\nPlain")


def test_densities_sums_and_threshold_match_plain_definitions():
    """Each node's measures by looking at all others."""
    r = random.Random(5)

    def tree(depth):
        tag = r.choice(["div", "p", "section", "span", "a", "ul", "nav", "article"] if depth else ["div"])
        inner = "".join(r.choice(["word " * r.randrange(1, 30), tree(depth + 1) if depth < 5 else "x"]) for _ in range(r.randrange(1, 5)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(60):
        page = html_text.Page("<html><body>" + "".join(tree(0) for _ in range(4)) + "</body></html>")
        n = len(page.tag)
        chars, link_chars, tags, link_tags, end, density, sums, body = page.measure()
        up = [{k} for k in range(n)]
        for k in range(1, n):
            up[k] |= up[page.parent[k]]
        own = [sum(len(t.replace(" ", "")) for node, t in page.items if t and node == k and not page.out[k]) for k in range(n)]
        for k in range(n):
            below = [c for c in range(n) if k in up[c] and not page.out[c]]
            if page.out[k]:
                continue
            assert chars[k] == sum(own[c] for c in below) and tags[k] == len(below) - 1
            assert link_chars[k] == sum(own[c] for c in below if any(page.tag[x] == "a" for x in up[c]))
            assert link_tags[k] == sum(page.tag[c] == "a" for c in below if c != k)
            assert sums[k] == pytest.approx(sum(density[c] for c in range(1, n) if page.parent[c] == k))
        best = max((k for k in range(body, n) if not page.out[k]), key=lambda k: (sums[k], density[k], -k))
        limit = min(density[k] for k in up[best] if k >= body)
        inside = [k for k in sorted(up[best], reverse=True) if page.tag[k] == "article" and density[k] > limit]
        if inside and sums[best] > 0:  # the nearest article that is denser than the threshold, whole
            whole = " ".join(t for node, t in page.items if t and inside[0] in up[node] and not page.out[node]).split()
            assert "".join(page.main_text().split()) == "".join(whole)


BODY = "<h1>Head</h1>" + "".join(f"<p>Paragraph {i} of the text tells something of some length about its matter.</p>" for i in range(6))
REMARKS = "".join(f"<div class=comment><p>Reader {i} says that he likes this text very much, it being long and so on and so on.</p></div>" for i in range(30))
LAYOUTS = ("has-sidebar", "layout sidebar-right", "col-md-8 sidebar-left", "page-wrapper nav-open", "page menu-open", "content related-work", "search-results", "elementor-widget elementor-widget-theme-post-content")


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div><div class="sidebar"><p>Side text of a few words</p></div>'])
def test_layout_names_lose_no_page(name, inner):
    """A wrapper whose class describes a layout keeps its text, and what is surely no content inside it still goes."""
    plain = html_text.extract(f"<html><body><div>{BODY}</div></body></html>")
    assert html_text.extract(f'<html><body><nav><a href=x>n</a></nav><div class="{name}">{inner.format(BODY)}</div><footer>f</footer></body></html>') == plain
    assert len(plain) > 400


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="post">{BODY}</div><div id="comments">{REMARKS}</div>',
        f'<div class="post">{BODY}</div><div id="comments">{REMARKS.replace("<div class=comment>", "<article>").replace("</div>", "</article>")}</div>',
        f'<div class="page sidebar-left"><div class=post>{BODY}</div><ol class="comment-list">{REMARKS}</ol></div>',
        f'<article>{BODY}</article><div class="layout sidebar-right">{REMARKS}</div>',
        f'<div class="post">{BODY}</div><div class="sidebar">{REMARKS}</div>',
    ],
)
def test_longer_remarks_are_not_the_article(page):
    assert html_text.extract(f"<html><body>{page}</body></html>") == html_text.extract(f"<html><body><div>{BODY}</div></body></html>")


def test_a_page_of_a_notice_is_empty():
    assert html_text.extract('<html><body><div class="cookie-banner"><p>We use cookies on this site.</p></div></body></html>') == ""


@pytest.mark.parametrize("piece", ['<a ">"', "<a '", "<header>", "<div><p>", "<b><i>", "<!--", '"\'<x y="'])
def test_malformed_pages_take_linear_time(piece):
    began = time.perf_counter()
    html_text.extract("<p>hello</p>" + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 20  # a second or two; minutes if it were quadratic


def test_unclosed_quotes_read_as_before():
    """Whether a tag ends is looked up; the answer is the pattern's own."""
    rng = random.Random(5)
    for _ in range(3000):
        s = "".join(rng.choice(["<a ", '"', "'", ">", "x", "=", "<b>", "</b>", " "]) for _ in range(rng.randrange(30)))
        page = html_text.Page("")
        for i in (m.start() for m in re.finditer("<", s)):
            found, plain = page._tag(s, i), html_text.TAG.match(s, i)
            assert (found and found.span()) == (plain and plain.span())

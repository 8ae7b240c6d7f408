import math
import random
import re
import time

import pytest

from fieldloom.llm.html_density import Page, extract_pages, main_text

ARTICLE = "<h1>Title of it</h1><p>First &amp; long paragraph\n of the text, with <b>bold</b> and <a href=x>a link</a>.</p><p>Second<br>one &lt;here&gt;.</p>"
TEXT = "Title of it\n\nFirst & long paragraph of the text, with bold and a link.\n\nSecond one <here>."
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Some menu entry {i}</a></li>" for i in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title></head><body><nav>{LINKS}</nav><article>{ARTICLE}</article><footer>F</footer></body></html>",
        f"<body><header><h2>Site</h2>{LINKS}</header><main>{ARTICLE}</main><aside>See {LINKS}</aside></body>",
        f"<body><div class='top-menu'>{LINKS}</div><div id=content>{ARTICLE}</div><div class=sidebar><p>An advert that goes on for long, quite long.</p></div>",
        f"<body><div>{LINKS}</div><div><div class=post>{ARTICLE}</div></div><div>{LINKS}</div></body>",
        f"<body><script>var a='<p>no</p>';</script><style>p{{}}</style><article>{ARTICLE}<form><input>Mail<button>Go</button></form>"
        "<section class='user-comments'><p>A reader says much about it, really a lot of words.</p></section></article>",
        f"<BODY><ARTICLE>{ARTICLE.replace('</p>', '').replace('<p>', '<P>')}<!-- <p>no</p> --><div hidden>no</div><div style='display: none'>no</div></ARTICLE>",
        f"<body><div role='alert' class='notice'>Cookies!<div>deep</div></div><article>{ARTICLE}",
        f"<body><article>{ARTICLE}<p class=ad>Buy<p></article><div class='cookie-consent'><p>We use them, all of them, all the time, always.</p></div>",
    ],
)
def test_article_is_found(page):
    assert main_text(page) == TEXT


REST = "<div class=comments><p>A reader says much about it.</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content-sidebar-wrap'><main>{ARTICLE}</main><div class=sidebar><p>Some words.</p></div></div></body>",
        f"<body><nav>{LINKS}</nav><div id=page class='has-sidebar'><div>{ARTICLE}</div></div></body>",
        f"<body><div class='post-with-comments'><div>{ARTICLE}</div>{REST}</div></body>",
        f"<body><form action='/go'><header>{LINKS}</header><div id=content>{ARTICLE}</div><footer>The footer</footer></form></body>",
        f"<body><aside class=widget><article>{ARTICLE}</article></aside><footer>The footer</footer></body>",
        f"<body><article>{ARTICLE}</article><footer>{'f ' * 300}</footer></body>",
        f"<html><head><title>x</title><meta charset=utf-8><body><div>{ARTICLE}</div></body></html>",
        f"<body><div class=has-sidebar>{ARTICLE}</div><div class=comments>{'<p>' + 'a b ' * 14 + '</p>'}</div><footer>{'f ' * 50}</footer></body>",
    ],
)
def test_wrappers_named_like_other_parts_stay(page):
    assert main_text(page) == TEXT


def test_only_link_text_gives_way_to_an_article():
    intro = "<p>What stands before the article</p>"
    page = f"<body><h1>Site</h1>{intro}<article>{ARTICLE * 4}</article></body>"
    found = Page(page)
    found.densities = lambda: ([1.0] * len(found.names), [float(k == found.names.index("body")) for k in range(len(found.names))])
    assert found.text(found.article()).startswith("Site\n\nWhat stands before")
    links = Page(f"<body><div>{LINKS}</div><article>{ARTICLE}</article></body>")
    links.densities = lambda: ([1.0] * len(links.names), [float(k == links.names.index("body")) for k in range(len(links.names))])
    assert links.text(links.article()) == TEXT
    beside = Page(f"<body><div><p>{'plain words ' * 5}</p></div><article>{ARTICLE}</article></body>")
    beside.densities = lambda: ([1.0] * len(beside.names), [float(k == beside.names.index("div")) for k in range(len(beside.names))])
    assert beside.text(beside.article()) == ("plain words " * 5).strip()


@pytest.mark.parametrize(
    "inside",
    [
        '<p title="the hidden valley">P</p>',
        '<p data-note="class=ad style=display:none">P</p>',
        '<section id="related-work"><p>P</p></section>',
        '<div id="search-algorithms"><p>P</p></div>',
        '<div class="alert-levels">P</div>',
        '<p><span class="comment">P</span> and more of it</p>',
        '<p>See <a id="social" href="#x">P</a> and more</p>',
        "<p>So <math><mi>P</mi></math> holds</p>",
        '<div class="advertising-history"><p>P</p></div>',
    ],
)
def test_an_article_keeps_its_text(inside):
    for wrap in ("<article>{}</article>", "<div class=post>{}</div>"):
        got = main_text(f"<body><nav>{LINKS}</nav>{wrap.format(ARTICLE + inside + ARTICLE)}</body>")
        plain = "\n\n".join(" ".join(re.sub(r"<[^>]*>", "", b).split()) for b in re.findall(r"<(?:p|div)[^>]*>((?:(?!<p>).)*?)</(?:p|div)>", inside))
        assert got == f"{TEXT}\n\n{plain}\n\n{TEXT}" and "P" in plain


@pytest.mark.parametrize(
    "inside",
    [
        "<div class='related-stories-2'><p>Read on</p></div>",
        "<div class='more-related'><a href=/1>One</a><a href=/2>Two</a></div>",
        "<ul id=share-buttons><li>Mail</li></ul>",
        "<div class=comment-list><p>A reader says much about it.</p></div>",
        "<div role=complementary>Beside</div>",
        "<div class='x newsletter-signup'>Mail us</div>",
        '<div style="color: red; display:none">no</div>',
    ],
)
def test_parts_inside_an_article_go(inside):
    assert main_text(f"<body><article>{ARTICLE}{inside}</article></body>") == TEXT


N = 30_000


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * N + "deep",
        "<article>" * N + "deep",
        '<a "' * N,
        '<a "' * (N + 1) + ">",
        ' <a ">"' * N,
        "<i>" * N + "</b>" * N,
        "<b><div>" + "<i>" * N + "</b>" * N,
        "<i>" * N + "<hr>" * N,
        "<div>" * N + "<tr></tr>" * N,
        "<aside>" * N + "x",
        "<div class=ad>t " * N,
        "<!x" * N + "<" * N,
        "<li><i>" * N,
    ],
)
def test_time_grows_with_the_page(source):
    started = time.process_time()
    main_text(source[: len(source) // 8])
    small = time.process_time() - started
    main_text(source)
    assert time.process_time() - started < 24 * small + 1.5


def test_density_and_choice_against_plain_sums():
    """Every node's counts, density and sum of child densities, worked out on nested tuples."""
    rng = random.Random(6)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return "t", "word " * rng.randint(1, 30)
        return rng.choice(["div", "div", "section", "a", "b"]), [make(depth - 1) for _ in range(rng.randint(1, 4))]

    def source(node):
        return node[1] if node[0] == "t" else f"<{node[0]}>{''.join(map(source, node[1]))}</{node[0]}>"

    def nodes(node, link=False):
        """(name, chars, tags, link chars, link tags, parts below) in document order, this node first."""
        if node[0] == "t":
            size = len("".join(node[1].split()))
            return None, size, size * link
        below = [nodes(child, link or node[0] == "a") for child in node[1]]
        elements = [b for b in below if b[0] is not None]
        chars = sum(b[1] for b in below)
        links = sum(b[2] for b in below)
        return node[0], chars, links, sum(b[3] + 1 for b in elements), sum(b[4] + (b[0] == "a") for b in elements), elements

    def density(n, whole):
        _, c, lc, t, lt, _ = n
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + whole[2] * c / max(1, whole[1]) + math.e)
        return c / max(1, t) * math.log(max(c / max(1, lc) * max(1, t) / max(1, lt), 1 + 1e-9)) / base

    def listed(n):
        return [n, *(m for child in n[5] for m in listed(child))]

    for _ in range(60):
        tree = ("body", [make(4) for _ in range(rng.randint(1, 4))])
        page = Page(source(tree))
        whole = nodes(tree)
        expected = listed(whole)
        got, sums = page.densities()
        assert page.names[1:] == [n[0] for n in expected]
        assert got[1:] == pytest.approx([density(n, whole) for n in expected])
        assert sums[1:] == pytest.approx([sum(density(m, whole) for m in n[5]) for n in expected])


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<") .replace("<", "") == ""
    assert main_text("just &amp; text") == "just & text"
    assert main_text("<p>one<p>two <b>three<p>four</b>") == "one\n\ntwo three\n\nfour"
    assert main_text('<p title="a > b">x</p><a href="unclosed>y') .startswith("x")
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\n\nb\n\nc"
    assert main_text("<p>a&nbsp;b c</p>&#233;&eacute;&bogus;") == "a b c\n\néé&bogus;"


def test_densities_fall_with_links():
    page = Page(f"<body><div>{LINKS}</div><div><p>{'plain words ' * 30}</p></div></body>")
    density, sums = page.densities()
    first, second = (k for k, n in enumerate(page.names) if n == "div")
    assert density[second] > 10 * density[first] and sums[page.names.index("body")] > 0


def test_odd_and_empty_tables(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "t", "n"), (None, None, "", "t", "n"), (3, "u", f"<article>{ARTICLE}</article>", "t", "n"), (3, "u", f"<article>{ARTICLE}</article>", "t", "n")]
    rows.append((4, None, "<article><p>" + "word " * 200_000 + "</article>", None, None))
    got = sorted(map(tuple, extract_pages(spark.createDataFrame(rows, schema)).collect()), key=str)
    long = ("word " * 200_000).strip()
    assert got == sorted([(1, "u", "", 0), (None, None, "", 0), (3, "u", TEXT, len(TEXT)), (3, "u", TEXT, len(TEXT)), (4, None, long, len(long))], key=str)
    assert extract_pages(spark.createDataFrame([], schema)).collect() == []

"""op9 keeps the whole article."""

import random
import time

import pytest

from vidlake.llm import html_text

from . import plain_html


def test_a_second_template_keeps_its_article(spark, stored):
    long = "".join(f"<p>Sentence {k} of this page, long enough to be an article.</p>" for k in range(4))
    major = [(k, f"http://h.example.com/{k}", f"<div class='deep{k}'>{long}</div><div class='box{k}'><p>x</p></div>") for k in range(4)]
    minor = (9, "http://h.example.com/z", f"<div class='deep2'><p>short</p></div><div class='box7'>{long}</div>")
    found = {r["page_id"]: r["text"] for r in html_text.extract_pages(stored([*major, minor], "page_id long, url string, html string"), ["page_id"]).collect()}
    want = "\n".join(f"Sentence {k} of this page, long enough to be an article." for k in range(4))
    assert found == dict.fromkeys([0, 1, 2, 3, 9], want)


def test_the_vote_still_decides_between_near_containers():
    page = "<div class='a'><p>" + "x" * 90 + "</p></div><div class='b'><p>" + "y" * 100 + "</p></div>"
    assert html_text.extract(page, "div.a") == "x" * 90
    assert html_text.extract(page.replace("x" * 90, "x" * 50), "div.a") == "y" * 100


def words(n):
    return ("word " * n)[: n - 1] + "."


def test_sibling_containers_of_an_article_stay_together(spark, stored):
    parts = [words(40), words(200), words(300)]
    page = "<article><h1>{}</h1><section class='intro'><p>{}</p></section><section class='body'><p>{}</p></section></article>".format(*parts)
    want = "\n".join(parts)
    assert html_text.best_container(html_text.blocks(page))[0] == "article"
    assert html_text.extract(page, None) == html_text.extract(page, "article/section.body") == want
    pages = stored([(k, f"http://h/{k}", page) for k in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract_pages(pages, ["page_id"]).collect()} == {want}


def test_widening_stops_at_links_and_below_the_body():
    story = f"<div class='wrap'><div class='intro'><p>{words(100)}</p></div><div class='body'><p>{words(300)}</p></div></div>"
    assert html_text.extract(f"<body>{story}<div class='box'><p>x</p></div></body>", None) == f"{words(100)}\n{words(300)}"
    links = f"<main><article><p>{words(200)}</p></article><div class='list'><a href='/'>{words(60)}</a></div></main>"
    assert html_text.extract(links, None) == words(200)
    assert html_text.extract(f"<main><h1>Title here</h1><article><p>{words(200)}</p></article></main>", None) == f"Title here\n{words(200)}"


def test_names_and_figures_do_not_cut_an_article():
    page = (
        f"<body><article><h2 id='search'>Search</h2><p class='notice'>{words(30)}</p><section id='related-work'><h3>Related work</h3><p>{words(50)}</p></section>"
        f"<div class='social-history'><p>{words(300)}</p></div><figure><pre>code()</pre><figcaption>Caption <math><mi>x</mi></math></figcaption></figure>"
        f"<div class='share'><a href='/'>{words(300)}</a></div><div class='ad'>buy</div></article></body>"
    )
    want = ["Search", words(30), "Related work", words(50), words(300), "code()", "Caption x"]
    assert html_text.extract(page, None) == "\n".join(want)


def test_short_boilerplate_goes_outside_an_article():
    page = f"<div class='c'><div id='search'>find</div><p>{words(100)}</p><p class='copyright'>me</p><h2 id='legal'>Legal</h2><div class='ad'>buy <span>now</div><p>{words(60)}</p></div>"
    assert html_text.extract(page, None) == f"{words(100)}\nLegal\n{words(60)}"
    assert html_text.extract(f"<article><div class='ad'>open<p>{words(300)}</p></article>", None) == f"open\n{words(300)}"


TAGS = ["div", "div class='box3'", "div class='ad'", "div id=related", "section", "article", "main", "p", "p class=notice", "b", "a href='/x'", "span", "ul", "li", "table", "tr", "td", "h2", "nav", "aside", "blockquote", "pre", "br", "figure", "td class='x y7'"]


def random_page(rng):
    out, open_ = ["<body>"], []
    for _ in range(rng.randrange(5, 120)):
        turn = rng.random()
        if turn < 0.45:
            tag = rng.choice(TAGS)
            out.append(f"<{tag}>")
            open_.append(tag.split()[0])
        elif turn < 0.7 and open_:
            out.append(f"</{open_.pop() if rng.random() < 0.8 else rng.choice(open_)}>")
        else:
            out.append(rng.choice(["word ", "longer piece of text &amp; more. ", "x" * 90, "y " * 130, "<!-- no -->", "&lt;", " \n "]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(20))
def test_equal_to_the_plain_version(seed):
    rng = random.Random(seed)
    for _ in range(40):
        page, other = random_page(rng), random_page(rng)
        found, plain = html_text.blocks(page), plain_html.blocks(page)
        assert found.texts == [b.text for b in plain] and found.links == [b.links for b in plain]
        assert [found.path(n) for n in found.nodes] == ["/".join(b.path) for b in plain]
        assert html_text.best_container(found) == plain_html.best_container(plain)
        winner = plain_html.best_container(plain_html.blocks(other))[0]
        for path in (None, winner, "body", "body/div.box"):
            assert html_text.extract(page, path) == plain_html.extract(page, path)


@pytest.mark.parametrize("page", ["<a " * 40_000, "<div>x" * 20_000, "<b><p>x" * 17_000, "<div class=ad>x" * 8_000, '<a "><b x="1">' * 9_000, "<![CDATA[" * 13_000, "<" * 120_000, "<p " + "class =   " * 12_000 + ">x"])
def test_time_grows_with_the_length(page):
    def took(text):
        began = time.process_time()
        html_text.extract(text, "div/div")
        return time.process_time() - began

    took(page[:1000])
    assert took(page * 4) <= 10 * took(page) + 0.5


@pytest.mark.parametrize(
    "attrs, shown",
    [
        ('data-headline="The hidden city"', True), ('title="a hidden gem"', True), ('class="a hidden b"', True), ("class=hidden", True), ('aria-hidden="true"', True), ('title="display:none"', True),
        ("hidden", False), ('hidden=""', False), ("id=x HIDDEN", False), ("class='a' hidden='until-found'", False), ('style="color: red; display : none"', False),
    ],
)
def test_only_the_attribute_itself_hides(attrs, shown):
    prose = "Long enough prose for an article, told twice over. " * 6
    page = html_text.blocks(f"<body><article {attrs}><p>{prose}</p></article><p>after</p></body>")
    assert (prose.strip() in page.texts) == shown and "after" in page.texts
    inner = html_text.blocks(f"<article><p>{prose}</p><p {attrs}>gem</p></article>")
    assert ("gem" in inner.texts) == shown

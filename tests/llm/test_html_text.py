"""Parsing, tree matching against its definition, templates, and the pages of the driver."""

import html as H
import random
import re

import pytest

from furrow.llm.html_text import Node, extract_group, extract_pages, match, parse


def node(key, *children):
    out = Node(key, key, False)
    out.children = list(children)
    return out


def size_by_definition(a, b):
    def row(x, y):
        if not x or not y:
            return 0
        return max(row(x[1:], y), row(x, y[1:]), row(x[1:], y[1:]) + size_by_definition(x[0], y[0]))

    return 1 + row(a.children, b.children) if a.key == b.key else 0


def test_tree_matching():
    rng = random.Random(3)

    def tree(depth):
        return node(rng.choice("ab"), *(tree(depth - 1) for _ in range(rng.randrange(0, 4) if depth else 0)))

    for _ in range(300):
        a, b = tree(3), tree(3)
        n, pairs = match(a, b)
        assert n == size_by_definition(a, b) == len(pairs)
        assert all(x.key == y.key for x, y in pairs)


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain  text\n here", "plain text here"), ("<p>a&amp;b &lt;x&gt; &#233;&eacute;&nbsp;c", "a&b <x> éé c"),
    ("<nav>menu</nav><p>one<p>two<br>three</p><footer>f</footer>", "one\ntwo three"),
    ("<body><article><h1>T</h1><p><b>bold<br><p>x <i>y</i>z</p></article><p>outside</p></body>", "T\nbold\nx yz"),
    ("<article><p>a</p><aside>s</aside><div class='comments'><p>no</p></div><form>f</form><p>b</p></article>", "a\nb"),
    ("<script>var t='</p>';</script><style>p{}</style><p title=\"a>b\">x<!-- <p>c</p> -->y</p><script>open", "xy"),
    ("<main><p>m</p></main><p>n</p>", "m"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\nb\nc\nd\ne"),
    ("<div class=\"ad\">x</div><div id=cookie-notice>y</div><div hidden>z</div><div role=navigation>w</div>k < 5 & q", "k < 5 & q"),
    ("<p>a<span class='share'>share me</span>b</p>", "a\nb"), ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>end", "deep\nend"),
    ("<article><nav>x</nav></article><p>rest</p>", "rest"), ("<p>unclosed <b", "unclosed <b"), ("<title>t</title><p>x", "x")])
def test_single_pages(html, want):
    assert extract_group([html]) == [want]


def test_template_goes_and_content_stays():
    pages = [f"<div class=w><p>Welcome to our site</p><div><h2>Story {k}</h2><p>Text of story {k}.</p><p>Same in two</p></div><p>All rights reserved</p></div>"
             if k in (1, 2) else f"<div class=w><p>Welcome to our site</p><div><h2>Story {k}</h2><p>Text of story {k}.</p></div><p>All rights reserved</p></div>" for k in range(9)]
    got = extract_group(pages)
    assert got[0] == "Story 0\nText of story 0." and got[1] == "Story 1\nText of story 1.\nSame in two"
    assert extract_group(pages[:1])[0].startswith("Welcome")


def plain(html):
    """The pages of the driver have one article of h1 and p elements."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = [" ".join(H.unescape(re.sub("<br>", " ", re.sub("</?b>|</?h1>|</p>", "", x))).split()) for x in re.split("<p>|</h1>", inner)]
    return "\n".join(x for x in parts if x)


def test_registered_query(spark, sf_dir):
    from furrow.llm.queries import QUERIES

    rows = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op5_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == plain(rows[r.page_id].html) and r.url == rows[r.page_id].url and r.n_chars == len(r.text)


def test_nulls_repeats_and_a_hot_host(spark):
    page = "<html><body><div>Banner text</div><p>{}</p></body></html>"
    rows = [(i, "http://hot.example/x", page.format(f"body {i}")) for i in range(300)]
    rows += [(1, None, None), (None, "not a url", "<p>x</p>"), (2, "http://one.example", "<p>y</p>"), (2, "http://one.example", "<p>y</p>")]
    frame = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    got = extract_pages(frame, group=16)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(i, u, f"body {i}") for i, u, _ in rows[:300]] + [(1, None, ""), (None, "not a url", "x"), (2, "http://one.example", "y"), (2, "http://one.example", "y")], key=str)
    assert extract_pages(frame.limit(0)).collect() == []


@pytest.mark.parametrize("copies", [3, 10, 32])
@pytest.mark.parametrize("inner", ["<article><p>{0}</p><ul><li>{1}</ul></article>", "<main><p>{0}</p><ul><li>{1}</ul></main>",
                                   "<div><p>{0}</p><blockquote>{1}</blockquote></div>"])
def test_copies_keep_their_text(copies, inner):
    page = "<body><div class=top>Welcome</div>{}<div class=end>Rights reserved</div></body>"
    copied = page.format(inner.format("copied text", "copied item"))
    assert set(extract_group([copied] * copies)) <= {"copied text\ncopied item", "Welcome\ncopied text\ncopied item\nRights reserved"}
    others = [page.format(f"<div><p>own text {k}</p></div>") for k in range(29)]
    for rest in (others[:2], others):
        got = extract_group([copied] * copies + rest)
        assert got == ["copied text\ncopied item"] * copies + [f"own text {k}" for k in range(len(rest))]


def test_lines_of_all_articles_stay():
    pages = [f"<div>Site</div><article><p>Story {k}</p><p>Licensed to all</p></article>" for k in range(5)]
    assert extract_group(pages) == [f"Story {k}\nLicensed to all" for k in range(5)]


BODY = "".join(f"<p>Sentence number {k} of the story.</p>" for k in range(9))
STORY = "\n".join(f"Sentence number {k} of the story." for k in range(9))


@pytest.mark.parametrize("name", ["content has-sidebar", "layout-with-nav", "post no-comments", "entry-header", "social", "left-sidebar", "comments"])
def test_a_class_word_hides_no_article_and_not_most_of_a_page(name):
    for page in ("<div class='{0}'>{1}</div>", "<div id='{0}'><div>{1}</div></div><p>", "<body><div class='{0}'><article>{1}</article><p>x</p></div>",
                 "<section class='{0}'><div class=share><main>{1}</main></div></section>", "<my-app class='{0}'>{1}</my-app>",
                 "<div class='{0}'>{1}</div><div class=ad>Buy</div>"):
        assert extract_group([page.format(name, BODY)]) == [STORY], page


@pytest.mark.parametrize("extra", ["<div class='share'>Share this</div>", "<div class='site-footer'>All rights reserved</div>", "<div id=comments-2><p>first!</p></div>",
                                   "<ul class='menu'>" + "".join(f"<li><a href='/{k}'>A long entry of the menu, number {k}</a>" for k in range(40)) + "</ul>"])
def test_small_and_linked_elements_still_go(extra):
    assert extract_group([f"<div>{BODY}{extra}</div>"]) == [STORY] == extract_group([f"<article>{BODY}{extra}</article>"])


def test_posts_of_a_thread_stay_together():
    posts = "".join(f"<div class=comment id=comment-{k}>Post {k}</div>" for k in range(9))
    assert extract_group([f"<h1>Thread</h1>{posts}"]) == ["Thread\n" + "\n".join(f"Post {k}" for k in range(9))]


@pytest.mark.parametrize("tag", ["svg", "select", "object", "audio", "video", "canvas", "template", "noscript"])
def test_an_unclosed_element_ends_with_its_parent(tag):
    for later in ("", f"<{tag}>gone</{tag}>"):
        assert extract_group([f"<p>a</p><div>b<{tag} x=1>gone<i>gone</i></div><p>c</p>{later}<p>d</p>"]) == ["a\nb\nc\nd"]
    assert extract_group([f"<p>a <{tag}><p>gone</p></{tag}> b</p>" + f"<{tag}>" * 3000]) == ["a b"]


def test_formulas_are_text():
    assert extract_group(["<p>so <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></semantics></math> holds"]) == ["so x=1 holds"]


@pytest.mark.parametrize(("page", "text"), [
    ("<b></i>" * 200_000 + "x", "x"), ("<div>x" * 50_000, "\n".join("x" * 50_000)), ("<div>" * 50_000 + "<nav>y</nav>" * 50_000 + "z", "z"),
    ("<div><video></div>" * 50_000 + "</video>x", "x"), ("<p><button>" + "<b>" * 50_000 + "<div></div>" * 50_000 + "x", "")])
def test_long_pages_that_close_nothing_take_linear_time(page, text):
    from time import process_time

    begin = process_time()
    blocks = parse(page)[1]
    assert process_time() - begin < 30  # minutes and more, if every tag looked through all that are open
    assert "\n".join(b[0] for b in blocks if not b[1]) == text

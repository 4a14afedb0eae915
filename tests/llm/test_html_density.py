"""Composite text density: pages whose markup misleads, a plain recursive reference, long and odd pages."""

import math
import random
import time

import pytest

from handtrace.llm.html_density import Node, extract, main_text, measure, parse

WORDS = "This is a long paragraph of the article with many words in it."
BODY = f"<p>{WORDS * 6}</p>"
NAV = "<nav><a href=1>Home</a><a href=2>About</a></nav>"
COMMENT = "<p>I think this is wrong and I say so.</p>"


@pytest.mark.parametrize("page, lines, last", [
    (f"{NAV}<div class='content has-sidebar'><h1>T</h1>{BODY * 4}</div><div class='sidebar'>more</div>", 5, "in it."),
    (f"{NAV}<main><div class='no-sidebar'><h1>T</h1>{BODY * 4}</div></main>", 5, "in it."),
    (f"{NAV}<div class='post with-comments'><h1>T</h1>{BODY * 4}</div><div class=comments>{COMMENT * 20}</div>", 5, "in it."),
    (f"{NAV}<div id='social-history'>{BODY * 5}</div>", 5, "in it."),
    (f"{NAV}<article><div class='entry-header'><h2>The title</h2></div>{BODY * 3}</article>", 4, "in it."),
    (f"{NAV}<article>{BODY * 3}<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></article>", 6, "Three"),
    (f"{NAV}<article>{BODY * 2}<section class='menu'><p>{WORDS * 2}</p></section></article>", 3, "in it."),
    (f"{NAV}<article>{BODY * 2}<div class=ad>Buy now cheap cheap</div>{BODY}</article>", 3, "in it."),
    (f"<div class='cookie-banner'>We use cookies. Accept?</div>{NAV}<div><h1>T</h1>{BODY * 4}</div>", 5, "in it."),
    (f"{NAV}<div>{BODY * 4}</div><div class='related'><a>One</a><a>Two</a><a>Three</a></div><footer>(c)</footer>", 4, "in it."),
    (f"<aside>{BODY}</aside><div id=sidebar>{BODY}</div><article>{BODY * 3}</article><form>{BODY}</form>", 3, "in it."),
])
def test_marks_do_not_decide(page, lines, last):
    text = main_text(f"<html><body>{page}</body></html>").split("\n")
    assert len(text) == lines and text[-1].endswith(last)


def plain(node, body):
    """(characters, tags, link characters, link tags, density, density sum) by plain recursion."""
    kids = [plain(c, body) for c in node.children if not isinstance(c, str)]
    chars = sum(len(c) for c in node.children if isinstance(c, str)) + sum(k[0] for k in kids)
    tags = len(kids) + sum(k[1] for k in kids)
    link = node.name == "a"
    link_chars = chars if link else sum(k[2] for k in kids)
    link_tags = tags + 1 if link else sum(k[3] for k in kids)
    if body is None or not chars:
        return chars, tags, link_chars, link_tags, 0.0, 0.0 if not kids else sum(k[4] for k in kids)
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body[1] / max(body[0], 1) * chars + math.e)
    density = chars / t * math.log(max(chars / lc * t / lt, 1.0) + math.e - 1) / max(math.log(base + math.e - 1), 1.0)
    return chars, tags, link_chars, link_tags, density, sum(k[4] for k in kids) if kids else density


@pytest.mark.parametrize("seed", range(30))
def test_density_equals_plain_recursion(seed):
    rng = random.Random(seed)

    def tree(parent, depth):
        node = Node(rng.choice(["div", "p", "a", "span", "ul"]), parent, "")
        for _ in range(rng.randint(0, 4) if depth < 5 else 0):
            node.children.append("x" * rng.randint(1, 60) if rng.random() < 0.5 else tree(node, depth + 1))
        return node

    root = tree(None, 0)
    nodes = measure(root)
    whole = plain(root, None)
    for node in nodes:
        got = (node.chars, node.tags, node.link_chars, node.link_tags, node.density, node.total)
        assert got == pytest.approx(plain(node, (whole[0], whole[2])))
        assert node.best == pytest.approx(max(n.total for n in nodes if within(n, node)))


def within(node, top):
    while node is not None and node is not top:
        node = node.parent
    return node is top


def test_stray_tags_take_linear_time():
    def seconds(n):
        start = time.process_time()
        parse("</i><b>x" * n)
        parse("<p><b>" * n)
        return time.process_time() - start

    seconds(1000)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.05)


def test_rows(spark):
    rows = [(1, "u", f"<p>{WORDS}</p>", "x"), (1, "u", f"<p>{WORDS}</p>", "x"), (2, None, None, "y"), (3, "v", "", None),
            (None, "w", "no markup &amp; none\n at all", "z"), (4, "z", "<script>x</script>", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in extract(pages).collect())
    assert got == [(0, "no markup & none at all"), (1, WORDS), (1, WORDS), (2, ""), (3, ""), (4, "")]
    assert extract(pages.limit(0)).count() == 0

"""The tree of a page and its text against a version that climbs and recurses, and pages made to cost much."""

import random
import time

import pytest

from codeloupe.llm import main_text as m
from tests.llm.test_main_text import LONG


def plain_parse(page):
    """Climbs from element to element for each tag; takes quotes as closed."""
    root = at = m.Node("html", None)
    where = 0
    while found := m.TAG.search(page, where):
        at.parts += [page[where : found.start()]] if found.start() > where else []
        where = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            node = at
            while node is not None and node.name != name and not (node.name in m.WALLS and name not in m.SCOPE):
                node = node.up
            if node is not None and node.name == name and node.up is not None:
                at = node.up
            elif name == "p":
                at.parts.append(m.Node("br", at))
            continue
        if name in ("html", "body"):
            continue
        ends = m.ENDS.get(name, ())
        node, target = at, None
        while node.up is not None:
            if node.name in ends:
                target = node
                if name not in ("tbody", "tfoot", "tr"):
                    break
            elif node.name in m.SCOPE and not (node.name in m.CELLS and name in ("tr", "tbody", "tfoot", "td", "th")):
                break
            node = node.up
        if target is not None:
            at = target.up
        new = m.Node(name, at, *m.hints(name, found[3]))
        at.parts.append(new)
        if name not in m.VOID and not found[3].endswith("/") or name in m.SCOPE:
            at = new
    if where < len(page):
        at.parts.append(page[where:])
    return root


def shape(node):
    return (node.name, node.weight, node.bad, [shape(p) if isinstance(p, m.Node) else p for p in node.parts])


def plain_text(node):
    return "".join(p if isinstance(p, str) else plain_text(p) for p in node.parts)


def holds_heading(node):
    return any(isinstance(p, m.Node) and (p.name in m.HEADINGS or holds_heading(p)) for p in node.parts)


def plain_prune(node, inside=False):
    inside = inside or node.weight >= 25
    kept = []
    for p in node.parts:
        if isinstance(p, m.Node):
            if p.name == "header" and not (inside and holds_heading(p)) or p.name != "header" and p.bad:
                continue
            plain_prune(p, inside)
        kept.append(p)
    node.parts = kept


def plain_points(root):
    """The points of all nodes, each from its own whole text."""
    found = {}

    def links(node):
        return sum((own_size(p) if p.name == "a" else links(p)) for p in node.parts if isinstance(p, m.Node))

    def own_size(node):
        return sum(own_size(p) if isinstance(p, m.Node) else len(p.strip()) for p in node.parts)

    def visit(node):
        for p in node.parts:
            if isinstance(p, m.Node):
                visit(p)
        own = [p for p in node.parts if isinstance(p, str)]
        size = own_size(node)
        if (node.name in m.TEXTUAL or any(len(p.strip()) >= 25 for p in own)) and size >= 25 and node.name != "a":
            text = plain_text(node) if node.name in m.TEXTUAL else "".join(own)
            points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links(node) / size)
            up = node.up if node.name in m.TEXTUAL or node.name not in m.BLOCK else node
            for share in (1, 2, 6, 9, 12):
                if up is not None:
                    found[id(up)] = found.get(id(up), 0) + points / share
                    up = up.up

    visit(root)
    return found


def random_page(seed):
    r = random.Random(seed)
    names = ["p", "div", "li", "ul", "table", "tr", "td", "th", "tbody", "b", "a", "h1", "h2", "article", "section", "header", "dl", "dt", "dd", "br", "nav", "thead", "caption", "em", "main", "option"]
    out = []
    for _ in range(r.randrange(4, 60)):
        x = r.random()
        name = r.choice(names)
        out.append(f"<{name}{r.choice(['', '', ' class=ad', ' class=post', ' id=x'])}>" if x < 0.45 else f"</{name}>" if x < 0.7 else r.choice([LONG, "short, ", " ", "a few more words, and a comma "]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(300))
def test_tree_and_points_like_the_plain_version(seed):
    page = random_page(seed)
    nodes, plain = m.parse(page), plain_parse(page)
    assert shape(nodes[0]) == shape(plain)
    m.prune(nodes)
    plain_prune(plain)
    assert shape(nodes[0]) == shape(plain)
    m.score(m.measure(nodes[0]))
    points = plain_points(plain)

    def pairs(a, b):
        yield a, b
        for x, y in zip(a.parts, b.parts):
            if isinstance(x, m.Node):
                yield from pairs(x, y)

    assert all(a.points == pytest.approx(points.get(id(b), 0.0)) for a, b in pairs(nodes[0], plain))


N = 100_000
COSTLY = {
    "deep header": "<article><header>" + "<div>" * N + "<h1>T</h1>", "many headers": "<article>" + "<header><div>" * N, "stray ends": "<div><p>x" + "</b></i></em>" * N, "walls": "<b>" + "<div>" * N + "<section>" + "</b>" * N,
    "open quotes": '<a "x>' * (N + 1), "open svg": "<svg>" * N, "nested items": "<ul><li>word, " * N, "rows": "<table>" + "<tr><td>" * N, "comments": "<h2>Comments</h2><p>a</p>" * N, "long number": "<p>&#" + "1" * N, "signs": "<" * N, "open comments": "<!--" * N,
}


@pytest.mark.parametrize("name", COSTLY)
def test_no_page_ends_a_task(name):
    began = time.process_time()
    m.main_text(COSTLY[name])
    assert time.process_time() - began < 20  # a quadratic version takes many minutes


def test_readers_comments():
    own = f"<article><h1>T</h1><p>{LONG}</p>"
    for heading in ("Comments", "3 Comments", "Reader comments (12)", "Leave a reply", "Kommentare", "Discussion"):
        assert m.main_text(f"{own}<section><h2>{heading}</h2><p>{LONG} I think.</p></section></article>") == f"T\n{LONG}"
        assert m.main_text(f"{own}<h2>{heading}</h2><p>{LONG} I think.</p><h3>Anna</h3><p>{LONG}</p><h2>More</h2><p>{LONG}</p></article>") == f"T\n{LONG}\nMore\n{LONG}"
    assert "Comments on law" in m.main_text(f"{own}<h2>Comments on law</h2><p>{LONG}</p></article>")


def test_a_quote_that_never_closes():
    assert m.main_text(f"<article><p class=\"x>{LONG}</p><p>{LONG} 2</p></article>") == f"{LONG}\n{LONG} 2"


def test_numbers_of_any_length():
    assert m.main_text(f"<p>&#{'0' * 5000}65; &#{'9' * 5000}; {LONG}</p>") == f"A � {LONG}"


def test_clashing_columns_and_broken_bytes(spark):
    df = spark.sql(f"SELECT 1L AS page_id, 'u' AS url, cast(X'3C703EFF' AS string) || ' {LONG}' AS html, 'x' AS text, 'y' AS n_chars, 'z' AS `a.b`")
    (row,) = m.extract(df).collect()
    assert row.text == f"� {LONG}" and row.n_chars == len(row.text)

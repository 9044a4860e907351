"""Main text of web pages by tree scoring.

A page's tags become a light tree. Parts that are chrome by their tag, role or class are left out.
Every paragraph passes points for its length and its commas to its ancestors: all of them to its
parent, half to the grandparent, less to those above. An element's points are discounted by its
link density; the best container and those of its siblings that score well too, or read like
paragraphs, are kept.

Everything is a loop over the tree's nodes and takes time in proportion to the page, however deep,
crossed or broken off its tags are.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from codeloupe.llm.common import columns, map_texts

#: The last group is empty, before the page's end, where a quote of the attributes never closes.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|)", re.S)
#: For the rest of such a page: a tag ends at its first ``>``.
LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|)", re.S)
#: An attribute and its value, so that no value is read as names.
HINT = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title xmp noembed noframes".split())
CHROME = frozenset("nav footer aside form button select option dialog menu head label fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
TEXTUAL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt td th figcaption caption summary".split())
LEVELS = tuple("h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset(LEVELS)
#: A start tag of the key ends an open element of the values (within the nearest of SCOPE).
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "thead": ("caption",)}
SCOPE = frozenset("html body div article section main table ul ol dl td th aside nav header footer form blockquote".split())
#: No end tag of an inline or text element closes these.
WALLS = frozenset("article main td section".split())
#: What stands between a table's parts and the table itself.
CELLS = frozenset(("td", "th"))
NO_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class names, ids and roles that name chrome, and those that name content.
BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|outbrain|taboola|cookies?|consent|gdpr|notices?|alert\w*|nav\w*|menu\w*|breadcrumbs?|foot(?:er)?|site-?foot\w*|"
    r"masthead|topbar|toolbar|headers?|site-?head\w*|side-?bar\w*|side|rail|widget\w*|comment\w*|disqus\w*|repl(?:y|ies)|respond|discussion|social|share\w*|sharing|related\w*|recommend\w*|"
    r"subscribe\w*|newsletter|signup|sign-?up|login|log-?in|register|search\w*|popup|modal|overlay|paywall|pagination|pager|legal|disclaimer|copyright|complementary|contentinfo|navigation|"
    r"skip\w*|hidden|sr-only|visually-hidden|most-?read|trending|tags?|tag-?list|forms?)(?=$|[\s_-])",
    re.I,
)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|main\w*|post|story|text|hentry|page)(?=$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: All that a start tag may close, by its name.
ENDS = {name: CLOSES.get(name, ()) + (("p",) if name in NO_P else ()) + (LEVELS if name in HEADINGS else ()) for name in {*CLOSES, *NO_P}}
#: Headings over what readers wrote.
REMARKS = re.compile(
    r"(?:\(?\d+\)?\s*)?(?:(?:reader|user|visitor|latest|recent|all)s?['’]?\s+)?(?:comments?|replies|responses|discussion|kommentare?|leserkommentare|commentaires?|comentarios?)(?:\s+(?:section|below))?\s*(?:\(\s*\d+\s*\)|\d+)?\s*:?|"
    r"(?:leave|post|write|add|join|submit)\s+(?:a|your|the)\s+(?:comment|reply|response|conversation|discussion)s?\b.{0,20}|(?:schreiben sie|hinterlasse[n]?)\b.{0,30}|laisser un commentaire|deja un comentario",
    re.I | re.S,
)
#: A character reference with so many digits that none is meant.
NUMBER = re.compile(r"&#([0-9]{9,})(;?)")


class Node:
    __slots__ = ("bad", "commas", "headed", "length", "links", "name", "parts", "points", "size", "up", "weight")

    def __init__(self, name: str, up: Node | None, weight: float = 0.0, bad: bool = False):
        self.name, self.up, self.weight, self.bad = name, up, weight, bad
        self.parts: list = []
        self.points = 0.0
        self.size = self.links = self.length = self.commas = 0
        self.headed = False


class Open:
    """The open elements, outermost first, and the depths at which their names stand.

    What an end or a start tag closes is read off the last depth of a name (or the first one within
    a scope), so a tag costs the same at any depth.
    """

    def __init__(self, root: Node):
        self.nodes = [root]
        self.depths: defaultdict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []
        self.tables: list[int] = []  # scopes without cells
        self.walls: list[int] = []

    def push(self, node: Node) -> None:
        name, depth = node.name, len(self.nodes)
        self.depths[name].append(depth)
        if name in SCOPE:
            self.scopes.append(depth)
            if name not in CELLS:
                self.tables.append(depth)
            if name in WALLS:
                self.walls.append(depth)
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        """Closes the elements from this depth on."""
        nodes = self.nodes
        while len(nodes) > depth:
            name = nodes.pop().name
            self.depths[name].pop()
            if name in SCOPE:
                self.scopes.pop()
                if name not in CELLS:
                    self.tables.pop()
                if name in WALLS:
                    self.walls.pop()

    def nearest(self, name: str) -> int:
        """The depth of the innermost open element of a name; 0: none."""
        found = self.depths.get(name)
        return found[-1] if found else 0

    def ended(self, name: str) -> int:
        """The depth of the element that an end tag closes; 0: none, it is left over."""
        depth = self.nearest(name)
        return 0 if name not in SCOPE and self.walls and self.walls[-1] > depth else depth

    def pushed_out(self, name: str) -> int:
        """The depth of the element that a start tag closes; 0: none."""
        ends = ENDS.get(name)
        if not ends:
            return 0
        scopes = self.tables if name in ("td", "th", "tr", "tbody", "tfoot") else self.scopes
        floor = scopes[-1] if scopes else 0
        if name in ("tr", "tbody", "tfoot"):  # these close the outermost row or part of their table
            return min((depths[k] for e in ends if (depths := self.depths.get(e)) and (k := bisect_right(depths, floor)) < len(depths)), default=0)
        depth = max(map(self.nearest, ends))
        return depth if depth > floor else 0


def hints(name: str, attributes: str) -> tuple[float, bool]:
    """The start points of an element by its name and attributes, and whether it is chrome."""
    weight = 25.0 if name in ("article", "main") else 0.0
    if not attributes or attributes.isspace():
        return weight, name in CHROME
    bad = name in CHROME
    for m in HINT.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            bad = True
        elif key in ("class", "id", "role"):
            if key == "role" and value in ("main", "article") or GOOD.search(value):
                weight += 25
                # "comment-content" is chrome all the same, "article-header" is not
                bad = bad or bool(re.search(r"(?:^|[\s_-])(?:comment\w*|side-?bar\w*|ads?|footer|nav|menu|related\w*|cookies?)(?=$|[\s_-])", value, re.I))
            elif BAD.search(value):
                bad = True
        elif key == "itemprop" and value == "articleBody":
            weight += 25
    return weight, bad


def parse(page: str) -> list[Node]:
    """The nodes of a page's tree, each behind its parent, the root first.

    End tags may be missing, crossed or left over, and the page may break off.
    """
    root = Node("html", None)
    nodes, open_ = [root], Open(root)
    where, size, tag = 0, len(page), TAG
    endless: set[str] = set()  # raw elements that have no end tag from here on
    while where < size:
        m = tag.search(page, where)
        at = open_.nodes[-1]
        if m is None:
            at.parts.append(page[where:])
            break
        if m.start() > where:
            at.parts.append(page[where : m.start()])
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                at.parts.append(m[0][9:].removesuffix("]]>"))
            where = m.end()
            continue
        if not m[4] and m.end() < size:  # a quote that never closes: only one such search is made
            tag = LOOSE
            m = tag.match(page, m.start())
        where, name = m.end(), m[2].lower()
        if m[1]:
            if depth := open_.ended(name):
                open_.cut(depth)
            elif name == "p":
                nodes.append(Node("br", at))
                at.parts.append(nodes[-1])
            continue
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(page, where)
            if end:
                where = end.end()
            elif name in ("script", "style", "textarea", "title"):
                where = size
            else:
                endless.add(name)
            continue
        if name in ("html", "body"):
            continue
        if depth := open_.pushed_out(name):
            open_.cut(depth)
            at = open_.nodes[-1]
        new = Node(name, at, *hints(name, m[3]))
        nodes.append(new)
        at.parts.append(new)
        if name not in VOID and not m[3].rstrip().endswith("/") or name in SCOPE:
            open_.push(new)
    return nodes


def peek(node: Node, most: int = 80) -> str:
    """The text of a node if that is short, with its white space collapsed; else ''."""
    out, todo, seen, size = [], [node], 0, 0
    while todo:
        x = todo.pop()
        seen += 1
        if isinstance(x, Node):
            todo += x.parts[::-1] if len(x.parts) <= most else ()
            seen += len(x.parts)
        else:
            out.append(x)
            size += len(x)
        if size > 2 * most or seen > 2 * most:
            return ""
    text = " ".join(decoded("".join(out)).split())
    return text if len(text) <= most else ""


def without_remarks(node: Node) -> list:
    """The parts of an element but for readers' comments: what a telling heading stands over.

    If it is the first thing in a section, all of that goes; else it goes with all that follows up
    to the next heading of its level or a higher one.
    """
    kept, level, first = [], 0, True
    for p in node.parts:
        if isinstance(p, Node) and (p.name in HEADINGS or p.name in ("header", "hgroup") and p.headed):
            own = int(p.name[1]) if p.name in HEADINGS else 2
            if level and own <= level:
                level = 0
            if not level and REMARKS.fullmatch(peek(p)):
                if first and node.up is not None and node.weight < 25:
                    return []
                level = own
        if not level:
            kept.append(p)
        first = first and (p.name in VOID if isinstance(p, Node) else not p.strip())
    return kept


def prune(nodes: list[Node]) -> None:
    """Takes chrome and comments out of the tree. A header goes unless it stands in an article and holds its heading."""
    for node in reversed(nodes):
        if node.up is not None and (node.headed or node.name in HEADINGS):
            node.up.headed = True
    todo = [(nodes[0], False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.weight >= 25
        kept = []
        for p in without_remarks(node) if node.headed else node.parts:
            if isinstance(p, Node):
                if not (inside and p.headed) if p.name == "header" else p.bad:
                    continue
                todo.append((p, inside))
            kept.append(p)
        node.parts = kept


def measure(root: Node) -> list[Node]:
    """Sets sizes, lengths, commas and links of what is below each node; the nodes, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node)]
    order.reverse()
    for node in order:
        size = links = length = commas = 0
        for p in node.parts:
            if isinstance(p, Node):
                size += p.size
                links += p.links
                length += p.length
                commas += p.commas
            else:
                size += len(p.strip())
                length += len(p)
                commas += p.count(",")
        node.size, node.links, node.length, node.commas = size, size if node.name == "a" else links, length, commas
    return order


def density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def own_text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            todo += x.parts[::-1]
        else:
            out.append(x)
    return "".join(out)


def score(order: list[Node]) -> None:
    for node in order:
        own = [p for p in node.parts if not isinstance(p, Node)]
        direct = node.name in TEXTUAL or any(len(p.strip()) >= 25 for p in own)
        if not direct or node.size < 25 or node.name == "a":
            continue
        length, commas = (node.length, node.commas) if node.name in TEXTUAL else (sum(map(len, own)), sum(p.count(",") for p in own))
        points = (1 + commas + min(length / 100, 3)) * (1 - density(node))
        up, level = (node.up, 0) if node.name in TEXTUAL or node.name not in BLOCK else (node, 0)
        while up is not None and level < 5:
            up.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.up, level + 1


def decoded(text: str) -> str:
    """Character references decoded; a number of any length does no harm."""
    return html.unescape(NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:9] or 0}{m[2]}", text))


def blocks(node: Node) -> list[str]:
    """The texts of a subtree, a block each, references decoded and white space collapsed."""
    out: list[list[str]] = [[]]
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, Node):
            if x.name in BLOCK:
                out.append([])
                todo.append(None)
            todo += x.parts[::-1]
        else:
            out[-1].append(x)
    texts = (" ".join(decoded("".join(b)).split()) for b in out if b)
    return [t for t in texts if t]


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by one newline; '' if there is none."""
    if not page:
        return ""
    nodes = parse(page)
    prune(nodes)
    root = nodes[0]
    order = measure(root)
    score(order)
    candidates = [n for n in order if n.points > 0 and (n.name in BLOCK or n.up is None)]
    if not candidates:
        # No paragraph: whatever text an article has, else the page.
        named = [n for n in order if n.weight >= 25 and n.size]
        return "\n".join(blocks(max(named, key=lambda n: n.size) if named else root)) if root.size and density(root) < 0.5 else ""
    value = {id(n): (n.points + n.weight) * (1 - density(n)) for n in candidates}
    best = max(candidates, key=lambda n: value[id(n)])
    # An enclosing article holds what belongs to its best part, and so does a parent of nothing else.
    up = best.up
    while up is not None:
        if up.weight >= 25:
            best = up
        elif best.up is up and up.up is not None and sum(isinstance(p, Node) and p.size > 0 for p in up.parts) == 1:
            best = up
        up = up.up
    kept = [best]
    if best.up is not None:
        least = max(10.0, 0.2 * value.get(id(best), 0.0))
        kept = []
        for p in best.up.parts:
            if not isinstance(p, Node):
                continue
            good = p is best or value.get(id(p), 0.0) >= least
            if not good and p.name in ("p", "h1", "h2") and best.name not in ("article", "main"):
                good = density(p) < 0.25 and (p.size > 80 or p.name != "p" or p.size > 0 and density(p) == 0 and own_text(p).rstrip()[-1:] in ".!?")
            if good:
                kept.append(p)
    return "\n".join(t for node in kept for t in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``.

    Null and empty pages, and those without any text, have the text ''. Rows are judged one by one:
    repeated rows and ties of ``page_id`` give repeated results, an empty table gives none, and other
    columns are not read, whatever their names. A page of any length or depth takes time and memory
    in proportion to it; bytes that are no UTF-8 count as U+FFFD.
    """

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        found = [main_text(t.decode("utf-8", "replace")) for t in texts]
        return {"page_id": part.column(0), "url": part.column(1), "text": found, "n_chars": [len(t) for t in found]}

    return map_texts(columns(pages, page_id="long", url="string", html="string"), "html", "page_id long, url string, text string, n_chars long", work)

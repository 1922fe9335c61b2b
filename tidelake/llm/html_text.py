"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import fresh

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template iframe object svg canvas textarea select button title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag closes these open elements, up to the nearest element that holds them.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: Which elements end the search for one to close; a node knows its nearest of each family.
FAMILY = {"li": "li", "ul": "li", "ol": "li", "menu": "li", "dir": "li", "dt": "dl", "dd": "dl", "dl": "dl", "tr": "table", "td": "table", "th": "table", "table": "table", "option": "option", "head": "body", "body": "body"}
#: Elements, roles and names in class or id that are never the article.
ASIDE = frozenset("nav footer aside form menu dialog head search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Inside the article a class or id counts only as a whole, alone or with one of these endings.
WHOLE = re.compile(
    r"(?:^|\s)(?:ads?|adverts?|advertisement|advertising|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|footer|cookies?|popup|modal|overlay|newsletter|subscribe|signup|social|share|sharing|related|recommended|more-stories|trending|comments?|commentlist|disqus|replies|respond|pagination|pager|toolbar|tags|notice|skip-link)(?:[_-]?(?:box|bar|block|list|links?|buttons?|wrapper|container|section|area|posts?|articles?|stories|banner|form|unit|slot|thread|widget|icons?|nav|menu))?(?:$|\s)",
    re.I,
)
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side-bar|rail|widget|footer|masthead|site-header|page-header|header|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|more-stories|trending|comments?|commentlist|disqus|replies|respond|pagination|pager|toolbar|tags|skip-link)(?:$|[\s_-])",
    re.I,
)
#: Inside the article these parts of a class or id make an element doubtful: it goes if it is mostly links or a smaller part of the article.
PARTS = re.compile(
    r"(?:^|[\s_-])(?:adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|navbar|navigation|breadcrumbs?|sidebar|side-bar|footer|masthead|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|subscription|signup|login|related|recommended|more-stories|trending|comments?|commentlist|disqus|replies|pagination|pager|skip-link)(?:$|[\s_-])",
    re.I,
)
#: Headings over lists of other pages and over readers' comments, in the languages of the pages at hand.
OTHERS = re.compile(
    r"\s*(?:related(?: (?:articles?|stories|posts?|links?|reading|content))?|recommended(?: for you)?|more stories|most read|trending(?: now)?|you (?:may|might) also like|read next|(?:\d+ )?comments?(?: \(?\d+\)?)?|leave a (?:comment|reply)|share this(?: (?:article|story|post))?|ähnliche artikel|mehr zum thema|(?:\d+ )?kommentare?|articles? (?:liés|similaires|connexes)|à lire aussi|(?:\d+ )?commentaires?|art[ií]culos relacionados|relacionados|(?:\d+ )?comentarios?)\s*[:.…]?\s*",
    re.I,
)
COMMENTS = re.compile(r"comment|komment|coment|reply", re.I)
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")
SCORED = frozenset("p pre td th blockquote li dd dt h1 h2 h3 h4 h5 h6 div section article main".split())


class Node:
    __slots__ = ("tag", "parent", "items", "out", "score", "chars", "linked", "inside", "block", "inline", "doubt", "home", "near")

    def __init__(self, tag: str, parent: Node | None, out: bool) -> None:
        self.tag, self.parent, self.out = tag, parent, out
        self.home: Node | None = self if tag in ("article", "main") else parent.home if parent is not None else None
        self.inside = self.home is not None
        self.doubt = tag == "article" and parent is not None and parent.home is not None and parent.home.tag == "article"
        self.near: dict[str, Node] = {} if parent is None else parent.near
        if tag in FAMILY:
            self.near = {**self.near, FAMILY[tag]: self}
        self.items: list[Node | str] = []
        self.block: Node = self if parent is None or tag in BLOCK else parent.block
        self.inline: dict[str, int] = {}  # of a block: its open inline elements
        self.score = 0.0
        self.chars = self.linked = 0


def _left_out(tag: str, attributes: str, parent: Node) -> bool:
    """Whether an element is boilerplate by its tag, role or name; a header or a name counts less inside the article."""
    if tag in ASIDE:
        return True
    inside = parent.inside
    if tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and (WHOLE if inside else NAMES).search(value) and not (inside and tag == "header"):
            return True
    return False


def _doubtful(tag: str, attributes: str) -> bool:
    """Whether a part of the class or id of an element inside the article names boilerplate."""
    if not attributes or tag not in BLOCK or tag in ("html", "body", "article", "main"):
        return False
    return any(name.lower() in ("class", "id") and PARTS.search(value.strip("\"'")) for name, value in ATTRIBUTE.findall(attributes))


def parse(page: str) -> Node:
    """A tree of the page: optional end tags are implied, unclosed inline elements end with their block."""
    root = at = Node("html", None, False)
    blocks: dict[str, int] = {}  # open ones by name, so that an end tag without a start costs nothing
    pos, size = 0, len(page)

    def leave(node: Node, to: Node) -> Node:
        """Closes all from `node` up to, but not, `to`."""
        while node is not to:
            counts = blocks if node.block is node else node.block.inline
            counts[node.tag] -= 1
            node = node.parent
        return to

    while pos < size:
        start = page.find("<", pos)
        if start < 0:
            start = size
        if start > pos:
            at.items.append(page[pos:start])
        if start == size:
            break
        m = TOKEN.match(page, start)
        if not m:
            at.items.append("<")
            pos = start + 1
            continue
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if (blocks if tag in BLOCK else at.block.inline).get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                at = leave(at, node.parent)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|$)", re.I).search(page, pos)
            pos = end.end() if end else size
            at.items.append(" ")
            continue
        if tag == "html":
            continue
        if tag in BLOCK and at.block.tag == "p":
            at = leave(at, at.block.parent)
        if tag in CLOSES:
            up = at.near.get(FAMILY[tag])
            while up is not None and up.tag in CLOSES[tag]:
                at = leave(at, up.parent)
                up = at.near.get(FAMILY[tag]) if tag == "tr" else None
        if tag in VOID:
            at.items.append(Node(tag, at, False) if tag == "hr" else " ")
            continue
        node = Node(tag, at, at.out or _left_out(tag, m[3], at))
        if at.inside and not node.out and _doubtful(tag, m[3]):
            node.doubt = True
        at.items.append(node)
        counts = blocks if node.block is node else node.block.inline
        counts[tag] = counts.get(tag, 0) + 1
        at = node
    return root


def _lengths(root: Node) -> list[Node]:
    """Characters and linked characters below each node; the nodes that are not left out, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.out:
            continue
        node.chars = node.linked = 0
        order.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    for node in reversed(order):
        node.chars += sum(len(x.strip()) for x in node.items if isinstance(x, str))
        node.linked = node.chars if node.tag == "a" else node.linked
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return order


def _words(node: Node) -> str:
    """The text of a heading, or of its first characters."""
    out, stack, size = [], list(reversed(node.items)), 0
    while stack and size < 200:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            size += len(x)
        elif not x.out:
            stack.extend(reversed(x.items))
    return SPACE.sub(" ", html.unescape("".join(out)))


def _settle(order: list[Node]) -> bool:
    """Leaves out of the article its doubtful parts, and headings of other pages or of comments with what they stand over; whether there were any."""
    found = False
    for node in order:
        if node.out or not node.inside:
            continue
        home = node.parent.home if node.home is node and node.parent is not None else node.home
        if node.doubt and home is not None and (node.linked > 0.4 * node.chars or 2 * node.chars < home.chars):
            node.out = found = True
            continue
        blocks = [x for x in node.items if isinstance(x, Node) and x.tag in BLOCK and not x.out]
        for x, after in zip(blocks, blocks[1:], strict=False):
            if x.tag in HEADINGS and after.tag in ("ul", "ol", "div", "section") and after.chars and OTHERS.fullmatch(_words(x)) and (after.linked > 0.6 * after.chars or COMMENTS.search(_words(x)) and 2 * after.chars < node.home.chars):
                x.out = after.out = found = True
    return found


def _measure(root: Node) -> list[Node]:
    """Lengths below each node, and points passed on to ancestors; nodes in page order."""
    order = _lengths(root)
    if _settle(order):
        order = _lengths(root)
    for node in order:
        if node.tag not in SCORED:
            continue
        direct, commas, links = 0, 0, 0
        for x in node.items:
            inner = [x]
            while inner:
                y = inner.pop()
                if isinstance(y, str):
                    direct += len(y.strip())
                    commas += y.count(",") + y.count("،") + y.count("、")
                elif not y.out and y.tag not in BLOCK:
                    links += y.linked if y.tag == "a" else 0
                    inner.extend(y.items)
        if not direct:
            continue
        points = (min(direct / 100, 3.0) + commas + (1 if direct >= 25 else 0.25)) * (1 - min(1.0, links / direct))
        up, share = node if node.tag in ("div", "section", "article", "main") else node.parent, 1.0
        while up is not None and share > 0.05:
            up.score += points * share
            up, share = up.parent, share / 2
    for node in order:
        node.score *= 1 - (min(1.0, node.linked / node.chars) if node.chars else 0.0)
    return order


def _blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, in page order; outside an article, blocks that are mostly links are left out."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif not x.out:
            if x is not node and not x.inside and x.tag in ("ul", "ol", "div", "section", "table", "dl") and x.chars and x.linked > 0.6 * x.chars:
                end()
                continue
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.items))
    end()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page, its blocks joined by a line feed; empty for null, empty or text-free pages."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    named = [n for n in order if n.tag in ("article", "main")]
    best = max(order, key=lambda n: n.score, default=root)
    if best.score <= 0:
        best = max(named, key=lambda n: n.chars, default=root)
    up = best
    while up is not None:  # a part of one article stands for the article
        if up.tag == "article" or up.tag == "main" and not any(n.tag == "article" for n in order):
            best = up
            break
        up = up.parent
    kept = [best]
    if best.parent is not None:
        least = max(3.0, best.score * 0.2)
        kept = []
        for x in best.parent.items:
            if x is best:
                kept.append(x)
            elif isinstance(x, Node) and not x.out and x.chars:
                density = x.linked / x.chars
                if x.score >= least and density < 0.5 or x.tag == "p" and (x.chars > 80 and density < 0.25 or density == 0 and x.chars > 0 and best.tag not in ("article", "main")) or x.tag in ("h1", "h2") and best.tag not in ("article", "main"):
                    kept.append(x)
    return "\n".join(t for n in kept for t in _blocks(n))


def extract(pages: DataFrame, column: str = "html", text: str = "text") -> DataFrame:
    """Every page with its main `text`.

    Paragraphs pass points for length and commas to their container and, halved at each step, to its ancestors,
    less the share of linked characters; the best container and its good siblings are kept. Navigation, headers,
    footers, asides, forms, scripts, styles, hidden elements and what role, class or id name as boilerplate never
    count. Inside an `article` or `main`, an element with such a name as a part of its own, an article in an article,
    and a list under a heading like "Related" go where they are mostly links or less than half of the text there.
    Of containers with equal points the first counts. One row in, one row out, without a shuffle, so nothing can be hot; whole pages of any length are read,
    in time that grows with their length. A null or empty page, or one without text, has an empty text. Columns are
    kept; the new one gets a trailing `_` where its name is taken.
    """
    (name,) = fresh(pages, text)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([main_text(x) for x in column.to_pylist()], pa.string())

    return pages.withColumn(name, F.arrow_udf(run, "string")(F.col(column)))

"""Main text of web pages by scoring their tree.

A page becomes a tree. Every paragraph-like block passes points for its length
and commas to its ancestors, halved with each step up; an ancestor's points are
discounted by its link density. The best container, or the article or main element
that holds it, is kept with those of its siblings that read like text of their own;
outside articles, with all siblings in its box that aren't dense with links. Menus, footers, adverts, forms and
comments are cut before and inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: void elements, raw-text elements, blocks, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
CLOSES_LIKE = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
# Elements, roles and class words that are never part of the main text.
CUT = frozenset("nav aside footer form button select input label fieldset dialog menu object embed applet canvas audio video head".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CUT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|breadcrumbs?|comments?|comment-?list|disqus|replies|cookies?|consent|"
    r"gdpr|notices?|alerts?|announcement|overlay|paywall|pagination|pager|respond|discussion|feedback|survey|popup|modal|newsletter|subscribe|subscription|signup|sign-up|login|promo|promos|promotion|related|recommended|share|"
    r"sharing|social|sidebar|side-bar|sponsor|sponsored|menu|nav|navbar|navigation|footer|masthead|toolbar|widget|widgets|skip|skip-link)(?:$|[\s_-])"
)
#: Those of them that tell what an element is even where it holds most of a page.
SURE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|breadcrumbs?|comments?|comment-?list|disqus|replies|respond|cookies?|consent|"
    r"gdpr|pagination|pager|sidebar|side-bar|menu|nav|navbar|navigation|footer|masthead|toolbar|login|signup|sign-up)(?:$|[\s_-])"
)
#: An element that only another class word cuts is kept if it holds more than this share of the page's prose.
MOST = 0.5
PARAGRAPH = frozenset("p pre td blockquote li dd h2 h3 h4 figcaption".split())
CONTAINER = frozenset("article main section div td blockquote body html".split())
#: Layout words of wrappers, such as has-sidebar, say nothing about the element itself.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|hide|show)[-_]\S+|\S+[-_](?:layout|enabled|disabled|active)(?=\s|$)")
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])")
TAG = re.compile(r"<(?:!--.*?(?:--!?>|$)|(?=[!?])[^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)(?:[\"'][^>]*)?(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"[\s\x1c-\x1f]+")
SIBLING_SHARE = 0.2
PARENT_SHARE = 0.7
LINK_BLOCKS = frozenset("ul ol div section table dl".split())
LINK_SHARE = 0.75
#: Something beside the best container is dense with links from this share on.
DENSE = 0.5


class Node:
    __slots__ = ("name", "parent", "parts", "marks", "cut", "doubtful", "score", "size", "links", "commas", "anchors")

    def __init__(self, name: str, parent: Node | None, attributes: str = "") -> None:
        self.name, self.parent = name, parent
        self.parts: list[Node | str] = []
        self.marks, self.cut, self.doubtful = "", name in CUT, False
        self.score, self.size, self.links, self.commas, self.anchors = 0.0, 0, 0, 0, 0
        if name == "header":  # a page's header; an article's own belongs to it
            above = parent
            while above is not None and above.name not in ("article", "main"):
                above = above.parent
            self.cut = above is None
        if attributes and not attributes.isspace():
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        values = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
        self.marks = f"{values.get('class', '')} {values.get('id', '')}".lower()
        hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
        role = values.get("role", "").lower()
        if self.name not in ("html", "body"):
            self.cut |= hidden or role in CUT_ROLES
            if self.name not in ("article", "main", "p", "h1"):
                words = LAYOUT.sub(" ", self.marks)
                if not self.cut and CUT_WORDS.search(words):
                    self.cut, self.doubtful = True, not SURE_WORDS.search(words)


def parse(html: str) -> Node:
    """A tree of the page, tolerant of what isn't closed."""
    root = Node("html", None)
    at, place, end = root, 0, len(html)
    while place < end:
        m = TAG.search(html, place)
        if m is None:
            at.parts.append(unescape(html[place:]))
            break
        if m.start() > place:
            at.parts.append(unescape(html[place : m.start()]))
        place = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if m[1]:
            node = at
            while node is not None and node.name != name:
                # A block's end isn't passed by the end of something inline.
                node = None if node.name in BLOCK and name not in BLOCK else node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        if name == "html" or (name == "body" and at.name in ("html", "head")):
            at = root
            if name == "html":
                continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|$)", re.I).search(html, place)
            place = close.start() if close else end
            after = TAG.match(html, place) if close else None
            place = after.end() if after else place
            continue
        if name in CLOSES_P:
            node = at
            while node is not None and node.name != "p" and (node.name not in BLOCK):
                node = node.parent
            if node is not None and node.name == "p":
                at = node.parent
        like = CLOSES_LIKE.get(name)
        if like:
            node = at
            while node.parent is not None and node.name not in like[1]:
                if node.name in like[0]:
                    at = node.parent
                node = node.parent
        child = Node(name, at, m[3])
        at.parts.append(child)
        if name not in VOID:
            at = child
    return root


def _spare(root: Node) -> None:
    """Keep elements that a doubtful class word cuts, such as overlay or feedback, where most of the page's prose is inside."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node) and (p.doubtful or not p.cut))
    if not any(n.doubtful for n in order):
        return
    prose: dict[int, int] = {}
    for node in reversed(order):
        own = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        prose[id(node)] = 0 if node.name == "a" else own + sum(prose.get(id(p), 0) for p in node.parts if isinstance(p, Node))
    for node in order:
        if node.doubtful and prose[id(node)] > MOST * prose[id(root)]:
            node.cut = False


def _measure(root: Node) -> list[Node]:
    """Sizes, link sizes and commas of every node without what is cut, children first; returns the nodes in order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.cut)
    for node in reversed(order):
        for part in node.parts:
            if isinstance(part, str):
                node.size += len(part.strip())
                node.commas += part.count(",") + part.count("，") + part.count("、")
            elif not part.cut:
                node.size += part.size
                node.links += part.size if part.name == "a" else part.links
                node.commas += part.commas
                node.anchors += part.anchors + (part.name == "a")
    return order


def best_container(root: Node) -> Node | None:
    """The node with the most points for the paragraphs below it, discounted by its links."""
    _spare(root)
    order = _measure(root)
    candidates: list[Node] = []
    holder: dict[int, Node | None] = {}  # the nearest container above
    for node in order:
        up = node.parent
        holder[id(node)] = up if up is None or up.name in CONTAINER else holder[id(up)]
        if node.name in PARAGRAPH:
            size, commas = node.size, node.commas
        elif node.name in CONTAINER:  # text outside any paragraph counts for what holds it
            text = [p for p in node.parts if isinstance(p, str)]
            inline = [p for p in node.parts if isinstance(p, Node) and not p.cut and p.name not in BLOCK and p.name != "a"]
            size = sum(len(p.strip()) for p in text) + sum(p.size for p in inline)
            commas = sum(p.count(",") for p in text) + sum(p.commas for p in inline)
        else:
            continue
        if size:
            points = min(1.0, size / 25) * (1 + commas + min(size / 100, 3.0))
            above, share = holder[id(node)] if node.name in PARAGRAPH else node, 1.0
            while above is not None and share > 1e-9:
                if not above.score:
                    candidates.append(above)
                    above.score = 5.0 * (above.name in ("article", "main")) + 2.0 * bool(LIKELY.search(above.marks)) + 1e-9
                above.score += points * share
                share /= 2
                above = holder[id(above)]
    if not candidates:
        return None
    points = {id(n): n.score * (1 - n.links / max(n.size, 1)) for n in candidates}
    best = above = max(candidates, key=lambda n: points[id(n)])
    most = points[id(best)]
    # An article in several parts: what contains them has nearly as many points as the best part.
    while above.parent is not None:
        above = above.parent
        if points.get(id(above), 0.0) >= PARENT_SHARE * most:
            best = above
    return best


def _link_list(node: Node) -> bool:
    """A block inside the article that is little but links, such as further reading."""
    return node.name in LINK_BLOCKS and node.size > 0 and node.links > LINK_SHARE * node.size and node.anchors > 2


def _holder(best: Node) -> Node:
    """The outermost article that holds the node, else the nearest main, else the box around it, else the node."""
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    articles = [n for n in above if n.name == "article"]
    mains = [n for n in above if n.name == "main"]
    if articles or mains:
        return articles[-1] if articles else mains[0]
    return above[1] if len(above) > 1 and above[1].name in ("div", "section") else best


def _reads_like_text(part: Node, most: float) -> bool:
    """A container with a share of the best one's points in spite of its links."""
    return part.score * (1 - part.links / max(part.size, 1)) > SIBLING_SHARE * most and part.score > 10


def _dense_beside(best: Node, holder: Node) -> frozenset[int]:
    """What stands beside the way from a holder other than an article to the best container, dense with links and of few points."""
    dense, most = set(), best.score
    while best is not holder and holder.name != "article":
        beside = (p for p in best.parent.parts if isinstance(p, Node) and p is not best and not p.cut and p.size)
        dense |= {id(p) for p in beside if p.links >= DENSE * p.size and not _reads_like_text(p, most)}
        best = best.parent
    return frozenset(dense)


def _blocks(node: Node, out: list[list[str]], without: frozenset[int] = frozenset()) -> None:
    """Texts of the blocks of a subtree in page order; anything outside a block of its own starts one."""
    stack: list[tuple[Node, int]] = [(node, 0)]
    out.append([])
    while stack:
        at, i = stack.pop()
        if i < len(at.parts):
            stack.append((at, i + 1))
            part = at.parts[i]
            if isinstance(part, str):
                out[-1].append(part)
            elif not part.cut and id(part) not in without and not _link_list(part):
                if part.name in BLOCK:
                    out.append([])
                elif part.name == "br":
                    out[-1].append(" ")
                stack.append((part, 0))
        elif at.name in BLOCK and at is not node:
            out.append([])


def main_text(html: str | None) -> str:
    """The page's main text: white space inside a block as one space, blocks joined by one space."""
    if not html:
        return ""
    best = best_container(parse(html))
    if best is None:
        return ""
    out: list[list[str]] = []
    holder = _holder(best)
    without, most = _dense_beside(best, holder), max(best.score, holder.score)
    best = holder
    siblings = best.parent.parts if best.parent is not None else [best]
    for part in siblings:
        if part is best:
            _blocks(best, out, without)
        elif isinstance(part, Node) and not part.cut and best.parent.name != "html":
            dense = part.links / max(part.size, 1)
            long = part.name == "p" and part.size > 80 and dense < 0.25
            title = part.name in ("h1", "h2", "h3") and dense < 0.5 and siblings.index(part) < siblings.index(best)
            if part.name != "header" and (title or long or _reads_like_text(part, most)):
                _blocks(part, out)
    texts = (SPACES.sub(" ", "".join(b)).strip() for b in out)
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text (main text, empty if none), n_chars (its code points) of each row.

    A null page counts as empty and has no text. Null and repeated ids keep a
    row each; other columns are ignored; an empty table gives an empty result.
    The whole page is read, however long or deep.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")

"""Main text of web pages by tree scoring.

A page becomes a tree of elements whose text is held in blocks. Each paragraph-like block passes
points to its ancestors: one, one for each comma, and one for each hundred characters up to three;
the parent gets all of them, the grandparent half, the next ones a third, a quarter and so on up to ``REACH``
levels. A container's points are multiplied by one minus its link density. The best container
(or the article or main element around it) is kept together with siblings that score at least ``SIBLING`` of it or are long,
link-poor paragraphs. Elements that are never main text (by tag, role or whole words of class and id)
are cut before scoring; words that only often mark what surrounds an article cut nothing within an article or main element.

The whole html is read, in time proportional to its length. Null or empty html, and pages without text blocks, give ''.
Unclosed and stray tags follow HTML's implied ends; a tag cut off at the end of the page is dropped. From a tag on whose quotes
never end, tags end at the next > whatever their quotes. Ties
between containers go to the one that opens first. Only the page's id, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

REACH = 5
SIBLING = 0.2

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<![^>]*>?|<\?[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)", re.S)
#: The rest of an opening tag: to the first > outside quotes, or to the first at all.
_REST, _LOOSE_REST = re.compile(r"((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"), re.compile(r"([^>]*)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg noframes xmp".split())
_CUT = frozenset("nav footer aside form button select option dialog menu object canvas audio video map fieldset label".split()) | _RAW | {"head"}
_BLOCK = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SCORED = frozenset("p pre td blockquote dd li div section article main".split())
#: An opening tag of these ends an open p.
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"} | {"nav", "footer", "aside", "form", "fieldset", "menu"}
#: Kinds of elements that an opening tag ends, and the scopes beyond which it doesn't look.
_GROUPS = ((("p",), ("table", "td", "th", "button")), (("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("tr",), ("table",)), (("td", "th"), ("tr", "table")), (("option",), ("select",)))
_ENDS = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
_BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside "
    "comment comments disqus reply replies cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login hidden".split()
)
#: These mark what surrounds an article; within one they may be its own.
_OUTER_WORDS = frozenset("related recommended recommendations share sharing social widget pagination pager masthead topbar toolbar skip copyright legal tags".split())
#: Longer stems, also at the front of known compounds such as "commentlist"; "commentary" is none.
_BAD_COMPOUND = re.compile(
    r"(?:comment|sidebar|advert|cookie|footer|navbar|navigation|breadcrumb|newsletter|sponsor|promo|disqus|subscribe|subscription)(?:s|ed|ing)?"
    r"(?:list|item|box|area|section|form|thread|count|wrapper|wrap|container|content|widget|block|bar|banner|panel|inner|outer|links?|left|right|top|bottom|menu|nav|notice|consent|policy|popup|modal|overlay|text|body|author|meta|reply|respond|signup|title|header)?s?"
)
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_NEVER_CUT = frozenset(("html", "body", "article", "main"))


class _Node:
    __slots__ = ("tag", "parent", "children", "score", "chars", "link_chars", "cut", "order", "within", "near", "kept")

    def __init__(self, tag: str, parent: _Node | None, order: int):
        self.tag, self.parent, self.order, self.cut, self.kept = tag, parent, order, False, False
        self.children: list[_Node | str] = []
        self.score, self.chars, self.link_chars = 0.0, 0, 0
        #: In an article or main element; in one of those or a section.
        self.within = (tag in ("article", "main") or parent.within[0], tag in ("article", "main", "section") or parent.within[1]) if parent else (False, False)
        #: Of each group the nearest open element in scope, itself included.
        above = parent.near if parent else (None,) * len(_GROUPS)
        self.near = tuple(self if tag in tags and parent else None if tag in scopes else n for n, (tags, scopes) in zip(above, _GROUPS, strict=True))


def _is_cut(tag: str, attributes: str, parent: _Node) -> bool:
    if tag in _CUT:
        return True
    if tag == "header":
        return not parent.within[1]
    if not attributes or tag in _NEVER_CUT:
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|$|/|=)", _VALUE.sub("= ", attributes), re.I):
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and any(w in _BAD_WORDS or w in _OUTER_WORDS and not parent.within[0] or _BAD_COMPOUND.fullmatch(w) for w in re.split(r"[^a-z]+", value)):
            return True
        if name == "role" and value in _BAD_ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _tree(page: str) -> list[_Node]:
    """The page's elements in the order they open, from its root."""
    root = node = _Node("html", None, 0)
    nodes, rest, at = [root], _REST, 0
    #: Number of open elements by tag, so that a stray end tag is known without a walk.
    open_: Counter[str] = Counter()

    def leave(to: _Node) -> None:
        nonlocal node
        while node is not to:
            open_[node.tag] -= 1
            node = node.parent

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            node.children.append(text)
        if not m:
            return nodes
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if open_[tag]:
                probe = node
                while probe.tag != tag:
                    probe = probe.parent
                leave(probe.parent)
        elif m[2]:
            end = rest.match(page, at)
            if not end and rest is _REST:
                rest = _LOOSE_REST
                end = rest.match(page, at)
            if not end:
                return nodes
            tag, attributes, at = m[2].lower(), end[1], end.end()
            for group in ([0] if tag in _ENDS_P else []) + ([_ENDS[tag]] if tag in _ENDS else []):
                if node.near[group]:
                    leave(node.near[group].parent)
            if tag in ("html", "body") and "=" not in attributes:
                attributes = ""
            new = _Node(tag, node, len(nodes))
            new.cut = node.cut or _is_cut(tag, attributes, node)
            nodes.append(new)
            node.children.append(new)
            if tag in _RAW:
                raw_end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = raw_end.end() if raw_end else len(page)
            elif tag not in _VOID and not attributes.endswith("/"):
                node = new
                open_[tag] += 1


def _text_of(raw: str) -> str:
    return html.unescape(raw)


def _blocks(root: _Node) -> list[tuple[str, _Node, int]]:
    """(text, nearest block element, characters within links) in page order, cut elements left out."""
    found: list[tuple[str, _Node, int]] = []
    run: list[str] = []
    links = 0

    def flush(owner: _Node) -> None:
        nonlocal links
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            found.append((text, owner, min(links, len(text))))
        run.clear()
        links = 0

    #: (node, next child, owner, inside a link)
    stack = [[root, 0, root, False]]
    while stack:
        top = stack[-1]
        node, i, owner, linked = top
        if i == len(node.children):
            if node.tag in _BLOCK:
                flush(owner)
            stack.pop()
            continue
        top[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            # Each piece by itself: a reference doesn't go on behind a tag.
            run.append(_text_of(child))
            links += len(child.strip()) if linked else 0
        elif child.tag == "br":
            run.append(" ")
        elif child.cut:
            if child.tag in _BLOCK or child.tag in _CUT:
                flush(owner)
        else:
            if child.tag in _BLOCK:
                flush(owner)
            stack.append([child, 0, child if child.tag in _BLOCK else owner, linked or child.tag == "a"])
    flush(root)
    return found


def main_text(page: str | None) -> str:
    """The page's main text, its blocks joined by line ends."""
    nodes = _tree(page or "")
    blocks = _blocks(nodes[0])
    scored: dict[int, _Node] = {}
    for text, owner, links in blocks:
        owner.chars += len(text)
        owner.link_chars += links
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.link_chars += node.link_chars
    for text, owner, links in blocks:
        if owner.tag not in _SCORED and owner.tag != "body":
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        points *= 1 - links / len(text)
        node, level = (owner.parent if owner.tag in ("p", "pre", "li", "dd", "td", "blockquote") else owner) or owner, 1
        while node and level <= REACH:
            node.score += points / level
            scored[id(node)] = node
            node, level = node.parent, level + 1

    def worth(node: _Node) -> float:
        return node.score * (1 - node.link_chars / max(1, node.chars))

    if not scored:
        return "\n".join(t for t, _, links in blocks if links * 2 < len(t))
    best = min(scored.values(), key=lambda n: (-worth(n), n.order))
    # An article or main element around the best container is one piece of writing.
    node = best.parent
    while node:
        if node.tag in ("article", "main"):
            best = node
            break
        node = node.parent
    keep = {id(best)}
    if best.parent:
        for sibling in best.parent.children:
            if not isinstance(sibling, str) and not sibling.cut and sibling is not best and sibling.chars:
                density = sibling.link_chars / sibling.chars
                if worth(sibling) >= SIBLING * worth(best) or sibling.tag == "p" and sibling.chars > 80 and density < 0.25 or sibling.tag in ("h1", "h2") and density < 0.25:
                    keep.add(id(sibling))

    for node in nodes:
        node.kept = id(node) in keep or node.parent is not None and node.parent.kept
    return "\n".join(text for text, owner, _ in blocks if owner.kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page of (page_id, url, html); one narrow pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kinds['page_id']}, url string, text string, n_chars long")

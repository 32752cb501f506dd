"""Main text of HTML pages by minimum-cut labelling.

A page is read once into blocks of text (block elements part them) with their place
in the element tree. A block classifier gives each a log-odds of being content from
what stands around it (article, nav, class names, ...) and from its text (length, link
share, punctuation); these are the terminal capacities. Neighbouring blocks and
blocks under one parent are tied by smoothness edges. The minimum cut parts content
from boilerplate for the whole page at once.

Defined results
---------------
* null or empty html, or a page without content: text '' and n_chars 0.
* unclosed elements, stray end tags, truncated tags and entities are read as browsers
  do: an open tag at the end of the file is dropped, a reference without its semicolon
  is decoded where HTML allows it.
* very long or deep pages: read in one pass, with no limit; memory grows with the page's blocks and open elements.
* ties: a block whose odds are even, and an even cut, count as content.
* page_id may be null or repeated; each row is read by itself. Further columns are passed over.
* empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require
from .maxflow import label

# Fixed values of HTML: elements that part text into blocks, that have no content, whose content is raw (no tag in it but
# their own end tag), whose content has tags but no text to be shown, and that an opening tag closes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul button textarea object video audio canvas svg".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSHOWN = frozenset("template svg annotation annotation-xml".split())
CLOSES_P = BLOCK_TAGS - frozenset("button option optgroup object video audio canvas svg iframe noscript textarea select".split())
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: What changes the state within a script: '<!--' and a '<script' after it keep the next end tag from ending it.
SCRIPT_MARK = re.compile(r"<!(?=--)|-->|<(/?)script(?=[\s/>])", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")

# The classifier: log-odds of content. There are no labels of blocks to fit them to: they are set by hand, so that a name or an element
# outweighs what text alone can say, and are held by the markups in tests/llm/test_html.py; the driver's pages are tests only.
TAG_WEIGHT = {"article": 3.0, "main": 2.0, "nav": -7.0, "footer": -6.0, "aside": -7.0, "header": -5.0, "form": -7.0, "button": -7.0, "select": -7.0, "dialog": -7.0, "menu": -6.0, "noscript": -7.0, "search": -7.0, "label": -3.0, "legend": -3.0, "video": -7.0, "audio": -7.0, "object": -7.0, "canvas": -7.0}
#: A header or footer within an article is more often part of it.
INNER = {"header": -0.5, "footer": -4.0}
ROLE_WEIGHT = {"main": 2.0, "article": 3.0, "navigation": -7.0, "banner": -6.0, "contentinfo": -6.0, "complementary": -7.0, "search": -7.0, "dialog": -7.0, "alertdialog": -7.0, "alert": -6.0, "form": -7.0, "menu": -7.0, "menubar": -7.0, "tooltip": -6.0, "status": -5.0}
# Names (a class, or an id) are read whole; a compound is read by its last word, which says what the thing is, or by a first word
# that is used for nothing else. Names of which one tells the whole layout (has-, tag-, category-, ...) say nothing of the element.
BAD = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsors sponsored promo promos promotion promotions promoted cookie cookies consent gdpr notice notices popup popups modal modals lightbox newsletter newsletters subscribe subscription signup share sharing sidebar sidebars menu menus menubar nav navbar navbars navigation breadcrumb breadcrumbs footer footers masthead topbar toolbar comment comments commentlist disqus related recommended recommendation recommendations trending login widget widgets pagination pager tagcloud outbrain taboola dfp gpt".split()
)
#: Names that may also be the title of a part of the article: inside one they count only with entries or reply signs in them.
DOUBTFUL = frozenset("discussion replies reply respond response responses review reviews feedback rating ratings survey more popular search social side foot legal copyright disclaimer alert alerts overlay toc tags skip hidden pop".split())
FIRST = frozenset("ad ads advert adsense cookie cookies consent gdpr newsletter sidebar nav navbar menu footer comment comments disqus share sharing promo sponsored breadcrumb breadcrumbs popup modal widget outbrain taboola pagination".split())
HEAD = frozenset("header headers head".split())
GOOD = frozenset("article articles content post entry hentry story body main text prose".split())
LAYOUT = re.compile(r"(?:has|with|without|no|is|layout|tag|category|cat|term|topic|type|status|format|author|lang|theme|color)-")
#: What stands within entries that readers have left.
ENTRY = re.compile(r"(?:^|[\s_-])(?:comment|reply|replies|respons|review|author|avatar|user|commenter|vote|rating)", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
NAME_WEIGHT, DOUBTFUL_WEIGHT = -6.5, -4.0
#: Elements whose names say nothing ill of them; headings and terms often have their own title as id.
UNNAMED = frozenset("html body article main h1 h2 h3 h4 h5 h6 dt a span b i em strong code".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _raw_end(html: str, tag: str, at: int) -> int:
    """Where the end tag of a raw element begins whose content begins at ``at``; -1 without one."""
    if tag != "script":
        m = RAW_END[tag].search(html, at)
        return m.start() if m else -1
    escaped = inner = False
    for m in SCRIPT_MARK.finditer(html, at):
        mark = m.group(0)
        if mark == "<!":
            escaped = True
        elif mark == "-->":
            escaped = inner = False
        elif not m.group(1):
            inner = escaped
        elif inner:
            inner = False
        else:
            return m.start()
    return -1


def name_sign(names: list[str]) -> str:
    """What the names of an element say of it: bad, doubtful, head, good or ''."""
    found = set()
    for name in names:
        name = re.sub(r"-*\d+$", "", CAMEL.sub("-", name).lower().replace("_", "-")).strip("-")
        parts = [x for x in name.split("-") if x]
        if not parts or LAYOUT.match(name):
            continue
        last = parts[-1] if len(parts[-1]) > 1 or len(parts) == 1 else parts[-2]
        if last in BAD or parts[0] in FIRST:
            found.add("bad")
        elif last in HEAD:
            found.add("head")
        elif last in GOOD or parts[0] in ("entry", "article", "post", "story"):
            found.add("good")
        elif last in DOUBTFUL and (len(parts) == 1 or last not in ("more", "side", "foot", "pop", "skip", "hidden")):
            found.add("doubtful")
    if "doubtful" in found and "good" in found:
        found.discard("doubtful")  # an article's classes hold its topics too
    return next((x for x in ("bad", "doubtful", "head", "good") if x in found), "")


class Node:
    __slots__ = ("tag", "parent", "number", "link", "own", "sign", "names", "entries", "roots", "weight", "inside")

    def __init__(self, tag: str, parent: Node | None, number: int):
        self.tag, self.parent, self.number = tag, parent, number
        self.link = parent.link if parent else False
        self.own, self.sign, self.names = 0.0, "", False
        self.entries = self.roots = 0
        self.weight, self.inside = 0.0, False


def _mark(node: Node, attributes: str) -> None:
    """What the attributes of an element say; its weight waits until the page is read."""
    if node.tag == "a":
        node.link = True
    if not attributes or node.tag in ("html", "body"):
        return
    names = []
    for m in ATTRIBUTE.finditer(attributes):
        if m.group(5):
            node.own = min(node.own, -8.0)
            continue
        name, value = m.group(1).lower(), next((g for g in m.groups()[1:4] if g is not None), "")
        if name in ("class", "id"):
            node.names = node.names or bool(ENTRY.search(value))
            names += value.split()
        elif name == "role":
            w = ROLE_WEIGHT.get(value.strip().lower(), 0.0)
            node.own = min(node.own, w) if w < 0 else max(node.own, w)
        elif (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            node.own = min(node.own, -8.0)
    node.sign = name_sign(names) if names else ""


def weigh(nodes: list[Node]) -> None:
    """The weights of all elements of a page, parents first; ill signs add up only to the worst of them.

    A name says nothing ill of html, body and headings, and of an article or main element only where the page has
    another one; nor of an element that holds every article of the page. A doubtful name counts within an article only if
    the element has entries: items, or things named like those that readers leave.
    """
    for n in reversed(nodes):
        if n.tag in ("article", "main") and n.sign != "bad":
            n.roots += 1
        if n.names or n.tag in ("li", "article", "blockquote", "time"):
            n.entries += 1
        if n.parent is not None:
            n.parent.roots += n.roots
            n.parent.entries += n.entries
    roots = sum(n.roots for n in nodes if n.parent is not None and n.parent.parent is None)
    for n in nodes:
        above = n.parent
        base, n.inside = above.weight, above.inside
        own = INNER.get(n.tag, TAG_WEIGHT.get(n.tag, 0.0)) if n.inside else TAG_WEIGHT.get(n.tag, 0.0)
        own = min(own, n.own) if n.own < 0 else max(own, n.own) if n.own > 0 else own
        ill = n.sign in ("bad", "doubtful") and n.tag not in UNNAMED and not (roots and n.roots == roots)
        if n.tag in ("article", "main") and n.sign == "bad":
            ill = roots > 0
        if ill and n.sign == "bad":
            own = min(own, NAME_WEIGHT)
        elif ill and n.inside:
            own = min(own, NAME_WEIGHT) if n.entries - (n.names or n.tag in ("li", "article", "blockquote", "time")) > 0 else own
        elif ill:
            own = min(own, DOUBTFUL_WEIGHT)
        elif n.sign == "head" and n.tag not in UNNAMED and not (roots and n.roots == roots):
            own = min(own, -0.5 if n.inside else -5.0)
        elif n.sign == "good" and own >= 0:
            own = max(own, 1.5)
        if n.tag in ("article", "main") and own > 0:
            n.inside = True
        if own < 0:
            n.weight = min(base, 3.0) + own if base > 0 else min(base, own)
        elif own > 0 and base >= 0:
            n.weight = min(4.0, base + own)
        elif own > 0:
            n.weight = base + 0.5
        else:
            n.weight = base


class Page:
    """Blocks of a page: text, the innermost block element, and how many of their characters are in links."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, Node, float]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.count = 0
        self.top = Node("", None, 0)
        self.nodes: list[Node] = []
        self._read(html)
        weigh(self.nodes)

    def _flush(self, at: Node) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                while at.parent is not None and at.tag not in BLOCK_TAGS:
                    at = at.parent
                self.blocks.append((text, at, min(1.0, self.linked / len(text))))
            self.parts, self.linked = [], 0

    def _read(self, html: str) -> None:
        at, end = self.top, 0
        skip = ""
        next_at = 0
        while m := TOKEN.search(html, next_at):
            next_at = m.end()
            if skip:
                tag = (m.group(2) or m.group(5) or "").lower()
                if (m.group(1) or m.group(4)) and tag == skip:
                    end, skip = m.end(), ""
                elif tag in RAW and not (m.group(1) or m.group(4)) and (found := _raw_end(html, tag, m.end())) >= 0:
                    next_at = found
                continue
            if m.start() > end:
                self._text(html[end : m.start()], at)
            end = m.end()
            tag = m.group(2) or m.group(5)
            if not tag:
                continue
            tag, closing, attributes = tag.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6)
            if m.group(5) is not None and not m.group(0).endswith(">"):
                continue  # a tag that the file's end cuts off
            if closing:
                if tag in BLOCK_TAGS:
                    self._flush(at)
                node = at
                while node is not self.top and node.tag != tag:
                    if tag not in BLOCK_TAGS and node.tag in BLOCK_TAGS:
                        node = self.top
                        break
                    node = node.parent
                if node is not self.top:
                    at = node.parent
                continue
            if tag == "br":
                self.parts.append(" ")
                continue
            if tag in BLOCK_TAGS:
                self._flush(at)
            if tag in CLOSES_P:
                at = self._close(at, ("p",))
            if tag in PEERS:
                at = self._close(at, PEERS[tag])
            if tag in VOID:
                continue
            if tag in RAW or tag in UNSHOWN:
                if (attributes or "").rstrip().endswith("/"):
                    continue
                if tag in UNSHOWN:
                    skip = tag
                    continue
                found = _raw_end(html, tag, m.end())
                if found < 0:  # raw to the end of the page
                    end = len(html)
                    break
                end = next_at = TOKEN.match(html, found).end()
                continue
            self.count += 1
            node = Node(tag, at, self.count)
            _mark(node, attributes)
            self.nodes.append(node)
            at = node
        if not skip and end < len(html):
            self._text(html[end:], at)
        self._flush(at)

    def _close(self, at: Node, tags: tuple[str, ...]) -> Node:
        """Closes the nearest open element of ``tags`` if only inline elements are within it."""
        node = at
        while node is not self.top:
            if node.tag in tags:
                return node.parent
            if node.tag in BLOCK_TAGS:
                return at
            node = node.parent
        return at

    def _text(self, raw: str, at: Node) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if at.link:
            self.linked += len(text.strip())


def content_odds(text: str, node: Node, links: float) -> float:
    """The classifier's log-odds that a block is content."""
    size = text.count(" ") + 1
    odds = node.weight - 0.6 + min(2.0, size / 15) - 3.0 * links
    if node.tag in ("p", "pre", "blockquote"):
        odds += 0.8
    elif node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        odds += 0.6
    if text[-1] in ".!?…\"'”»":
        odds += 0.3
    return odds


def smoothness(blocks: list[tuple[str, Node, float]]) -> list[tuple[int, int, float]]:
    """Ties between blocks that follow each other, and between blocks under one parent."""
    edges, last = [], {}
    for i, (_, node, _) in enumerate(blocks):
        if i:
            before = blocks[i - 1][1]
            parent, other = node.parent, before.parent
            weight = 0.6 if node is before or parent is other else 0.25 if parent is not None and other is not None and (parent.parent is other or other.parent is parent) else 0.1
            edges.append((i - 1, i, weight))
        key = node.parent.number if node.parent is not None else -1
        if key in last and last[key] < i - 1:
            edges.append((last[key], i, 0.4))
        last[key] = i
    return edges


def main_text(html: str | None) -> str:
    """The blocks of a page that are content, joined by a line break."""
    if not html:
        return ""
    blocks = Page(html).blocks
    keep = label([content_odds(*b) for b in blocks], smoothness(blocks))
    return "\n".join(b[0] for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html)."""
    require(pages, "page_id", "url", "html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) if isinstance(h, str) else "" for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")

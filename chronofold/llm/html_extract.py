"""Main-text extraction from HTML by tree scoring.

A page is scanned once into a tree of block elements. Every paragraph-like block earns points
for its length and its commas; an element's score is what its own paragraphs earn plus half of
each child element's score, times one minus its link density, so that points fade on their way to the ancestors. The
best-scoring element is the article; siblings that score near it, or that are plain paragraphs,
are kept with it. Where that element lies in an article or main element, the innermost of these is the article.

Menus, site headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never count: by
tag, or by the words of a class, id or role. A class that only states something about the page (``with-sidebar``,
``comments-closed``) or stands beside a class that names an article says nothing against an element, nor does any
class word but those of comments if the element holds half of the page's paragraph points; a form that holds
half of them is a wrapper around the page.

Defined results: null or empty HTML gives an empty text; a page without any paragraph gives
whatever text is left outside the unwanted elements; unclosed and misnested tags are closed as
a browser would for blocks (``<p>`` ends an open ``<p>``); a quote or tag that never ends reaches to the next ``>``, or the
page's end if there is none; elements nested deeper than ``DEPTH`` are read as if at that depth;
texts are never shortened. The scan takes linear time on any input.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

from pyspark.sql import DataFrame

from chronofold.llm.common import arrow_map

#: Where a tag ends: quoted values may hold ``>``. Possessive, so that a failure is one pass.
_TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]*+)))?""")
#: Elements whose content is not markup, and the tag that ends each.
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in ("script", "style", "noscript", "template", "iframe", "textarea", "title")}
#: Elements open at once.
DEPTH = 512

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p pre td blockquote dd li".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose content is never article text.
UNWANTED_TAGS = frozenset("head nav footer aside form menu dialog button fieldset select svg math canvas object".split())
#: An opening tag of the key closes an open element of the named tags, up to the boundary of its list or table.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words of class, id or role that mark an element as something other than the article.
UNWANTED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promos promotion sponsor sponsored sponsors "
    "nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer bottombar colophon copyright sidebar sidebars "
    "aside widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond responses "
    "discussion complementary contentinfo search skip".split()
)
#: Those of reader comments: such an element may well be longer than the article.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond responses discussion".split())
#: A class that starts or ends with one of these states something about an element: ``has-sidebar``, ``comments-closed``.
STATES_FIRST = frozenset("with without has have no not is show hide".split())
STATES_LAST = frozenset("closed open on off enabled disabled true false".split())
GOOD_WORDS = frozenset("article content entry hentry main post story text body".split())


class _Node:
    __slots__ = ("tag", "parent", "kids", "bad", "lift", "score", "chars", "links", "points", "keep", "good", "holds_article", "bare_header")

    def __init__(self, tag: str, parent: "_Node | None"):
        self.tag, self.parent, self.kids = tag, parent, []
        self.bad = self.lift = self.keep = self.good = self.holds_article = self.bare_header = False
        self.score = self.points = 0.0
        self.chars = self.links = 0
        if parent is not None:
            parent.kids.append(self)


def _marks(value: str) -> tuple[bool, bool, bool]:
    """Whether a class, id or role names an article, something else, or reader comments."""
    good = bad = comments = False
    for token in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) if w]
        if not words or len(words) > 1 and (words[0] in STATES_FIRST or words[-1] in STATES_LAST):
            continue
        unwanted = [w for w in words if w in UNWANTED_WORDS]
        if unwanted == ["header"] and words[0] in GOOD_WORDS:  # an article's own header
            continue
        bad = bad or bool(unwanted)
        comments = comments or any(w in COMMENT_WORDS for w in unwanted)
        good = good or not unwanted and any(w in GOOD_WORDS for w in words)
    return good, bad, comments


def _describe(node: _Node, attrs: str, inside_article: bool) -> None:
    good = bad = comments = hidden = False
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            g, b_, c_ = _marks(value)
            good, bad, comments = good or g, bad or b_, comments or c_
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    if node.tag in ("html", "body"):
        pass
    elif hidden:
        node.bad = True
    elif node.tag == "header" and inside_article:
        node.bare_header = True
    elif node.tag in UNWANTED_TAGS or node.tag == "header":
        node.bad, node.lift = True, node.tag == "form"
    elif node.tag not in ("article", "main") and bad and not good:
        node.bad, node.lift = True, not comments
    node.good = node.tag in ("article", "main") or good


class _Reader:
    """The tree of a page, and its text blocks in page order with the element each belongs to."""

    def __init__(self, source: str):
        self.root = self.here = _Node("html", None)
        self.stack = [self.root]
        self.open: Counter[str] = Counter()
        self.beyond: Counter[str] = Counter()  # tags opened below DEPTH
        self.blocks: list[tuple[_Node, str]] = []
        self.parts: list[str] = []
        self.links, self.link_from, self.n_chars, self.articles = 0, -1, 0, 0
        self.read(source)

    def read(self, source: str) -> None:
        at, n, quotes = 0, len(source), True
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.parts.append(source[at:lt])
                self.n_chars += lt - at
            if lt >= n - 1:
                break
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
                continue
            closing = source[lt + 1] == "/"
            name = _TAG_NAME.match(source, lt + 1 + closing)
            if name is None:
                if closing or source[lt + 1] in "!?":
                    end = source.find(">", lt)
                    at = end + 1 if end >= 0 else n
                else:  # a plain less-than sign
                    self.parts.append("<")
                    self.n_chars += 1
                    at = lt + 1
                continue
            tag = name.group().lower()
            end = _TAG_END.match(source, name.end()) if quotes else None
            if end is not None:
                at = end.end()
            else:
                quotes = False  # some quote is never closed: from here on tags end at the next sign
                end = source.find(">", name.end())
                if end < 0:
                    break
                at = end + 1
            if closing:
                self.end(tag)
                continue
            attrs = source[name.end() : at - 1]
            if tag in _RAW_END:
                if not attrs.endswith("/"):
                    end = _RAW_END[tag].search(source, at)
                    at = end.end() if end else n
                continue
            self.start(tag, attrs)
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            text = " ".join((_html.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append((self.here, text))
                n = len(text)
                if self.link_from >= 0:
                    self.links += self.n_chars - self.link_from
                self.here.chars += n
                self.here.links += min(n, self.links)
            self.parts.clear()
        if self.link_from >= 0:
            self.link_from = 0
        self.links = self.n_chars = 0

    def close(self, k: int) -> None:
        self.flush()
        for node in self.stack[k:]:
            self.articles -= node.tag in ("article", "main")
            self.open[node.tag] -= 1
        del self.stack[k:]
        self.here = self.stack[-1]

    def push(self, node: _Node) -> None:
        self.here = node
        self.stack.append(node)
        self.open[node.tag] += 1

    def end(self, tag: str) -> None:
        if tag == "a":
            if self.link_from >= 0:
                self.links += self.n_chars - self.link_from
                self.link_from = -1
        elif self.beyond[tag]:
            self.beyond[tag] -= 1
            if tag in BLOCKS:
                self.flush()
        elif self.open[tag]:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self.close(k)
                    break
                if tag not in BLOCKS and self.stack[k].tag in BLOCKS:
                    break

    def start(self, tag: str, attrs: str) -> None:
        if tag == "a":
            if self.link_from < 0:
                self.link_from = self.n_chars
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "hr":
            self.flush()
            return
        if tag in VOID or tag in ("html", "body"):
            return
        if tag not in BLOCKS:
            if attrs or tag in UNWANTED_TAGS:
                probe = _Node(tag, None)
                _describe(probe, attrs, True)
                if probe.bad and not attrs.endswith("/"):
                    self.flush()
                    if len(self.stack) >= DEPTH:
                        self.beyond[tag] += 1
                        return
                    probe.parent = self.here
                    self.here.kids.append(probe)
                    self.push(probe)
            return
        self.flush()
        stack = self.stack
        if self.link_from >= 0 and tag in ("p", "div", "ul", "article", "main", "section", "nav", "footer"):
            self.link_from = -1 if self.here.tag not in ("li", "nav") else self.link_from
        if stack[-1].tag == "p":
            self.close(len(stack) - 1)
        elif stack[-1].tag not in BLOCKS and stack[-2].tag == "p":
            self.close(len(stack) - 2)
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            if any(self.open[t] for t in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stop:
                        break
                    if stack[k].tag in ends:
                        self.close(k)
                        break
        elif tag in HEADINGS and stack[-1].tag in HEADINGS:
            self.close(len(stack) - 1)
        if len(stack) >= DEPTH:
            self.beyond[tag] += 1
            return
        node = _Node(tag, self.here)
        _describe(node, attrs, self.articles > 0)
        if tag in ("article", "main"):
            self.articles += 1
            for up in stack:
                up.holds_article = True
        self.push(node)


def _points(text: str) -> float:
    return 1 + min(len(text) / 100, 30.0) + text.count(",") + text.count("、") + text.count("，")


def _unveto(root: _Node, own: dict[int, list[str]]) -> None:
    """Clear the marks of elements that hold half of all paragraph points, unless they are sure to be something else."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if not node.bad or node.lift:  # what is surely unwanted has no share in the page
            todo.extend(node.kids)
    for node in reversed(order):
        if node.bad and not node.lift:
            continue
        if node.tag not in HEADINGS:
            node.points += sum(_points(t) for t in own.get(id(node), ()))
        if node.parent is not None:
            node.parent.points += node.points
    for node in order:
        if node.bad and node.lift and node.points >= max(root.points / 2, 1):
            node.bad = False


def extract_text(source: str | None) -> str:
    """The main text of one page; see the module's text for the rules."""
    if not source:
        return ""
    page = _Reader(source)
    root, blocks = page.root, page.blocks
    own: dict[int, list[str]] = {}
    for node, text in blocks:
        own.setdefault(id(node), []).append(text)
    _unveto(root, own)
    order, todo = [], [(root, False)]
    while todo:
        node, dead = todo.pop()
        dead = dead or node.bad and not node.holds_article
        node.bad = dead
        if not dead:
            order.append(node)
        todo.extend((k, dead) for k in reversed(node.kids))
    best = None
    for node in reversed(order):
        base = 25.0 if node.tag in ("article", "main") else 5.0 if node.good else 0.0
        points = 0.0
        for kid in node.kids:
            if kid.bad:
                continue
            node.chars += kid.chars
            node.links += kid.links
            if kid.tag in PARAGRAPHS:
                points += kid.score
            elif kid.tag not in HEADINGS:
                points += kid.score / 2
        mine = own.get(id(node))
        if mine and node.tag not in HEADINGS:
            points += sum(map(_points, mine))
        if node.tag not in PARAGRAPHS and points:
            points += base
        node.score = points * (1 - min(1.0, node.links / node.chars)) if node.chars else 0.0
        if node.tag not in PARAGRAPHS and node.tag not in HEADINGS and node.score > 0 and (best is None or node.score >= best.score):
            best = node
    if best is None:
        best = root
    bar = best.score
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None:  # a wrapper gets half of its children's scores; nothing of an article goes for that
        best = around
    tops = [best]
    if best.parent is not None:
        seen = False
        for kid in best.parent.kids:
            seen = seen or kid is best
            if kid is best or kid.bad:
                continue
            density = kid.links / kid.chars if kid.chars else 1.0
            plain = kid.tag in ("p", "pre", "blockquote") and density < 0.25 and kid.chars > 0
            if plain or kid.score >= max(3.0, 0.2 * bar) and density < 0.5 or not seen and kid.tag in ("h1", "h2") and density < 0.5:
                tops.append(kid)
    for top in tops:
        todo2 = [(top, False)]
        while todo2:
            node, header = todo2.pop()
            header = header or node.bare_header
            if node.bad or node is not top and node.tag in ("ul", "ol", "dl", "table", "div", "section") and node.chars and node.links > 0.5 * node.chars:
                continue
            node.keep = not header or node.tag in HEADINGS
            todo2.extend((k, header) for k in node.kids)
    return "\n".join(text for node, text in blocks if node.keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col`` (the main text) and ``n_chars`` (its code points) in place of the HTML.

    A map without shuffle; every other column passes through, and input columns that already
    have the two names are replaced.
    """
    passing = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in passing] + [f"`{text_col}` string", "n_chars bigint"])

    def run(batch: dict) -> dict:
        texts = [extract_text(h) for h in batch[html_col].to_pylist()]
        return {c: batch[c] for c in passing} | {text_col: texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.select(*passing, html_col), run, schema)

"""Pages as trees of blocks, and what is measured on each of them."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

#: Fixed values of HTML: elements without content, whose content is no text, that run within a line, and
#: that end when one of the second kind begins beside them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template iframe datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img math svg object canvas audio video noscript".split()
)
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
    "p": set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
             "h6 header hgroup hr main menu nav ol p pre section table ul".split()),
}
#: Elements that such an end does not reach through.
SCOPE = frozenset("table td th ul ol dl select button html body article section div aside nav main header footer form".split())

#: Our own groups of elements and of words in class, id and role; each is one feature.
TAG_GROUPS = {
    "heading": "h1 h2 h3 h4 h5 h6 hgroup", "paragraph": "p blockquote pre figcaption", "article": "article main", "section": "section div",
    "nav": "nav menu", "aside": "aside", "header": "header", "footer": "footer address", "form": "form fieldset input select textarea button label",
    "list": "ul ol dl", "item": "li dt dd", "table": "table tbody thead tr td th caption", "text": "#text", "dialog": "dialog details summary",
    "root": "html body",
}
WORD_GROUPS = {
    "good": "article content main post entry story body text page prose blog news column document description",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager toc links tabs toolbar skip tags tag",
    "edge": "header footer masthead topbar bottom copyright colophon legal logo branding imprint",
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending more teaser complementary archive",
    "ad": "ad ads advert advertisement adverts adsense banner promo promotion promoted sponsor sponsored sponsors sponsorship commercial",
    "note": "cookie cookies consent gdpr notice notices alert popup modal overlay privacy disclaimer warning message announcement banner dialog",
    "talk": "comment comments commentlist discussion disqus reply replies respond feedback reactions thread review reviews reader",
    "form": "form search login signup signin subscribe subscription newsletter register contact poll survey",
    "share": "share sharing social follow facebook twitter like author byline meta date print email",
}
_TAG = {t: i for i, g in enumerate(TAG_GROUPS.values()) for t in g.split()}
_WORD: dict[str, list[int]] = {}
for _i, _g in enumerate(WORD_GROUPS.values()):
    for _w in _g.split():
        _WORD.setdefault(_w, []).append(_i)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARK = "data-keep"


class Node:
    __slots__ = ("children", "links", "marked", "parent", "tag", "text", "words")

    def __init__(self, tag: str, parent: Node | None, words: tuple = (), marked: str | None = None):
        self.tag, self.parent, self.words, self.marked = tag, parent, words, marked
        self.children: list[Node] = []
        self.text: list[str] = []  # of a #text node: pieces of one run of a line
        self.links = 0


class _Builder(HTMLParser):
    """Blocks become nodes; what runs within a line becomes text of a #text node."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.at = self.root
        self.open: list[tuple[str, Node]] = []  # all open elements, inline and hidden ones too
        self.hidden = self.link = 0
        # Places in `open`: of each name, of what runs not within a line, of what ends others or is ended.
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.ends: list[int] = []

    def _opened(self, tag: str) -> None:
        at = len(self.open)
        self.open.append((tag, self.at))
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        if tag in SCOPE or tag in ENDED_BY:
            self.ends.append(at)

    def _forgotten(self, at: int) -> None:
        self.places[self.open[at][0]].pop()
        for places in (self.blocks, self.ends):
            if places and places[-1] == at:
                places.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br" or tag == "wbr":
            self._text(" " if tag == "br" else "")
            return
        if tag in ("html", "body"):
            if tag == "body" and self.hidden:
                self.hidden = 0  # a head that was not closed ends here
                kept, self.open, self.places, self.blocks, self.ends = [x for x in self.open if x[0] not in HIDDEN], [], {}, [], []
                now = self.at
                for name, self.at in kept:
                    self._opened(name)
                self.at = now
            return
        # A row ends the cell and the row before it; so no element stands twice between two scopes here.
        while self.ends:
            at = next((i for i in reversed(self.ends) if tag in ENDED_BY.get(self.open[i][0], ()) or self.open[i][0] in SCOPE), None)
            if at is None or tag not in ENDED_BY.get(self.open[at][0], ()):
                break
            self._close(at)
        if tag in VOID:
            return
        self._opened(tag)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "a":
            self.link += 1
        elif tag not in INLINE and not self.hidden:
            found: list[int] = []
            mark = None
            for name, value in attrs:
                if name in ("class", "id", "role", "aria-label", "itemprop") and value:
                    for w in _SPLIT.findall(value):
                        found += _WORD.get(w.lower(), ())
                elif name == MARK:
                    mark = value
            node = Node(tag, self.at, tuple(found), mark)
            self.at.children.append(node)
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash on an element that is not void means nothing

    def handle_endtag(self, tag: str) -> None:
        places = self.places.get(tag)
        # The end of an element within a line does not reach out of the block it stands in.
        if places and not (tag in INLINE and self.blocks and self.blocks[-1] > places[-1]):
            self._close(places[-1])

    def _close(self, i: int) -> None:
        for at in range(len(self.open) - 1, i - 1, -1):
            tag, before = self.open[at]
            self._forgotten(at)
            if tag in HIDDEN:
                self.hidden = max(0, self.hidden - 1)
            elif tag == "a":
                self.link = max(0, self.link - 1)
            elif tag not in INLINE and not self.hidden:
                self.at = before
        del self.open[i:]

    def handle_data(self, data: str) -> None:
        self._text(data)

    def _text(self, data: str) -> None:
        if self.hidden:
            return
        kids = self.at.children
        if not kids or kids[-1].tag != "#text":
            if data == "" or data.isspace():
                return
            kids.append(Node("#text", self.at))
        kids[-1].text.append(data)
        if self.link:
            kids[-1].links += len(data)


def parse(html: str) -> Node:
    """The tree of blocks. Character references are decoded; markup that is not closed ends where HTML
    ends it or at the end of the page; a page without markup is one run of text."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def flatten(root: Node) -> list[Node]:
    """Nodes in page order, parents first; without recursion, so deep pages are fine."""
    out, rest = [], [root]
    while rest:
        node = rest.pop()
        out.append(node)
        rest.extend(reversed(node.children))
    return out


def node_text(node: Node) -> str:
    return " ".join("".join(node.text).split())


N_TAGS, N_WORDS = len(TAG_GROUPS), len(WORD_GROUPS)
N_FEATURES = 2 * N_TAGS + 3 * N_WORDS + 27


def measured(nodes: list[Node]) -> tuple[list[list[float]], list[int]]:
    """Features of every node and the index of its parent (-1 for the root)."""
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    parent = [place[id(x.parent)] if x.parent is not None else -1 for x in nodes]
    chars, links, words, stops, tags, paras, items, upper, heads, largest = ([0] * n for _ in range(10))
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#text":
            t = "".join(x.text)
            w = t.split()
            chars[i], links[i], words[i] = len(t), x.links, len(w)
            stops[i] = t.count(".") + t.count(",") + t.count("?") + t.count("!")
            upper[i] = sum(c[0].isupper() for c in w)
        else:
            tags[i] += 1
            paras[i] += x.tag == "p"
            items[i] += x.tag == "li"
            heads[i] += x.tag in ("h1", "h2", "h3")
        if (p := parent[i]) >= 0:
            for a in (chars, links, words, stops, tags, paras, items, upper, heads):
                a[p] += a[i]
            largest[p] = max(largest[p], chars[i])
    depth = [0] * n
    before, order, count = [0] * n, [0] * n, [0] * n  # characters before a node; place among siblings
    seen, same = 0, {}
    above_t, above_w = [frozenset()] * n, [frozenset()] * n  # groups of all ancestors; shared, not copied
    for i, x in enumerate(nodes):
        p = parent[i]
        before[i] = seen
        if x.tag == "#text":
            seen += chars[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            count[i] = len(nodes[p].children)
            group, own = _TAG.get(nodes[p].tag), nodes[p].words
            above_t[i] = above_t[p] if group is None or group in above_t[p] else above_t[p] | {group}
            above_w[i] = above_w[p] if above_w[p].issuperset(own) else above_w[p].union(own)
            key = (p, x.tag)
            order[i] = same.get(key, 0)
            same[key] = order[i] + 1
    all_chars, all_words = max(1, chars[0]), max(1, words[0])
    out = []
    for i, x in enumerate(nodes):
        p = parent[i]
        f = [0.0] * N_FEATURES
        f[_TAG.get(x.tag, 3)] = 1.0
        for t in above_t[i]:
            f[N_TAGS + t] = 1.0
        at = 2 * N_TAGS
        for w in x.words:
            f[at + w] = 1.0
        for w in above_w[i]:
            f[at + N_WORDS + w] = 1.0
        if p >= 0:
            prior = nodes[p].words
            for w in prior:
                f[at + 2 * N_WORDS + w] = 1.0
        c, w, t = chars[i], words[i], tags[i]
        pc, pt = (chars[p], tags[p]) if p >= 0 else (c, t)
        f[-27:] = [
            math.log1p(c), math.log1p(w), c / all_chars, w / all_words, links[i] / max(1, c), stops[i] / max(1, w), upper[i] / max(1, w),
            math.log1p(c / (t + 1)), math.log1p(t), math.log1p(paras[i]), math.log1p(items[i]), math.log1p(heads[i]), depth[i], count[i],
            order[i], before[i] / all_chars, c / max(1, pc), (t + 1) / (pt + 1), same.get((p, x.tag), 1), len(x.children),
            w / max(1, paras[i] + items[i] + heads[i]), (links[p] / max(1, pc)) if p >= 0 else 0.0, math.log1p(pc),
            math.log1p(paras[p]) if p >= 0 else 0.0, math.log1p(largest[p] if p >= 0 else c), math.log1p(all_chars),
            math.log1p(paras[0]),
        ]
        out.append(f)
    return out, parent

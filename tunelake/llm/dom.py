"""A small tolerant HTML reader: the element tree with text leaves, and features of its nodes."""

import re
from html import unescape

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_WORDS = re.compile(r"[a-z]+")
_NAMED = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

# fixed values: elements of HTML by how their content is read
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())  # to the closing tag, or to the end
UNSEEN = set("iframe select template".split())  # left out where they are closed, else elements as others
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr br img"
    " math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
_CLOSING = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: The next tag of that name: a closing one has group 1, an opening one has not.
_EITHER = {tag: re.compile(rf"<(/)?{tag}\b[^>]*(?:>|\Z)", re.I) for tag in UNSEEN}
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPE = {"ul", "ol", "dl", "table", "tr", "tbody", "thead", "article", "section", "div", "body", "main", "td"}
# fixed values: names of containers, as elements and as words of class, id and role
GROUPS = [
    {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"},
    {"a"}, {"article", "main"}, {"nav", "footer", "aside", "form", "button", "dialog", "fieldset"}, {"header"},
    {"section", "div"}, {"table", "tbody", "tr", "td", "th", "thead"}, {"html", "body"}, {"#text"},
    {"figure", "figcaption", "img"},
]
CONTENT_WORDS = set("article content entry main post story text body prose markdown articlebody maincontent".split())
OTHER_WORDS = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments comentarios"
    " consent cookie cookies copyright disclaimer disqus dropdown footer form gdpr header headerbar login logo menu"
    " menubar modal nav navbar navigation newsletter notice notification overlay pager pagination popup privacy promo"
    " promoted rail recommend recommended register related replies reply respond search share sharing sidebar sidenav"
    " signup skip social sponsor sponsored subscribe subscription tags teaser toolbar toc tooltip topbar tracking"
    " widget widgets complementary contentinfo alert".split()
)
ARTICLE = GROUPS[5]
_GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}


class Page:
    """Nodes in document order, as lists: tag, parent, words of the attributes, text (leaves only).

    `block` numbers the text leaves: leaves of one block have one number.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.words, self.text, self.block = ["#root"], [-1], [()], [""], [-1]
        self.hidden = [False]
        self._stack, self._block, self._open_ended = [0], 0, set()
        self._read(html)

    def _add(self, tag, words=(), text="", hidden=False):
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.words.append(words)
        self.text.append(text)
        self.block.append(self._block if text else -1)
        self.hidden.append(hidden)
        return len(self.tag) - 1

    def _text(self, raw: str, decoded: bool = False):
        if raw:
            text = raw if decoded else unescape(raw)
            if not text.isspace():
                self._add("#text", text=text)
            else:  # keeps words of two inline elements apart
                self._add("#space", text=" ")

    def _pop_to(self, tags, stop):
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[i]]
            if tag in tags:
                del self._stack[i:]
                return
            if tag in stop:
                return

    def _read(self, html: str):
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m.group(1):
                self._text(m.group(1), decoded=True)
            name = m.group(3) or m.group(6)
            if not name:
                continue
            tag, attributes = name.lower(), m.group(4) or m.group(7) or ""
            if m.group(2) or m.group(5):
                if tag not in INLINE:
                    self._block += 1
                self._pop_to({tag}, {"td", "table"} if tag in ("p", "li") else ())
            else:
                at = self._open(tag, attributes, html, at)

    def _open(self, tag, attributes, html, at):
        if tag not in INLINE:
            self._block += 1
        if tag in CLOSES_P:
            self._pop_to({"p"}, SCOPE - {"section", "div", "article", "main"})
        if tag in CLOSED_BY:
            self._pop_to(CLOSED_BY[tag], SCOPE - CLOSED_BY[tag] - {"tr", "tbody", "thead"} | {"table"})
        words, hidden = (), False
        if attributes:
            found = [(k.lower(), (v or "").strip("\"'").lower()) for k, v in _NAMED.findall(attributes)]
            words = tuple(w for k, v in found if k not in ("style", "hidden") for w in _WORDS.findall(v))
            hidden = any(k == "hidden" or k == "style" and "display:none" in v.replace(" ", "") for k, v in found)
        if tag == "br":
            self._add("#space", text=" ")
        elif tag in VOID or attributes.endswith("/") and tag not in CLOSES_P:
            pass
        elif tag in RAW:
            end = _CLOSING[tag].search(html, at)
            at = end.end() if end else len(html)
        else:
            end = _EITHER[tag].search(html, at) if tag in UNSEEN and tag not in self._open_ended else None
            if end and end.group(1):
                return end.end()
            if tag in UNSEEN and not end:
                self._open_ended.add(tag)  # none further on is closed either
            self._stack.append(self._add(tag, words, hidden=hidden))
        return at

    def blocks(self, keep) -> list[str]:
        """Texts of the blocks whose leaves are kept, white space collapsed, empty ones left out."""
        out, last = [], None
        for i, block in enumerate(self.block):
            if block >= 0 and keep[i]:
                if block != last:
                    out.append([])
                    last = block
                out[-1].append(self.text[i])
        return [t for t in (" ".join("".join(parts).split()) for parts in out) if t]


FEATURES = len(GROUPS) * 2 + 20


def features(page: Page, plain: bool = False) -> np.ndarray:
    """A row per node. `plain`: as if elements and attributes had no telling names."""
    n = len(page.tag)
    parent = page.parent
    length, links, ends, leaves, inside = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    good, bad = [0] * n, [0] * n
    for i in range(n):
        text = page.text[i]
        if text and page.tag[i] == "#text":
            length[i] = len(text)
            ends[i] = sum(map(text.count, ".,;:!?"))
            leaves[i] = 1
        if not plain and page.words[i]:
            good[i] = sum(w in CONTENT_WORDS for w in page.words[i])
            bad[i] = sum(w in OTHER_WORDS for w in page.words[i])
    under_link = [False] * n
    for i in range(1, n):
        under_link[i] = page.tag[i] == "a" or under_link[parent[i]]
        if under_link[i]:
            links[i] = length[i]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        length[p] += length[i]
        links[p] += links[i]
        ends[p] += ends[i]
        leaves[p] += leaves[i]
        inside[p] += inside[i] + 1
    depth, above_good, above_bad, child, children = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        named = 0 if plain else _GROUP.get(page.tag[i], -1)
        above_good[i] = above_good[p] + good[i] + (named == 5)
        above_bad[i] = above_bad[p] + bad[i] + (named == 6)
        child[i] = children[p]
        children[p] += 1
    group = np.array([_GROUP.get(t, -1) for t in page.tag])
    if plain:
        group[(group >= 5) & (group <= 7)] = 8
    up = np.array(parent)
    up[0] = 0
    arrays = [np.array(a, float) for a in (length, links, ends, leaves, inside)]
    size, link, end, leaf, sub = arrays
    siblings = np.maximum(np.array(children, float)[up], 1)
    neighbour = np.zeros((n, 2))
    before = {}
    for i in range(1, n):
        p = parent[i]
        if p in before:
            neighbour[i, 0] = length[before[p]]
            neighbour[before[p], 1] = length[i]
        before[p] = i
    total = max(length[0], 1)
    one = lambda g: (g[:, None] == np.arange(len(GROUPS))).astype(float)
    columns = [
        np.log1p(size), link / np.maximum(size, 1), end / np.maximum(size, 1) * 10, np.log1p(leaf), np.log1p(sub),
        size / np.maximum(leaf, 1) / 100, size / (sub + 1) / 100, size / total, np.array(depth, float),
        np.array(child, float) / siblings, np.log1p(siblings), np.log1p(size[up]), (link / np.maximum(size, 1))[up],
        np.log1p(neighbour[:, 0]), np.log1p(neighbour[:, 1]), np.array(good, float), np.array(bad, float),
        np.array(above_good, float), np.array(above_bad, float), np.array(page.hidden, float),
    ]
    return np.concatenate([one(group), one(group[up]), np.stack(columns, 1)], axis=1)


def marked(page: Page) -> np.ndarray:
    """Labels from a page's own marking: 1 for nodes of the article and what holds it, else 0.

    The article is the outermost element named so (or the body, if none is), without what is
    named as menu, footer, form, advert, comment and the like, or header outside of the article.
    """
    n = len(page.tag)
    named = lambda i: page.tag[i] in ARTICLE or bool(CONTENT_WORDS.intersection(page.words[i]))
    other = lambda i: page.tag[i] in GROUPS[6] or page.hidden[i] or bool(OTHER_WORDS.intersection(page.words[i]))
    off, within, found = [False] * n, [False] * n, False
    for i in range(1, n):
        above = page.tag[i] == "header" and not within[page.parent[i]]
        off[i] = off[page.parent[i]] or (page.tag[i][0] != "#" and (above or other(i)))
        within[i] = within[page.parent[i]] or (page.tag[i][0] != "#" and named(i) and not off[i])
        found |= within[i]
    labels = np.array([not o and (w or not found) for o, w in zip(off, within, strict=True)], np.int64)
    for i in range(n - 1, 0, -1):  # what holds the article, but not texts beside it
        if labels[i]:
            labels[page.parent[i]] = 1
    return labels

"""Block-level DOM of a page: a forgiving tokenizer, implied end tags, and what the model looks at."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"""<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)"""
)
SPACE = re.compile(r"\s+")
STOPS = re.compile(r"[.!?;:](?:\s|\Z)")

BLOCKS = (
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption "
    "figure figcaption header footer nav aside form fieldset address details summary hgroup menu dialog center search"
).split()
BLOCK_CODE = {t: i for i, t in enumerate(BLOCKS)}
DROPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "video", "audio", "select", "textarea", "button", "title", "datalist"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
#: What may stand in a head; anything else ends it, as a page may leave both </head> and <body> out.
HEAD = {"html", "head", "meta", "link", "base", "title", "style", "script", "noscript", "template"}
#: What ends an svg or math that was left open, unless inside one of its parts that hold HTML.
BREAKS_OUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_HTML = {"foreignobject", "desc", "annotation-xml"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "html", "body"}

#: Words of class, id and role names, by what they say of an element.
NAMES = {
    "content": "article content post entry story main body text prose copy lede abstract",
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip sitemap",
    "head": "header masthead topbar branding logo hero",
    "foot": "footer foot copyright legal colophon imprint",
    "side": "sidebar aside rail widget complementary secondary related recommended recommend more popular trending tags",
    "advert": "ad ads advert advertisement advertising sponsor sponsored banner promo promotion adslot adbox dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast disclaimer paywall announcement dialog",
    "form": "form search login signin signup subscribe subscription newsletter register contact poll",
    "reader": "comment comments reply replies disqus discussion respond thread feedback reader review reviews",
    "share": "share sharing social follow meta byline author avatar bio date timestamp print toolbar rating",
}
NAME_GROUP = {w: i for i, words in enumerate(NAMES.values()) for w in words.split()}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|data-y)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""\bstyle\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
_names: dict[str, tuple[int, int | None]] = {}


def names_of(attributes: str) -> tuple[int, int | None]:
    """Bits of the groups that an element's names belong to (the last: hidden), and its label if it is a training page's."""
    if not attributes or attributes == "/":
        return 0, None
    got = _names.get(attributes)
    if got is None:
        bits, label = 0, None
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "data-y":
                label = int(value) if value in ("0", "1") else None
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                bits |= 1 << len(NAMES)
            else:
                for w in _WORD.findall(value):
                    g = NAME_GROUP.get(w.lower())
                    if g is not None:
                        bits |= 1 << g
        if _HIDDEN.search(attributes):
            bits |= 1 << len(NAMES)
        got = bits, label
        if len(_names) > 50_000:
            _names.clear()
        if len(attributes) < 500:
            _names[attributes] = got
    return got


class Open:
    """Names open inside each other, with the places of each, so none is ever looked for."""

    __slots__ = ("names", "places")

    def __init__(self):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def last(self, *names: str) -> int:
        """The innermost place of any of the names; -1 if none is open."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def cut(self, place: int) -> None:
        """What is open from a place on ends."""
        while len(self.names) > place:
            self.places[self.names.pop()].pop()


class Page:
    """Block elements in page order and the text blocks directly inside them.

    Every element and closing tag takes constant time but for what it closes, so a page takes time in
    proportion to its length, however deep or broken.  ``data-y`` attributes are labels on training pages
    only; on others they are attributes like any other.
    """

    __slots__ = ("blocks", "label", "level", "links", "names", "parent", "stops", "tag", "words")

    def __init__(self, source: str, labelled: bool = False):
        self.parent, self.tag, self.names, self.level = [-1], [BLOCK_CODE["html"]], [0], [0]
        self.label: list[int | None] | None = [None] if labelled else None
        self.words, self.links, self.stops = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        names, label = names_of(attributes)
        self.parent.append(parent)
        self.level.append(self.level[parent] + 1)
        self.tag.append(BLOCK_CODE[tag])
        self.names.append(names)
        if self.label is not None:
            self.label.append(label)
        self.words.append(0)
        self.links.append(0)
        self.stops.append(0)
        return len(self.tag) - 1

    def _read(self, s: str) -> None:
        stack = Open()
        stack.push("html")
        node_of = [0]  # the element at each place
        held: list[str] = []
        linked = at = 0
        dropped = Open()  # the dropped element and what is open in it
        head = False
        endless: set[str] = set()  # raw elements that no end tag follows
        match, n = TOKEN.search, len(s)

        def raw_end(tag: str, at: int) -> int | None:
            end = None if tag in endless else RAW_END[tag].search(s, at)
            if end is None:
                endless.add(tag)
            return end and end.end()

        def cut(place: int) -> None:
            stack.cut(place)
            del node_of[place:]

        def flush() -> None:
            if held:
                text = SPACE.sub(" ", html.unescape("".join(held))).strip()
                held.clear()
                if text:
                    node = node_of[-1]
                    self.blocks.append((node, text))
                    self.words[node] += text.count(" ") + 1
                    self.stops[node] += len(STOPS.findall(text))

        while at < n:
            m = match(s, at)
            if m is None:
                if not dropped.names:
                    held.append(s[at:])
                break
            if m.start() > at and not dropped.names:
                part = s[at : m.start()]
                head = head and part.isspace()
                held.append(part)
                if linked:
                    self.links[node_of[-1]] += len(part.split())
            at = m.end()
            tag = m.group(2) or m.group(5)
            if tag is None:
                continue
            tag, closing, attributes = tag.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
            if head and (tag == "body" or closing and tag == "head"):
                dropped.cut(0)
            if dropped.names and closing:
                place = dropped.last(tag)
                if place >= 0:
                    dropped.cut(place)
                    continue
                if tag not in BLOCK_CODE or stack.last(tag) < 0:
                    continue
                dropped.cut(0)  # an enclosing block ends, and with it what was left open inside
            elif dropped.names:
                while dropped.names and dropped.names[-1] in ("svg", "math") and tag in BREAKS_OUT:
                    dropped.cut(len(dropped.names) - 1)
                if dropped.names:
                    if tag in RAW:
                        at = (None if attributes.endswith("/") else raw_end(tag, at)) or at
                    elif (tag in DROPPED or tag in BLOCK_CODE or tag in HOLDS_HTML) and not attributes.endswith("/") and (tag not in ("button", "select") or dropped.last(tag) < 0):
                        dropped.push(tag)
                    continue
            if tag == "head" and not closing:
                head = True
                continue
            if head:
                if closing and tag not in ("head", "body", "html", "br"):
                    continue
                head = not closing and tag in HEAD
            if tag in DROPPED:
                if not closing and not attributes.endswith("/"):
                    if tag in RAW:
                        at = raw_end(tag, at) or n
                    else:
                        dropped.push(tag)
                continue
            if tag not in BLOCK_CODE:
                if tag == "a":
                    linked = 0 if closing else 1
                elif tag in ("br", "hr", "img", "input"):
                    held.append(" ")
                continue
            flush()
            linked = 0
            if closing:
                place = stack.last(tag)
                if place > 0:
                    cut(place)
                continue
            if tag == "html" or tag == "body" and stack.last(tag) > 0:
                continue
            if stack.names[-1] == "p":
                cut(len(node_of) - 1)
            ends = CLOSES.get(tag)
            while ends:
                place = stack.last(*ends)
                if place <= max(stack.last(*SCOPE), 0):
                    break
                cut(place)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
            stack.push(tag)
            node_of.append(self._open(tag, attributes, node_of[-1]))
        flush()

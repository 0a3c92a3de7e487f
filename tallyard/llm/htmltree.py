"""A forgiving HTML reader for small per-row work: tags to a tree of plain nodes."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

#: Name and attributes of a tag; quotes count after an equals sign only. Possessive, so nothing is read twice.
TAG = re.compile(r"(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
PLAIN_TAG = re.compile(r"(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "template tfoot th thead title tr ul".split()
)
#: A start tag of the key ends an open element of these names ...
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: ... unless one of these stands between.
SCOPE = frozenset("ul ol dl table select html body article section div main aside nav header footer form".split())
#: A start tag of a block ends an open paragraph unless one of these stands between.
HOLDS = SCOPE | frozenset("li td th dd button".split())
#: Elements that hold a story.
STORY = frozenset(("article", "main"))


class Node:
    __slots__ = ("tag", "attrs", "parent", "inside", "children")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.inside = parent is not None and (parent.inside or parent.tag in STORY)
        self.children: list[Node | str] = []

    def get(self, name: str, default: str = "") -> str:
        for m in ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(next((x for x in m.groups()[1:] if x is not None), ""))
        return default


def _tags(html: str):
    """(start, stop, match or None) of tags, comments and declarations, in order; each character is read a bounded number of times."""
    at, pattern = 0, TAG
    while (at := html.find("<", at)) >= 0:
        stop = match = None
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            stop = len(html) if end < 0 else end + 3
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at)
            stop = len(html) if end < 0 else end + 1
        elif html[at + 1 : at + 2].isalpha() or html[at + 1 : at + 2] == "/":
            match = pattern.match(html, at + 1)
            if match is None and pattern is TAG and (match := PLAIN_TAG.match(html, at + 1)):
                pattern = PLAIN_TAG  # a quote without its end: from here on, quotes don't count
            if match is None and html.find(">", at) < 0:
                return  # no tag ends after this
            stop = match.end() if match else None
        if stop is None:
            at += 1
        else:
            moved = yield at, stop, match
            at = max(stop, moved or 0)
            yield  # the answer to send


class _Open:
    """The open elements, with the depths of those that end tags and new elements look for, so that none climbs."""

    def __init__(self, root: Node):
        self.path = [root]
        self.named: dict[str, list[int]] = {}
        self.of = {"scope": [0], "hold": [0], "block": [0]}

    def _lists(self, tag: str) -> list[list[int]]:
        sets = (("scope", SCOPE), ("hold", HOLDS), ("block", BLOCK))
        return [self.named.setdefault(tag, []), *(self.of[name] for name, tags in sets if tag in tags)]

    def push(self, node: Node) -> None:
        for depths in self._lists(node.tag):
            depths.append(len(self.path))
        self.path.append(node)

    def close(self, depth: int) -> None:
        """Closes the element at ``depth`` and all below it."""
        while len(self.path) > depth:
            for depths in self._lists(self.path.pop().tag):
                depths.pop()

    def end(self, tag: str) -> None:
        """An end tag: the nearest element of that name, but an inline one doesn't close blocks."""
        depths = self.named.get(tag)
        if depths and (tag in BLOCK or self.of["block"][-1] < depths[-1]):
            self.close(depths[-1])

    def start(self, tag: str) -> None:
        """A start tag ends what can't hold it."""
        if tag in BLOCK and (p := self.named.get("p")) and p[-1] > self.of["hold"][-1]:
            self.close(p[-1])
        if tag in ENDS:
            scope = self.of["scope"][-1]
            found = [d[i] for x in ENDS[tag] if (d := self.named.get(x)) and (i := bisect_right(d, scope)) < len(d)]
            if found:
                self.close(min(found))


def parse(html: str) -> Node:
    """The root of the tree; text children are raw, with references undecoded."""
    root = Node("#root")
    at, opened = 0, _Open(root)
    tags = _tags(html)
    for start, stop, m in tags:
        if start > at:
            opened.path[-1].children.append(html[at:start])
        at = stop
        moved = None
        if m is not None:
            tag = m["tag"].lower()
            if m["end"]:
                opened.end(tag)
            else:
                opened.start(tag)
                here = opened.path[-1]
                node = Node(tag, m["attrs"] or "", here)
                here.children.append(node)
                if tag in RAW:
                    ended = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    node.children.append(html[at : ended.start() if ended else len(html)])
                    at = moved = ended.end() if ended else len(html)
                elif tag not in VOID:
                    opened.push(node)
        tags.send(moved)
    if at < len(html):
        opened.path[-1].children.append(html[at:])
    return root


def walk(root: Node, skip=None):
    """(event, item) in page order: ('open', node), ('text', str), ('close', node); no recursion."""
    stack: list[tuple[str, Node | str]] = [("open", root)]
    while stack:
        event, item = stack.pop()
        if event == "open" and skip is not None and skip(item):
            continue
        yield event, item
        if event == "open":
            stack.append(("close", item))
            stack.extend(("text" if isinstance(x, str) else "open", x) for x in reversed(item.children))


def blocks(root: Node, skip=None) -> list[str]:
    """Decoded texts of the blocks below ``root``, white space squeezed, empty ones left out."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        if part:
            if text := " ".join(unescape("".join(part)).split()):
                out.append(text)
            part.clear()

    for event, item in walk(root, skip):
        if event == "text":
            part.append(item)
        elif item.tag == "br":
            part.append(" ")
        elif item.tag in BLOCK:
            flush()
    flush()
    return out

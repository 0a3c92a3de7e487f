"""Main text of web pages by tree scoring.

Boilerplate elements are recognised by tag, role and the words of class and id, and
left out, unless they hold most of the page's scored paragraphs. Names that stories use too
(``SOFT``, as in entry-header or notice-board) keep an element from scoring; within the
container that wins, it stays if it has a title or reads as prose. Names of states, as in
has-sidebar, say nothing. Each paragraph then earns points, one plus one for each comma and for each hundred characters (three at most), and
passes them to its nearest ``LEVELS`` ancestors: all to the parent, half to the
grandparent, a third and so on. A container's points are discounted by the share of its
text that stands in links; article and main elements get a bonus. The best container is
kept with those of its siblings that score well enough or are paragraphs of prose; where
the container's only company is a parent that adds headings or prose outside links, as
an article does around its body, the parent takes its place. Lists of links without a name
are menus, unless prose of the story stands ahead of them. Every step is linear in the page.

Defined results: null, empty and markup-only html give the empty text; pages whose
paragraphs are all too short to score keep what isn't boilerplate; repeated rows are
extracted each; columns other than page_id, url and html are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.llm.common import slices
from tallyard.llm.htmltree import RAW, Node, blocks, parse, walk

# fixed values
DROPPED_TAGS = RAW | frozenset("head nav footer aside form button select input option dialog menu template svg canvas object embed audio video noscript".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha combx comment comments commentlist consent "
    "cookie cookies disqus discussion footer footnav gdpr header hidden login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination pingback popup promo promotion recommended related reply replies respond respondent "
    "share sharing shoutbox sidebar signup social sponsor sponsored subscribe subscription toolbar trackback widget".split()
)
#: Of these, names that parts of a story have too, when other words stand beside them; a header's always.
SOFT = frozenset("banner header masthead notice notices notification".split())
#: Words that make a name one of a state of the page.
STATES = frozenset("has with without no enabled disabled open closed".split())
NEVER_DROPPED = frozenset("#root html body article main h1".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h2 h3 h4 figcaption div section article".split())
#: Characters below which a paragraph earns nothing; from which on an element with a doubtful name reads as prose.
LEAST, PROSE = 25, 60
#: Ancestors that get points of a paragraph; factor of article and main; share of prose that spares a name; share of the best score that widens it.
LEVELS, BONUS, MOST, CLOSE = 8, 1.25, 0.5, 0.75

WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")


KEEP, SOFTLY, DROP = range(3)


def _kind(node: Node) -> int:
    """Whether an element is boilerplate by its tag, role and names."""
    if node.tag in DROPPED_TAGS or (node.tag == "header" and not node.inside):
        return DROP
    if node.tag in NEVER_DROPPED and node.tag != "article":
        return KEEP
    attrs = node.attrs
    if not attrs or not attrs.strip():
        return KEEP
    low = attrs.lower()
    if "role" in low and node.get("role").lower() in DROPPED_ROLES:
        return DROP
    if "hidden" in low and (re.search(r"(?:^|\s)hidden(?:\s|=|$)", low) or node.get("aria-hidden") == "true"):
        return DROP
    if "style" in low and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", node.get("style").lower()):
        return DROP
    if "class" in low or "id" in low:
        return max(map(_name_kind, f"{node.get('class')} {node.get('id')}".split()), default=KEEP)
    return KEEP


def _name_kind(name: str) -> int:
    words = frozenset(WORDS.findall(CAMEL.sub(r"\1 \2", name).lower()))  # camelCase names count as words too
    dropped = words & DROPPED_WORDS
    if not dropped or words & STATES:
        return KEEP
    return SOFTLY if dropped <= SOFT and (len(words) > len(dropped) or "header" in dropped) else DROP


def _measure(root: Node, skip):
    """Length and linked length of each node's text, points of each container, and the paragraphs that gave some."""
    length: dict[Node, int] = defaultdict(int)
    linked: dict[Node, int] = defaultdict(int)
    commas: dict[Node, int] = defaultdict(int)
    points: dict[Node, float] = defaultdict(float)
    own: dict[Node, int] = defaultdict(int)
    scored: set[Node] = set()
    links = 0
    stack: list[Node] = []
    around: list[Node] = []  # of each open element, the paragraph that its text belongs to
    for event, item in walk(root, skip):
        if event == "open":
            stack.append(item)
            around.append(item if item.tag in PARAGRAPHS or not around else around[-1])
            links += item.tag == "a"
        elif event == "text":
            n = len(" ".join(item.split()))
            if n and stack:
                node = stack[-1]
                length[node] += n
                commas[node] += item.count(",") + item.count("，") + item.count("、")
                linked[node] += n * bool(links)
                own[around[-1]] += n
        else:
            stack.pop()
            around.pop()
            links -= item.tag == "a"
            if item.tag in PARAGRAPHS and own[item] >= LEAST:
                scored.add(item)
                score = 1 + commas[item] + min(length[item] // 100, 3)
                # a block of bare text is its own container
                up, level = (item if item.tag in ("div", "section", "article") else item.parent), 1
                while up is not None and level <= LEVELS:
                    points[up] += score / level
                    up, level = up.parent, level + 1
            if stack:
                length[stack[-1]] += length[item]
                linked[stack[-1]] += linked[item]
                commas[stack[-1]] += commas[item]
    return length, linked, points, scored


class _Page:
    """What the elements of a page are by their names, and what they hold."""

    def __init__(self, root: Node):
        self.kind: dict[Node, int] = {}
        self.letters: dict[Node, int] = defaultdict(int)
        self.linked: dict[Node, int] = defaultdict(int)
        self.titles: dict[Node, int] = defaultdict(int)
        prose: dict[Node, int] = defaultdict(int)
        count: dict[Node, int] = defaultdict(int)
        heads: dict[Node, int] = defaultdict(int)
        sums, links = (self.letters, self.linked, self.titles, prose, count, heads), 0
        for event, item in walk(root, lambda x: x.tag in DROPPED_TAGS):
            if event == "open":
                self.kind[item] = _kind(item)
                links += item.tag == "a"
                here = item
            elif event == "text":
                n = len(" ".join(item.split()))
                self.letters[here] += n
                self.linked[here] += n * bool(links)
            else:
                links -= item.tag == "a"
                if item.tag == "p" and (n := sum(len(x) for x in item.children if isinstance(x, str))) >= LEAST:
                    prose[item] += n
                    count[item] += 1
                self.titles[item] += item.tag == "h1"
                heads[item] += item.tag in ("article", "main", "h1")
                if item.parent is not None:
                    for own in sums:
                        own[item.parent] += own[item]
                    here = item.parent
        # named like boilerplate, but with most of the page's prose in paragraphs and its article, main or h1
        # element or, where it has none, three paragraphs at least: these hold the story all the same
        holds = lambda x: heads[x] > 0 if heads[root] else count[x] >= 3
        self.spared = {x for x, kind in self.kind.items() if kind and prose[x] > MOST * prose[root] and holds(x) and not _apart(x)}

    def dropped(self, node: Node) -> bool:
        return self.kind.get(node, DROP) == DROP and node not in self.spared

    def apart(self, node: Node) -> bool:
        """What takes no part in the scores."""
        return self.kind.get(node, DROP) != KEEP and node not in self.spared

    def reads(self, node: Node) -> bool:
        """Whether a part of the story's container belongs to it, though its name may say otherwise."""
        return not self.apart(node) or (not self.dropped(node) and (self.titles[node] > 0 or self._prose(node)))

    def _prose(self, node: Node) -> bool:
        return self.letters[node] >= (LEAST if node.tag == "p" else PROSE) and self.linked[node] < 0.25 * self.letters[node]


def _apart(node: Node) -> bool:
    """Elements that readers' comments and hidden parts are in, however long."""
    low = f" {node.attrs.lower()} "
    return bool(re.search(r"comment|discussion|respond|hidden|display\s*:\s*none|\brole\b", low))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    page = _Page(root)
    length, linked, points, scored = _measure(root, page.apart)
    density = lambda x: linked[x] / length[x] if length[x] else 0.0
    score = {x: p * (1 - density(x)) * (BONUS if x.tag in ("article", "main") else 1.0) for x, p in points.items()}
    if not score:
        return " ".join(blocks(root, page.apart))
    best = max(score, key=score.__getitem__)
    # the body of an article: a parent that scores nearly as well, or is an article itself, holds the rest of it
    while (up := best.parent) is not None and up.tag not in ("#root", "html", "body"):
        if not (up.tag == "article" or (best.tag != "article" and score.get(up, 0.0) >= CLOSE * score[best])):
            break
        best = up
    kept, parent = [best], best.parent
    if parent is not None:
        kept = []
        threshold = max(10.0, 0.2 * score[best]) if best.tag not in ("article", "main") else 0.2 * score[best]
        same = best.get("class")
        for x in parent.children:
            if x is best:
                kept.append(x)
            elif isinstance(x, str) or page.apart(x):
                continue
            elif score.get(x, 0.0) + (0.2 * score[best] if same and x.get("class") == same else 0.0) >= threshold and (x.tag == best.tag or best.tag != "article"):
                kept.append(x)
            elif best.tag not in ("article", "main") and x.tag == "p" and ((length[x] > 80 and density(x) < 0.25) or (0 < length[x] <= 80 and density(x) == 0)):
                kept.append(x)
            elif x.tag in ("h1", "h2", "h3") and density(x) == 0 and best.tag != "article":
                kept.append(x)
            elif parent.tag == "main" and x.tag == best.tag == "section" and length[x] and density(x) < 0.25:
                kept.append(x)  # short sections of one story
    whole, told = frozenset(kept), False

    def skip(x: Node) -> bool:
        nonlocal told
        if not page.reads(x):
            return True
        told = told or (x in scored and density(x) < 0.5)
        # menus without a name; after prose, links are the story's own
        return not told and x.tag in ("ul", "ol", "div", "table") and x not in whole and density(x) > 0.8 and sum(not isinstance(c, str) for c in x.children) >= 3

    return " ".join(t for x in kept for t in blocks(x, skip))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(_extract, EXTRACTED)

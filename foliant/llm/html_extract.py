"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks (text between block-level tags). A block's
classifier is a weighted sum of what it looks like and where it stands; its
score is the capacity by which the block hangs on the content terminal (score
above zero) or on the boilerplate terminal (below). Neighbours in page order
and consecutive blocks of one container are tied by smoothness edges, stronger
the closer they are in the document tree. The minimum cut labels all blocks at
once; blocks on the content side are the text.

Blocks whose own capacity outweighs all their edges keep their side in every
minimum cut; they are folded into their neighbours first, and the maximum flow
runs on what is left. A page is one row and one graph; pages never meet, so
there is no shuffle.

Inside a block white space becomes one space, blocks are joined by an empty
line. Line breaks and table cells are white space, character references are
decoded.

Defined cases: null, empty and pure boilerplate pages give an empty text;
markup that is not closed ends with its container or the page, an open head
with the first element that is no part of one; an article inside a form
and a main inside a form or a badly named wrapper start from a fresh score; text outside any tag is a block; repeated rows are each extracted; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import words

# Roles of tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "script style noscript template head title svg math iframe object canvas audio video "
    "button select option optgroup datalist textarea map".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
SPACED = frozenset("br td th".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre".split()) | HEADING
#: What an open head may hold; anything else ends it.
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: Elements that start from a fresh score when nothing but wrappers is around them.
#: Comments and teasers are articles as well, so an article keeps a bad name's weight.
FRESH = {"article": 2, "main": 1}
WRAPPERS = frozenset("html body div form section span center main".split())
#: A new one of these ends an open one within the same container.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
}
CONTAINERS = frozenset(
    "article aside body blockquote dialog div dl fieldset figure footer form header html main menu nav ol "
    "section table td th ul details".split()
)
# Weights of the classifier.
BIAS = -0.6
TAG_WEIGHTS = {
    "nav": -9.0, "menu": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "header": -6.0,
    "dialog": -9.0, "fieldset": -6.0, "figcaption": -0.5, "article": 4.0, "main": 2.5,
}
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|"
    r"nav|navbar|navigation|menu\w*|breadcrumbs?|side-?bar\w*|footer\w*|foot|masthead|site-?header|page-?header|header|"
    r"top-?bar|comments?|commentlist|replies|reply|respond|disqus|discussion|related|recommend\w*|share\w*|sharing|social\w*|"
    r"subscribe\w*|subscription|newsletter\w*|sign-?up|login|popup|modal|overlay|widgets?|toolbar|pagination|"
    r"pager|tags?|copyright|legal|disclaimer|search\w*|skip|hidden|paywall|rail)(?=$|[\s_-])",
    re.I,
)
GOOD_NAME = re.compile(
    r"(?:^|[\s_-])(?:articles?|article-?body|content|main|post|post-?body|entry|entry-?content|story|story-?body|"
    r"body-?text|text|prose|blog-?post)(?=$|[\s_-])",
    re.I,
)
#: Names that say what a wrapper has beside its text.
LAYOUT_NAME = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)[_-][\w-]*", re.I)
COMMENT = re.compile(r"(?:^|\s)(?:comment|reply|comment-body)(?=$|\s)", re.I)
OWN_HEADER = re.compile(r"(?:entry|article|post|story)[\w-]*header", re.I)
BAD_ROLE = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split()
)
BAD_WEIGHT, GOOD_WEIGHT = -9.0, 2.0
MOST_GOOD = 5.0
LINK_WEIGHT = -4.0
LENGTH_WEIGHT = 0.35
PROSE_WEIGHT = 1.0
HEADING_WEIGHT = 0.4
STOP_WEIGHT = 0.5
NEXT, SAME_CONTAINER, FAR = 0.8, 0.8, 0.1

HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SENTENCE_END = re.compile(r"[.!?。！？…][\"'”’)\]]*$")


def _names(held: dict[str, str | None]) -> str:
    return LAYOUT_NAME.sub("", f"{held.get('class') or ''} {held.get('id') or ''}")


class _Node:
    __slots__ = ("tag", "up", "score", "good", "depth", "silent", "link", "wrapped")

    def __init__(self, tag: str, up: _Node | None, score: float, good: float, silent: bool) -> None:
        self.tag, self.up, self.score, self.good, self.silent = tag, up, score, good, silent
        self.depth = up.depth + 1 if up else 0
        self.link = tag == "a" or bool(up and up.link)
        #: 2 inside wrappers only, 1 if one has a bad name, 0 inside anything else.
        self.wrapped = 0 if up else 2


class _Blocks(HTMLParser):
    """Text blocks of a page, each with its container and its prior score."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", None, 0.0, 0.0, False)
        self.at = self.root
        self.blocks: list[tuple[str, _Node, int, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.prose = ""
        self.owner = self.root

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.owner, self.linked, self.prose))
        self.parts, self.linked, self.prose = [], 0, ""

    def _scores(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[float, float, bool]:
        up = self.at
        bad, good, silent = up.score, up.good, up.silent or tag in SILENT
        if up.wrapped >= FRESH.get(tag, 3):
            bad = 0.0
        weight = TAG_WEIGHTS.get(tag, 0.0)
        if tag == "header" and good >= TAG_WEIGHTS["article"]:
            weight = 0.0
        held = dict(attrs)
        if held:
            names = _names(held)
            if tag not in ("html", "body") and names != " ":
                bad_name = BAD_NAME.search(names)
                if tag in ("article", "main"):
                    # Their classes name the page's kind as well; a reader comment is one.
                    bad_name = COMMENT.search(names)
                elif bad_name and "header" in bad_name[0].lower() and (OWN_HEADER.search(names) or good >= 4):
                    bad_name = None
                if bad_name:
                    weight += BAD_WEIGHT
                elif GOOD_NAME.search(names):
                    weight += GOOD_WEIGHT
            if held.get("role") in BAD_ROLE:
                weight += BAD_WEIGHT
            silent = silent or "hidden" in held or bool(HIDDEN.search(held.get("style") or ""))
            silent = silent or held.get("aria-hidden") == "true"
        return bad + min(0.0, weight), good + max(0.0, weight), silent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD_TAGS:
            self._leave_head()
        if tag in VOID:
            if tag in SPACED:
                self.parts.append(" ")
            elif tag in BLOCK:
                self.flush()
            return
        if tag in BLOCK or tag in CLOSES:
            if tag in SPACED:
                self.parts.append(" ")
            else:
                self.flush()
            self._imply(tag)
        bad, good, silent = self._scores(tag, attrs)
        self.at = _Node(tag, self.at, bad, good, silent)
        held = dict(attrs)
        if tag not in WRAPPERS or held.get("role") in BAD_ROLE:
            self.at.wrapped = 0
        else:
            self.at.wrapped = min(self.at.up.wrapped, 1 if BAD_NAME.search(_names(held)) else 2)

    def _leave_head(self) -> None:
        """Close a head without end tag at the first element that is no part of one."""
        if self.at.tag == "head":
            self.at = self.at.up

    def _imply(self, tag: str) -> None:
        """Close what a block-level start tag ends: an open paragraph, an open item."""
        ends = CLOSES.get(tag, frozenset())
        stop = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}.get(tag, {"table"} if ends else CONTAINERS)
        node = self.at
        found = None
        while node.up is not None and node.tag not in stop:
            if node.tag == "p" or node.tag in ends or (tag in HEADING and node.tag in HEADING):
                found = node
            node = node.up
        if found is not None:
            self.at = found.up

    def handle_endtag(self, tag: str) -> None:
        if tag in SPACED:
            self.parts.append(" ")
        elif tag in BLOCK:
            self.flush()
        node = self.at
        while node.up is not None and node.tag != tag:
            # An inline end tag closes nothing outside its block.
            if tag not in BLOCK and node.tag in CONTAINERS:
                return
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        node = self.at
        if node.silent:
            return
        if not self.parts or not self.prose:
            owner, holder = node, node
            while holder.up is not None and holder.tag not in BLOCK:
                holder = holder.up
            self.prose = holder.tag or "-"
            while owner.up is not None and owner.tag not in CONTAINERS:
                owner = owner.up
            self.owner = owner
        self.parts.append(data)
        if node.link:
            self.linked += len(data.strip())


def score(text: str, owner: _Node, linked: int, tag: str) -> float:
    """Log odds of a block to be content."""
    out = BIAS + owner.score + min(MOST_GOOD, owner.good)
    out += LENGTH_WEIGHT * log2(1 + len(text) / 16)
    out += LINK_WEIGHT * min(1.0, linked / len(text))
    out += PROSE_WEIGHT * (tag in PROSE) + HEADING_WEIGHT * (tag in HEADING)
    return out + STOP_WEIGHT * bool(SENTENCE_END.search(text))


def _near(x: _Node, y: _Node) -> float:
    """1 for one container, falling with the steps to the common ancestor."""
    steps = 0
    while x is not y:
        if x.depth >= y.depth:
            x = x.up
        else:
            y = y.up
        steps += 1
    return 1.0 / (1 + steps)


def edges(owners: list[_Node]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours and between consecutive blocks of a container."""
    out, last = [], {}
    for i, owner in enumerate(owners):
        if i:
            near = _near(owners[i - 1], owner)
            out.append((i - 1, i, NEXT * near if near > 0.25 else FAR * near))
        before = last.get(id(owner))
        if before is not None and before != i - 1:
            out.append((before, i, SAME_CONTAINER))
        last[id(owner)] = i
    return out


def minimum_cut(unary: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Content side of a minimum cut: True where a block is content.

    ``unary`` above zero is the capacity to the content terminal, below zero
    to the other one; ties go to boilerplate.
    """
    beside: list[dict[int, float]] = [{} for _ in unary]
    for a, b, w in links:
        beside[a][b] = beside[a].get(b, 0.0) + w
        beside[b][a] = beside[b].get(a, 0.0) + w
    own, label = list(unary), [None] * len(unary)
    queue = deque(range(len(unary)))
    while queue:
        i = queue.popleft()
        if label[i] is not None:
            continue
        weight = sum(beside[i].values())
        if own[i] > weight or own[i] <= -weight:
            label[i] = own[i] > 0
            for j, w in beside[i].items():
                own[j] += w if label[i] else -w
                del beside[j][i]
                queue.append(j)
            beside[i] = {}
    rest = [i for i, x in enumerate(label) if x is None]
    if rest:
        content = _source_side(rest, own, beside)
        for i in rest:
            label[i] = i in content
    return label


def _source_side(nodes: list[int], own: list[float], beside: list[dict[int, float]]) -> set[int]:
    """Nodes that a maximum flow leaves reachable from the content terminal."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(beside[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if own[i] > 0:
            room[source][i] = own[i]
            room[i][source] = 0.0
        elif own[i] < 0:
            room[i][sink] = -own[i]
            room[sink][i] = 0.0
    while True:
        came: dict[int, int] = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            at = queue.popleft()
            for to, free in room[at].items():
                if free > 1e-12 and to not in came:
                    came[to] = at
                    queue.append(to)
        if sink not in came:
            return set(came) - {source}
        path, at = [], sink
        while at != source:
            path.append((came[at], at))
            at = came[at]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] = room[b].get(a, 0.0) + flow


def main_text(html: str) -> str:
    """Blocks on the content side, in page order."""
    page = _Blocks()
    page.feed(html)
    page.close()
    page.flush()
    if not page.blocks:
        return ""
    unary = [score(*b) for b in page.blocks]
    kept = minimum_cut(unary, edges([b[1] for b in page.blocks]))
    return "\n\n".join(b[0] for b, k in zip(page.blocks, kept, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, 256):
        texts = [main_text(h or "") for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                batch.column(1).cast(pa.string()),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, row_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(
        F.col(row_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")
    )
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")

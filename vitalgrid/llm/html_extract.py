"""Main text of web pages by text-to-tag ratios over streamed parser events.

The standard library's parser sends start, end and text events.  They are cut into one line
per text block, with the number of tags that the line holds.  The ratio of text to tags
per line is smoothed by a Gaussian and split by a threshold cluster into content and other lines.
The content lines vote for the article or main element that holds most of their text, else for their
smallest common block, widened as long as what comes in is not mostly links; every line of it is
returned, short ones too, except for those below an element that is boilerplate by its tag, role or name.
A name alone does not make boilerplate of the element that is or holds the main text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.common import free_name

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
BOILER_TAGS = frozenset(
    "head title nav footer aside button select textarea script style noscript template iframe object svg canvas menu dialog datalist".split()
)
REGION_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# a class or id names boilerplate if all its parts are of these three kinds, and one of the first two
BOILER_PART = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|disqus|"
    r"repl(?:y|ies)|cookies?|gdpr|popup|newsletter|subscribe|sign-?up|shar(?:e|ing)|toolbar|widgets?|log-?in|pagination|pager|skip"
)
#: These also name parts of a text; alone they need a low text-to-tag ratio besides, and in an article no other name beside them.
WEAK_PART = re.compile(r"banner|respond|consent|notices?|modal|overlay|related|recommend\w*|social|search|disclaimer")
PLACE_PART = re.compile(
    r"|site|page|top|bottom|left|right|main|global|primary|secondary|header|head|box|bar|list|links?|buttons?|icons?|items?|section|area|wrap|wrapper|container|"
    r"block|panel|inner|outer|body|text|title|content|form|side|up|in|log|sign|row|col|column|group|module|post|posts|articles?|stories|media|bread|crumbs?|\d+"
)
HEADER_NAMES = frozenset(f"{a}{b}header" for a in ("", "site", "page", "top") for b in ("", "-", "_"))
NOT_NAMED = HEADINGS | {"html", "body", "main", "p", "blockquote", "table"}
STRONG, WEAK = 2, 1
CLOSES_P = BLOCK - {"body", "html", "head"}

SIGMA_LINES = 1.0
ARTICLE_SHARE = 0.5  # of the content votes, for an article to be taken
WEAK_RATIO = 0.5  # of the least ratio of content: below it a weak name counts
OWN_RATIO = 0.25  # of the least ratio of content, for a line to be of the core
REGION_SHARE = 0.25  # of a named element's votes, in an article outside, for the name to count


@lru_cache(maxsize=4096)
def _named(token: str) -> int:
    """Whether a class or id names boilerplate: STRONG, WEAK or 0."""
    parts = [x for x in re.split(r"[-_]+", token.lower()) if x]
    if "side" in parts and "bar" in parts:
        return STRONG
    strong = sum(bool(BOILER_PART.fullmatch(x)) for x in parts)
    weak = sum(bool(WEAK_PART.fullmatch(x)) for x in parts)
    if not strong + weak or any(not (BOILER_PART.fullmatch(x) or WEAK_PART.fullmatch(x) or PLACE_PART.fullmatch(x)) for x in parts):
        return 0
    return STRONG if strong or weak > 1 else WEAK


def _of_place(token: str) -> bool:
    return all(PLACE_PART.fullmatch(x) for x in re.split(r"[-_]+", token.lower()))


class _Node(NamedTuple):
    tag: str
    parent: int
    hard: bool  # boilerplate by tag, role or attributes, its own or inherited
    soft: int  # its own name: STRONG, WEAK or 0
    article: int  # outermost article or main that it is or is in; 0: none
    link: bool


class _Lines(HTMLParser):
    """Turns the event stream into lines (text, tags, node, characters in links) and nodes, parents first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.nodes = [_Node("", 0, False, 0, 0, False)]
        self.stack: list[tuple[str, int]] = [("", 0)]
        self._own: list[tuple[str, bool]] = []  # as stack without its bottom: whether the element itself is boilerplate
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def flush_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append((text, self.tags, self.stack[-1][1], min(self.linked, len(text))))
            self.tags = 0
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush_line()
            if tag in CLOSES_P:
                self._close("p", stop=BLOCK)
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        up = self.stack[-1][1]
        _, _, hard, _, article, link = self.nodes[up]
        own, soft = self._boiler(tag, attrs, bool(article))
        if tag in REGION_TAGS and not own and hard and not any(b and t not in ("nav", "header", "form", "head", "title") for t, b in self._own):
            hard = False  # an article cannot belong to a menu, header or form that was left open
        hard = hard or own
        if tag in REGION_TAGS and not article and not hard:
            article = len(self.nodes)
        self._own.append((tag, own))
        self.stack.append((tag, len(self.nodes)))
        self.nodes.append(_Node(tag, up, hard, soft, article, link or tag == "a"))

    @staticmethod
    def _boiler(tag: str, attrs: list, article: bool) -> tuple[bool, int]:
        """Whether the element is boilerplate by tag, role or attributes, and what its names say."""
        if tag in BOILER_TAGS or (tag == "header" and not article):
            return True, 0
        if tag in ("html", "body", "main") or not attrs:
            return False, STRONG if tag == "form" else 0
        # a form is boilerplate unless it holds most of the text, as one around a whole page does
        soft = STRONG if tag == "form" else 0
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True, 0
            if value and name in ("class", "id") and tag not in NOT_NAMED:
                for token in value.split():
                    named = _named(token)
                    if article and named == WEAK and not all(_named(t) or _of_place(t) for t in value.split()):
                        named = 0
                    soft = max(soft, named, STRONG if not article and token.lower() in HEADER_NAMES else 0)
            if value and name == "role" and value.lower() in BOILER_ROLES:
                return True, 0
            if value and name == "role" and value.lower() == "form":
                soft = STRONG
            if value and name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, 0
        return False, soft

    def _close(self, tag: str, stop: frozenset = frozenset()) -> None:
        """Close the nearest open element of this tag, and those left open in it."""
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name == tag:
                del self.stack[k:]
                del self._own[k - 1 :]
                return
            if name in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush_line()
        self.tags += 1
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        tag, node = self.stack[-1]
        if self.nodes[node].hard and tag not in BLOCK:
            return  # boilerplate within a line, such as a button's name
        if tag not in ("script", "style"):
            self.parts.append(data)
            if self.nodes[node].link:
                self.linked += len(data.strip())


def _smooth(values: list[float]) -> list[float]:
    reach = int(math.ceil(2 * SIGMA_LINES))
    kernel = [math.exp(-(k * k) / (2 * SIGMA_LINES**2)) for k in range(-reach, reach + 1)]
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for k in range(max(0, i - reach), min(n, i + reach + 1)):
            w = kernel[k - i + reach]
            total += w * values[k]
            weight += w
        out.append(total / weight)
    return out


def _threshold(values: list[float]) -> float:
    """Border of the two clusters of the smoothed ratios (two means on a line)."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        below = [v for v in values if v <= cut]
        above = [v for v in values if v > cut]
        if not below or not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _votes(lines: list[tuple[str, int, int, int]], boiler: list[bool]) -> tuple[list[float], list[bool], float]:
    """Votes of each line, whether it is content by the smoothed ratios, and the least ratio of content."""
    out = [boiler[node] for _, _, node, _ in lines]
    smooth = _smooth([0.0 if b else len(text) / max(1, tags) for (text, tags, _, _), b in zip(lines, out)])
    cut = min(_threshold(smooth), sum(smooth) / len(smooth))
    content = [not b and value >= cut for value, b in zip(smooth, out)]
    return [0.0 if b else len(line[0]) * (1.0 if c else 0.1) for line, b, c in zip(lines, out, content)], content, cut


def _sums(nodes: list[_Node], lines: list[tuple[str, int, int, int]], values: list, stop: list[int] | None = None) -> list:
    """Sum of the lines' values below each node; what is below a node of ``stop`` does not count further up."""
    out = [0] * len(nodes)
    for (_, _, node, _), v in zip(lines, values):
        out[node] += v
    for i in range(len(nodes) - 1, 0, -1):
        if not (stop and stop[i]):
            out[nodes[i].parent] += out[i]
    return out


def _boilerplate(nodes: list[_Node], lines: list[tuple[str, int, int, int]]) -> list[bool]:
    """Whether each node is boilerplate, its own or inherited."""
    hard = [n.hard for n in nodes]
    soft = [0 if n.hard else n.soft for n in nodes]
    if any(soft):
        votes, _, cut = _votes(lines, hard)
        chars = [0 if hard[node] else len(text) for text, _, node, _ in lines]
        every = _sums(nodes, lines, chars)
        tags = _sums(nodes, lines, [line[1] for line in lines])
        thin = [every[i] < WEAK_RATIO * cut * tags[i] for i in range(len(nodes))]
        soft = [0 if s == WEAK and not thin[i] else s for i, s in enumerate(soft)]
        free = _sums(nodes, lines, votes, soft)  # votes below each node that no name inside it takes away
        regions = [i for i, n in enumerate(nodes) if n.tag in REGION_TAGS and not n.hard]
        named = [False] * len(nodes)  # is or is in a node of soft
        for i, n in enumerate(nodes):
            named[i] = bool(soft[i]) or (i > 0 and named[n.parent])
        outside = max((free[i] for i in regions if not named[i]), default=0.0)
        main = [i for i in sorted(regions, key=free.__getitem__)[-1:] if named[i] and free[i] > free[0]]
        if not main:
            main = [i for i, s in enumerate(soft) if s and free[i] > free[0] and outside < REGION_SHARE * free[i]]
            main = [max(main, key=free.__getitem__)] if main else []
        for i in main:
            while i:
                soft[i] = 0
                i = nodes[i].parent
    out: list[bool] = []
    for i, n in enumerate(nodes):
        # hard holds what is inherited, or was lifted by an article
        out.append(hard[i] or bool(soft[i]) or (i > 0 and out[n.parent] and not hard[n.parent]))
    return out


def extract_text(html: str | None) -> str:
    """Main text: its blocks with single spaces, joined by an empty line; '' for null, empty or no content."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush_line()
    nodes, lines = parser.nodes, parser.lines
    if not lines:
        return ""
    boiler = _boilerplate(nodes, lines)
    votes, content, cut = _votes(lines, boiler)
    if not any(votes):
        return ""
    below = _sums(nodes, lines, votes)
    chars = _sums(nodes, lines, [0 if boiler[line[2]] else len(line[0]) for line in lines])
    linked = _sums(nodes, lines, [0 if boiler[line[2]] else line[3] for line in lines])
    articles = [i for i, n in enumerate(nodes) if n.article == i and i > 0]
    if any(below[i] > ARTICLE_SHARE * below[0] for i in articles):
        # cards, whose text is mostly links, are no articles
        chosen = {i for i in articles if below[i] > ARTICLE_SHARE * below[0] or 2 * linked[i] <= chars[i]}
        inside = [n.article in chosen for n in nodes]
    else:
        # beside content a smoothed ratio is high too, so a line of the core also has some text of its own for its tags
        own = [len(text) >= OWN_RATIO * cut * tags for text, tags, _, _ in lines]
        core = [not boiler[node] and (c and o or nodes[node].tag == "h1") for (_, _, node, _), c, o in zip(lines, content, own)]
        core = core if any(core) else content
        held = _sums(nodes, lines, [int(c) for c in core])
        top = max(i for i, h in enumerate(held) if h == held[0] and (i == 0 or nodes[i].tag in BLOCK))
        while top and 2 * (linked[nodes[top].parent] - linked[top]) <= chars[nodes[top].parent] - chars[top]:
            top = nodes[top].parent
        inside = [False] * len(nodes)
        for i, n in enumerate(nodes):
            inside[i] = i == top or (i > 0 and inside[n.parent])
    return "\n\n".join(line[0] for line in lines if inside[line[2]] and not boiler[line[2]])


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text string`` (never null) and ``n_chars long`` to the columns ``keep`` (default: all but clashing ones).

    Null, empty and content-free html give an empty text; pages of any length are parsed whole; of equally good
    regions the inner one, or the last, is taken; repeated rows give repeated results; an empty table gives an empty table.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("text", "n_chars")]
    src = df.select(F.col(f"`{html_col}`").alias(free_name(keep, "__html")), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                texts = [extract_text(h.as_py()) for h in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return src.mapInArrow(run, schema)

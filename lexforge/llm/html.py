"""Operator 10: main text of HTML pages by text-to-tag ratios.

The standard library's parser gives events; block elements cut the page into lines, each with its text, its number of
tags and the region (article, main, section, div, list, ...) it stands in; regions form a tree.  Scripts, styles, menus,
footers, asides, forms and the like are left out as their elements pass.  The ratio of text to tags is smoothed over the
lines with a Gaussian and clustered by a threshold into content and the rest.  The regions that hold the content's lines
are selected, and all their lines are kept, however short, but for regions of links of which no line reaches the
threshold by its own ratio.  Names of elements are hints: one that can only mean an advert, a sidebar or readers' comments drops
an element, others that may mean boilerplate make a region answer for itself with its characters a tag.

Null or empty html gives empty text and 0 characters; so does a page with nothing but boilerplate.  Every row gives a
row; other columns are not read.  An empty table gives an empty table.  Time grows with the page's length, however deep
its elements are nested.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .textops import tidied

SIGMA = 1.0
#: A line is content if its smoothed ratio is at least so many standard deviations of all lines' ratios.
CUT = 0.5

_WORDS = frozenset  # element names of HTML, by role
BLOCK = _WORDS("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = _WORDS("area base br col embed hr img input link meta param source track wbr".split())
REGION = _WORDS("article body div main section td".split())
LIST = _WORDS("dl ol table ul".split())
DROPPED = _WORDS("aside button canvas dialog footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
CLOSED_BY_BLOCK = _WORDS("p h1 h2 h3 h4 h5 h6 li dt dd td th tr option".split())
MARKS = re.compile(
    r"(?:ads?|adverts?|advertis\w+|adslot|adbox|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|share|sharing|social|sidebar|"
    r"side|menu|menubar|nav|navbar|navigation|breadcrumbs?|footer|foot|header|masthead|topbar|comments?|commentlist|discussion|disqus|repl(?:y|ies)|respond|reviews?|related|recommend\w*|widgets?|toolbar|"
    r"pagination|pager|copyright|disclaimer|login|signin|signup|search|searchbox|contentinfo|complementary)\Z"
)
COMMENT = re.compile(r"(?:comments?|commentlist|discussion|disqus|repl(?:y|ies)|respond|reviews?)\Z")
#: Marks that are no words of articles.  Inside an article only these drop an element by its class; other marks, and
#: ids, which are often the slugs of headings, need the ratio as well.
SURE = re.compile(r"(?:ads?|adverts?|advertis\w+|adslot|adbox|sponsor\w*|newsletter|sidebar|menubar|navbar|nav|breadcrumbs?|comments?|commentlist|disqus|widgets?|toolbar|pagination|pager|searchbox|signin|signup|contentinfo|complementary)\Z")
ROLES = _WORDS("navigation search complementary contentinfo menubar toolbar".split())
#: Words that a name can have besides its marks, and those that it can have besides marks that are sure.
NEUTRAL = re.compile(r"(?:\d+|container|wrap|wrapper|box|block|area|section|list|items?|inner|outer|main|site|top|bottom|left|right|primary|secondary|global|sticky|fixed|mobile|desktop|bar|row|col|column|panel|module|group|links?|posts|stories)\Z")
OWNERS = re.compile(r"(?:post|article|entry|story|blog|user|reader|page|content)\Z")
HEADINGS = _WORDS("h1 h2 h3 h4 h5 h6".split())
#: A region with a doubtful name is boilerplate if it has fewer characters a tag than this and than the content's cut; so
#: is one of links.
FEW = 20
#: The share of its characters that a region of links has in links.
LINKED = 2 / 3
#: Words of a class that say what the element has around it, not what it is.
AROUND = frozenset(("has", "no", "with", "without", "layout"))
_CUTS = re.compile(r"[\s_\-:.]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    region: int
    tags: int = 0
    linked: int = 0
    parts: list[str] = field(default_factory=list)
    text: str = ""


class Lines(HTMLParser):
    """Collects the lines of a page outside of elements that are left out, and the tree of its regions: each has a
    larger number than the region around it, and region 0 is the body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.names, self.parent = ["body"], [0]
        self.open: list[tuple[str, int]] = []  # blocks around, each with the region it stands in
        self.counts: Counter[str] = Counter()  # how many of the open blocks have a name
        self.region = 0
        self.line = Line(0)
        self.drop, self.depth, self.remarks = "", 0, False
        self.main = False
        self.doubt = False
        self.anchor = False
        self.doubtful: set[int] = set()

    def cut(self) -> None:
        if self.line.parts or self.line.tags:
            self.line.text = " ".join("".join(self.line.parts).split())
            if self.line.text:
                self.lines.append(self.line)
        self.line = Line(self.region)

    def boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED:
            return True
        inside = self.counts["article"] + self.counts["main"] > 0
        if tag == "header":
            return not inside
        if tag in ("html", "body", "main"):
            return False
        self.doubt = False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                return True
        if tag in HEADINGS or inside and tag not in BLOCK:
            return False
        for name, value in attrs:
            if value and name in ("class", "id", "role", "aria-label", "itemprop"):
                for one in value.split():
                    words = [w.lower() for w in _CUTS.split(one) if w]
                    marks = [w for w in words if MARKS.match(w) and not (w == "header" and inside)]
                    if not marks or not AROUND.isdisjoint(words):
                        continue
                    sure = any(SURE.match(w) for w in marks)
                    whole = all(w in marks or NEUTRAL.match(w) or sure and OWNERS.match(w) for w in words)
                    if tag == "article":  # a comment in or after the page's article
                        if whole and name == "class" and self.main and any(COMMENT.match(w) and SURE.match(w) for w in marks):
                            return True
                    elif name == "role" and one in ROLES or whole and (name == "class" and (sure or not inside) or name in ("id", "role") and not inside and tag != "section"):
                        return True
                    elif whole or not inside:
                        self.doubt = True
        return False

    def leave(self, tag: str) -> None:
        """Closes the innermost open element of the name and what is open in it."""
        while self.counts[tag]:
            name, self.region = self.open.pop()
            self.counts[name] -= 1
            if name == tag:
                break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.drop:
            ends = tag == "body" or self.drop in CLOSED_BY_BLOCK and tag in BLOCK or tag in ("article", "main") and not self.main and not self.remarks and self.drop != "article"
            if not ends:
                self.depth += tag == self.drop
                return
            self.drop = ""
        self.doubt = False
        if tag not in VOID and self.boilerplate(tag, attrs):
            if tag in BLOCK:
                self.cut()
            self.drop, self.depth = tag, 1
            self.remarks = any(v and n in ("class", "id") and any(COMMENT.match(w.lower()) for w in _CUTS.split(v) if w) for n, v in attrs)
            return
        if tag in BLOCK:
            if self.open and self.open[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or self.open and self.open[-1][0] == tag and tag in CLOSED_BY_BLOCK:
                self.leave(self.open[-1][0])
            self.cut()
            around = self.region
            if (tag in REGION or tag in LIST or self.doubt) and tag not in VOID and tag != "body":
                self.region = len(self.names)
                self.names.append(tag)
                self.parent.append(around)
                if self.doubt:
                    self.doubtful.add(self.region)
                self.main |= tag in ("article", "main")
            if tag not in VOID and tag not in ("html", "body"):
                self.open.append((tag, around))
                self.counts[tag] += 1
            self.line = Line(self.region)
        elif tag == "a":
            self.anchor = True
        elif tag == "br":
            self.line.parts.append(" ")
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.drop:
            if tag == self.drop:
                self.depth -= 1
                if not self.depth:
                    self.drop = ""
            elif tag in ("body", "html") or self.drop in CLOSED_BY_BLOCK and tag in BLOCK and self.counts[tag]:
                self.drop = ""
                self.handle_endtag(tag)
            return
        if tag in BLOCK:
            self.cut()
            if tag not in ("html", "body"):
                self.leave(tag)
            self.line = Line(self.region)
        elif tag == "a":
            self.anchor = False
        self.line.tags += 1

    def handle_data(self, data: str) -> None:
        if not self.drop:
            self.line.parts.append(data)
            if self.anchor:
                self.line.linked += len(data.strip())


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """The values under a Gaussian window, cut at three sigmas and scaled to 1 at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    window = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        part = window[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(part, values[lo:hi], strict=True)) / sum(part))
    return out


def cut_of(flat: list[float]) -> float:
    """The smoothed ratio that makes a line content."""
    mean = sum(flat) / len(flat)
    spread = math.sqrt(sum((v - mean) ** 2 for v in flat) / len(flat))
    return max(CUT * spread, 0.25 * mean)


@dataclass
class Tree:
    """The regions of a page: their names, the region around each (a smaller number), and those of doubtful name."""

    names: list[str]
    parent: list[int]
    doubtful: set[int]

    def sums(self, lines: list[Line], value: Callable[[Line], float]) -> list[float]:
        """The sum of a value over the lines of each region and those in it."""
        out = [0.0] * len(self.parent)
        for x in lines:
            out[x.region] += value(x)
        for r in range(len(out) - 1, 0, -1):
            out[self.parent[r]] += out[r]
        return out

    def within(self, marked: Callable[[int], bool]) -> list[bool]:
        """Whether each region, or one around it, is marked."""
        out = [False] * len(self.parent)
        for r in range(len(out)):
            out[r] = marked(r) or r > 0 and out[self.parent[r]]
        return out


def ratios(lines: list[Line]) -> list[float]:
    """The text-to-tag ratio of each line."""
    return [len(x.text) / max(1, x.tags) for x in lines]


def undoubted(lines: list[Line], tree: Tree) -> list[Line]:
    """The lines without the regions of doubtful name that have few characters a tag."""
    size, tags = tree.sums(lines, lambda x: len(x.text)), tree.sums(lines, lambda x: x.tags)
    least = min(FEW, cut_of(smoothed(ratios(lines))))
    gone = tree.within(lambda r: r in tree.doubtful and size[r] < least * max(1, tags[r]))
    return [x for x in lines if not gone[x.region]]


def content(lines: list[Line], tree: Tree) -> list[Line]:
    """The lines of the regions that hold the content."""
    if lines and tree.doubtful:
        lines = undoubted(lines, tree)
    if not lines:
        return []
    flat = smoothed(ratios(lines))
    cut = cut_of(flat)
    chosen = [v >= cut for v in flat]
    selected = regions_of(lines, chosen, tree)
    if not any(chosen):
        return selected
    # regions of links of which no line reaches the cut by itself
    own = [x for x, v in zip(lines, ratios(lines), strict=True) if v >= cut]
    holding, size = tree.sums(own, lambda x: 1), tree.sums(lines, lambda x: len(x.text))
    tags, linked = tree.sums(lines, lambda x: x.tags), tree.sums(lines, lambda x: x.linked)
    gone = tree.within(lambda r: r > 0 and not holding[r] and size[r] < FEW * tags[r] and linked[r] >= LINKED * size[r] > 0)
    return [x for x in selected if not gone[x.region]]


def regions_of(lines: list[Line], chosen: list[bool], tree: Tree) -> list[Line]:
    """The lines of the regions that the chosen lines select."""
    good = [x for x, c in zip(lines, chosen, strict=True) if c]
    names, holding = tree.names, tree.sums(good, lambda x: 1)
    in_article, in_main = tree.within(lambda r: names[r] == "article"), tree.within(lambda r: names[r] == "main")
    marked = [a or m for a, m in zip(in_article, in_main, strict=True)]
    plain = list(range(len(names)))  # the innermost region that is no list
    for r in range(1, len(names)):
        if names[r] in LIST and r not in tree.doubtful:
            plain[r] = plain[tree.parent[r]]
    if any(marked[x.region] for x in lines) and (not good or any(marked[x.region] for x in good)):
        # all of the articles; of a main around articles its own lines and those of its regions with content, or else all
        articles = tree.sums([x for x in lines if in_article[x.region]], lambda x: 1)
        alone = tree.within(lambda r: names[r] == "main" and not articles[r])

        def kept(r: int) -> bool:
            own = plain[r]
            return in_article[r] or alone[r] or in_main[r] and (names[own] == "main" or holding[own] > 0)

        return [x for x in lines if kept(x.region)]
    # the innermost region with all content lines and what is marked
    wanted = [c or marked[x.region] for x, c in zip(lines, chosen, strict=True)]
    if not any(wanted):
        return []
    all_of = tree.sums([x for x, w in zip(lines, wanted, strict=True) if w], lambda x: 1)
    best = max(r for r in range(len(names)) if all_of[r] == all_of[0] and plain[r] == r)
    inside = tree.within(lambda r: r == best)
    held = [k for k, x in enumerate(lines) if inside[x.region]]
    if best:
        return [lines[k] for k in held]
    ends = [k for k in held if wanted[k]]
    return [lines[k] for k in held if ends[0] <= k <= ends[-1]]


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order with an empty line between."""
    if not html:
        return ""
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # an unknown declaration, which the parser can't pass
        parser = Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    parser.cut()
    return "\n\n".join(x.text for x in content(parser.lines, Tree(parser.names, parser.parent, parser.doubtful)))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(id_col, url_col, html_col).mapInArrow(tidied(extracted), schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

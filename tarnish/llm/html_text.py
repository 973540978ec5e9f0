"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks, each with its tag path (block-level elements
from the root to the leaf, with their classes). Per path, text length and
punctuation are summed and divided by the number of blocks; the two ratios are
smoothed along the page, fused, and paths whose fused ratio reaches the
threshold are content. The page's article or main element, or else the smallest
element with all of that content, is the article: its blocks are the text, but
for those that markup or a clear name sets apart (menus, forms, comments,
adverts and the like) and lists of links that stand outside the running text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# HTML element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
UNSEEN = set("head title script style noscript template svg math iframe object canvas audio video map datalist".split())
APART = set("nav footer aside form button select option textarea fieldset dialog menu".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of class, id and role that name what isn't the article.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar skip "
    "sidebar rail widget widgets related recommended trending popular toc "
    "footer copyright legal cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social follow "
    "comment comments disqus respond replies reply contentinfo complementary".split()
)
HEADER_NAMES = {"header", "masthead", "topbar"}
PUNCTUATION = re.compile(r"[.,;:!?。、，！？…¿¡]")
# What head may hold; what is apart however much it wraps, unless the page's title is in it; parts of lists.
IN_HEAD = set("base link meta title script style noscript template".split())
STRICT_TAGS = APART - {"form", "fieldset", "dialog"}
STRICT_NAMES = set("comment comments disqus respond replies reply nav navbar navigation footer contentinfo".split())
LISTS = set("li ul ol dl dt dd table thead tbody tfoot tr td th".split())
KINDS = {"unseen": UNSEEN, "link": {"a"}, "heading": HEADINGS, "title": {"h1"}}
#: Share of the content that the one article element must hold to be preferred; part of the mean ratio that a content path reaches.
HOLDS, LEAST = 0.5, 0.5


@dataclass
class Block:
    path: int
    at: int  # innermost element that it lies in
    leaf: int  # innermost of those that aren't inline
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    title: bool = False
    around: int = 0
    text: str = ""


class Blocks(HTMLParser):
    """Blocks of a page, and for each element why it might be apart.

    Elements are numbered as they open, so those inside one are a range of
    numbers. What a tag closes is found by the places of the open elements of
    each tag: the time is linear in the page, however deep it nests.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.where: dict[str, list[int]] = defaultdict(list)
        self.solid: list[int] = []
        self.parent, self.end, self.path, self.leaf, self.around = [0], [0], [0], [0], [0]
        self.kind = [""]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self.apart: dict[int, str] = {}
        self.strict: set[int] = set()
        self.mains: set[int] = set()
        self.articles: dict[int, bool] = {}
        self.count: dict[str, int] = defaultdict(int)
        self.fresh, self.endless = True, False

    def parse_comment(self, i, report=1):
        if self.endless:  # no comment ends behind an earlier one that doesn't
            return -1
        k = super().parse_comment(i, report)
        self.endless = k < 0
        return k

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and tag != "head":
            self.end_head()
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            self.fresh |= tag == "hr"
            return
        if tag not in INLINE:
            self.fresh = True
            if tag not in UNSEEN:
                self.shut(("p",), self.last("button", "td", "th", "table"))
        if tag in CLOSES:
            self.shut(CLOSES[tag], self.last("ul", "ol", "dl", "table", "select"))
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role", "aria-label")).lower()
        tokens = set(re.findall(r"[a-z]+", named))
        hidden = any(k == "hidden" for k, _ in attrs)
        new = self.entered(tag, tag if not named else f"{tag}.{'.'.join(sorted(tokens))}")
        if tag in STRICT_TAGS or tokens & STRICT_NAMES or hidden:
            self.strict.add(new)
        if tag == "main" or "main" in [(v or "").strip().lower() for k, v in attrs if k == "role"]:
            self.mains.add(new)
        if tag == "article":
            self.articles[new] = not self.where["article"]
        if tag in ("html", "body") and not hidden:
            pass  # classes of the whole page say how it is laid out
        elif tag in APART:
            self.apart[new] = "tag"
        elif tag == "header" or tokens & HEADER_NAMES:
            self.apart[new] = "header"
        elif tokens & NAMES or hidden:
            self.apart[new] = "name"
        self.where[tag].append(len(self.open))
        if tag not in INLINE:
            self.solid.append(len(self.open))
        self.open.append((tag, new))
        self.counted(tag, 1)

    def entered(self, tag: str, step: str) -> int:
        """The number of a new element inside the open ones."""
        outer, new = self.open[-1][1] if self.open else 0, len(self.parent)
        solid = tag not in INLINE
        holder = self.leaf[outer]
        self.parent.append(outer)
        self.end.append(0)
        self.kind.append(tag)
        self.path.append(self.paths.setdefault((self.path[outer], step), len(self.paths) + 1) if solid else self.path[outer])
        self.leaf.append(new if solid else holder)
        # What stands round an element: of a part of a list what stands round the list.
        self.around.append((self.around[holder] if tag in LISTS and self.kind[holder] in LISTS else holder) if solid else self.around[outer])
        return new

    def counted(self, tag: str, by: int) -> None:
        for kind, tags in KINDS.items():
            if tag in tags:
                self.count[kind] += by

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.fresh = True
        if tag not in VOID:
            self.shut((tag,), self.solid[-1] if tag in INLINE and self.solid else -1)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags; -1: none."""
        return max((self.where[t][-1] for t in tags if self.where[t]), default=-1)

    def shut(self, wanted, fence: int):
        """Closes elements down to the nearest wanted one, if no fence stands before it."""
        at = self.last(*wanted)
        if at < 0 or at < fence:
            return
        while len(self.open) > at:
            tag, element = self.open.pop()
            self.end[element] = len(self.parent)
            self.where[tag].pop()
            if tag not in INLINE:
                self.solid.pop()
            self.counted(tag, -1)

    def end_head(self):
        """Head ends, with or without a tag, where something starts that it cannot hold."""
        if self.where["head"]:
            self.shut(("head",), self.last(*(UNSEEN - {"head"})))

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if self.count["unseen"] or not data:
            return
        if self.fresh:
            at = self.open[-1][1] if self.open else 0
            self.blocks.append(Block(self.path[at], at, self.leaf[at], heading=self.count["heading"] > 0, title=self.count["title"] > 0, around=self.around[self.leaf[at]]))
            self.fresh = False
        block = self.blocks[-1]
        block.parts.append(data)
        if self.count["link"]:
            block.linked += len("".join(data.split()))

    def close(self):
        super().close()
        for _, element in self.open:
            self.end[element] = len(self.parent)
        self.end[0] = len(self.parent)

    def inside(self, block: Block, element: int) -> bool:
        return element <= block.at < self.end[element]

    def held(self, blocks: list[Block], weight=lambda b: 1) -> list[int]:
        """For each element the weight of the blocks inside it."""
        out = [0] * len(self.parent)
        for b in blocks:
            out[b.at] += weight(b)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out


def smoothed(values: list[float]) -> list[float]:
    """Gaussian over two neighbours to each side."""
    weights = {d: math.exp(-d * d / 2) for d in range(-2, 3)}
    out = []
    for i in range(len(values)):
        near = [(values[i + d], w) for d, w in weights.items() if 0 <= i + d < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def content_paths(blocks: list[Block]) -> set[int]:
    """Paths whose fused ratio of text and punctuation reaches the threshold."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for b in blocks:
        s = sums[b.path]
        s[0] += len(b.text) - b.linked
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
    length = smoothed([sums[b.path][0] / sums[b.path][2] for b in blocks])
    marks = smoothed([sums[b.path][1] / sums[b.path][2] for b in blocks])
    fused: dict[int, list[float]] = defaultdict(list)
    for b, x, y in zip(blocks, length, marks, strict=True):
        fused[b.path].append(math.sqrt(max(x, 0) * (1 + y)))
    ratio = {p: sum(v) / len(v) for p, v in fused.items()}
    every = [ratio[b.path] for b in blocks]
    mean = sum(every) / len(every)
    spread = math.sqrt(sum((x - mean) ** 2 for x in every) / len(every))
    least = max(spread, LEAST * mean)
    return {p for p, x in ratio.items() if x >= least and x > 0}


def set_apart(page: Blocks, blocks: list[Block]) -> dict[int, str]:
    """Elements that are apart, and why: those that hold the page's article or wrap all of the page aren't.

    How much text an element holds says nothing: comments may outweigh an article.
    """
    apart, n = page.apart, len(page.parent)
    held, titled = page.held(blocks), page.held([b for b in blocks if b.title])
    lone = len(page.articles) == 1
    under = [False] * n  # inside an element that is apart by a strict rule
    plain = [True] * n  # in no element that might be apart
    for i in range(1, n):
        outer = page.parent[i]
        under[i] = under[outer] or outer in page.strict
        plain[i] = plain[outer] and i not in apart
    saved = [False] * n
    for i in range(n - 1, 0, -1):
        own = held[i] and i not in apart and (i in page.mains or i in page.articles and (titled[i] or lone and not under[i]))
        saved[page.parent[i]] |= bool(own or saved[i])
    lonely = not any(plain[b.at] for b in blocks)
    out = {}
    for i, why in apart.items():
        strict = i in page.strict
        whole = held[i] == len(blocks) and (not strict or titled[i])
        if not (saved[i] or whole or not strict and titled[i] and lonely):
            out[i] = why
    return out


def article_of(page: Blocks, blocks: list[Block], content: list[Block]) -> tuple[int, bool]:
    """The element of the article, 0 for the page, and whether markup says that it is one.

    That is the one article element, or the main element, if it holds most of the
    content; otherwise the innermost element that holds all of the content, and
    the title if the page has one h1.
    """
    mass, held = page.held(content, lambda b: len(b.text)), page.held(blocks)
    most = HOLDS * mass[0]
    mains, articles = sorted(i for i in page.mains if held[i]), sorted(i for i, outermost in page.articles.items() if outermost and held[i])
    main = mains[0] if mains and mass[mains[0]] > most else None
    if len(articles) == 1 and mass[articles[0]] > most:
        outside = main is not None and any(b.title and page.inside(b, main) and not page.inside(b, articles[0]) for b in blocks)
        return (main if outside else articles[0]), True
    if main is not None:
        return main, True
    titles = [b for b in blocks if b.title]
    whole = content + (titles if len(titles) == 1 else [])
    first, last, leaf = min(b.at for b in whole), max(b.at for b in whole), min(b.leaf for b in whole)
    at = first
    while at and not (at <= first and last < page.end[at] and at < leaf):
        at = page.parent[at]
    return at, False


def main_text(html: str) -> str:
    """The article of a page, blocks joined by an empty line; empty if there is none."""
    page, ended = Blocks(), html.rfind(">") + 1
    page.feed(html[:ended])
    page.feed(html[ended:].replace("<", "&lt;"))  # no tag ends there
    page.close()
    for b in page.blocks:
        b.text = " ".join("".join(b.parts).split())
    blocks = [b for b in page.blocks if b.text]
    out = set_apart(page, blocks)
    why = [frozenset()]
    for i in range(1, len(page.parent)):
        outer = why[page.parent[i]]
        why.append(outer | {out[i]} if i in out and out[i] not in outer else outer)
    blocks = [b for b in blocks if not why[b.at] or why[b.at] == {"header"} and b.heading]
    running = [b for b in blocks if not why[b.at] and (b.linked <= 0.5 * len("".join(b.text.split())) or b.heading)]
    paths = content_paths(running) if running else set()
    content = [b for b in running if b.path in paths] or running
    if not content:
        return ""
    article, marked = article_of(page, blocks, content)
    near = {b.around for b in content}
    plain = {id(b) for b in blocks if why[b.at]} | {id(b) for b in running}
    kept = [b for b in blocks if page.inside(b, article) and (marked or id(b) in plain or b.around in near)]
    return "\n\n".join(b.text for b in kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with the html replaced by `main_text` (string, empty if none).

    All other columns stay; one of that name is replaced. Null html counts as
    empty; markup of any length is read whole; repeated pages are extracted
    alike. An empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    carried = [c for c in pages.columns if c not in (html, "main_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*carried, "main_text"])

    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carried] + ["main_text string"])
    return pages.select(F.coalesce(pages[html], F.lit("")).alias("_html"), *[pages[c] for c in carried]).mapInArrow(run, schema)

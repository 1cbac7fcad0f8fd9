"""Main text of web pages, from the containers that a host's pages agree on."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.session import materialize

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)|(?P<text>[^<]+)|<",
    re.S | re.A,
)
#: One step through a tag: an attribute, or the end of the tag. A quote that nothing
#: closes is a plain character of an unquoted value, as are quotes inside of one.
ATTRIBUTE = re.compile(
    r"[\s/]*+(?:(?P<stop>>|\Z)|(?P<name>=?+[^\s/>=]*+)(?:\s*+=\s*+(?:\"(?P<double>[^\"]*+)\"|'(?P<single>[^']*+)'|(?P<plain>[^\s>]*+)))?)",
    re.S | re.A,
)
NAME_PART = re.compile(r"[a-z]+")
NUMBER = re.compile(r"\d+")

# What HTML says about its elements.
UNSEEN = frozenset("script style noscript template svg iframe object canvas math head title select option textarea button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "html body div article section main aside nav header footer form table thead tbody tfoot tr td th ul ol dl menu "
    "blockquote figure details dialog fieldset center address".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre caption figcaption summary legend hr".split())
SECTIONS = frozenset("article main section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINES = HEADINGS | {"p"}  # a block border ends them
#: An element that begins here ends an open one of these, up to the given limits.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
ENDS |= {"tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Elements, roles and words in class or id that mark what is not the article.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer masthead banner ad ads advert advertisement adverts advertising promo "
    "sponsor sponsored cookie cookies consent notice notices alert gdpr newsletter subscribe signup comment comments "
    "respond disqus related recommended share sharing social breadcrumb breadcrumbs popup modal overlay widget login "
    "search pagination pager toolbar".split()
)

#: How sure a mark is: the element itself says so, a whole word of class or id, a part of one.
SURE, WORD, PART = 3, 2, 1


#: A depth that no container has.
NOWHERE = 2**62


@dataclass
class Block:
    """A stretch of text between block borders."""

    container: int  # the innermost container around it
    heading: bool
    mark: int  # the innermost element around it that may be no article or a header, -1 if none
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    aside: _Open | None = None  # the innermost element that is no article
    header: _Open | None = None

    @cached_property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())

    def from_level(self) -> tuple[int, int]:
        """The depth from which containers have the block in their text, and the container above."""
        aside = (self.aside.level, self.aside.above) if self.aside else (0, -1)
        if not self.header:
            return aside
        return max(aside, (1, 0) if self.heading else (self.header.level, self.header.above))


@dataclass
class _Open:
    """An open element; ``above`` is the container one level up from ``level``."""

    tag: str
    aside: int  # how sure it is that it is no article, 0 if nothing says so
    header: int
    level: int
    above: int
    outer: int = -1  # the next element around it that is marked


@dataclass
class Page:
    """The blocks of a page in order, and its containers; container 0 is the page itself.

    Containers whose paths of generalised tags and classes are equal are one container.
    """

    blocks: list[Block] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    depths: list[int] = field(default_factory=lambda: [0])
    paths: list[int] = field(default_factory=lambda: [0])  # numbers of the paths
    sections: list[int] = field(default_factory=lambda: [NOWHERE])  # depth of the outermost section
    children: dict[tuple[int, str], int] = field(default_factory=dict)

    def child(self, parent: int, name: str) -> int:
        """The container ``name`` (tag.class) inside ``parent``."""
        number = self.children.setdefault((parent, name), len(self.tags))
        if number == len(self.tags):
            tag = name.split(".")[0]
            self.tags.append(tag)
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.paths.append(path_number([name], self.paths[parent]))
            self.sections.append(min(self.sections[parent], self.depths[-1] if tag in SECTIONS else NOWHERE))
        return number

    def link_list(self, block: Block) -> bool:
        """Whether a block is an item of a list and nothing but links: a menu."""
        return self.tags[block.container] in ("ul", "ol") and 0 < len(block.text) <= block.linked

    def own_heading(self, block: Block) -> bool:
        """Whether a block is a heading in the header of an article, not of the site."""
        return block.heading and block.header is not None and self.sections[block.container] <= block.header.level


def path_number(names: Iterable[str], above: int = 0) -> int:
    """The number of a path of containers, each a ``tag.class``, below the path ``above``."""
    for name in names:
        step = blake2b(above.to_bytes(8, "little", signed=True) + name.encode("utf-8", "surrogatepass"), digest_size=8)
        above = int.from_bytes(step.digest(), "little", signed=True)
    return above


def _marks(tag: str, attributes: dict[str, str]) -> tuple[int, int]:
    """How sure it is that an element is no article, and that it is a header."""
    aside, header = 0, SURE if tag == "header" else 0
    if tag in ASIDE_TAGS or attributes.get("role", "") in ASIDE_ROLES or attributes.get("aria-hidden") == "true":
        aside = SURE
    if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", ""):
        aside = SURE
    if tag not in ("html", "body"):
        for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
            if not ASIDE_WORDS.isdisjoint(parts := NAME_PART.findall(name)):
                aside = max(aside, WORD if name in ASIDE_WORDS else PART)
            if "header" in parts:
                header = max(header, WORD if name == "header" else PART)
    return aside, header


def _settle(blocks: list[Block], marked: list[_Open]) -> None:
    """Sets each block's aside and header, by the text that names would take away.

    A part of a name marks small parts of a page only: an element that holds most of the
    running text outside of surer asides is part of the article. So is one that a whole
    word marks, if no running text is left without it. ``marked`` has outer elements
    before inner ones, so one pass down and one up see each element once.
    """
    sizes = [max(len(b.text) - 2 * b.linked, 0) for b in blocks]
    refuted = [False] * len(marked)
    for sure, most in ((WORD, 1.0), (PART, 0.5)):
        left_out: list[bool] = []
        for i, o in enumerate(marked):
            left_out.append((o.aside > sure and not refuted[i]) or (o.outer >= 0 and left_out[o.outer]))
        held = [0] * len(marked)
        whole = 0
        for block, size in zip(blocks, sizes, strict=True):
            if block.mark < 0 or not left_out[block.mark]:
                whole += size
                if block.mark >= 0:
                    held[block.mark] += size
        for i in range(len(marked) - 1, -1, -1):
            if marked[i].outer >= 0:
                held[marked[i].outer] += held[i]
            if whole and sure in (marked[i].aside, marked[i].header) and (held[i] > most * whole or held[i] == whole):
                refuted[i] = True
    asides: list[_Open | None] = []
    headers: list[_Open | None] = []
    for i, o in enumerate(marked):
        outer_aside, outer_header = (asides[o.outer], headers[o.outer]) if o.outer >= 0 else (None, None)
        asides.append(o if o.aside == SURE or (o.aside and not refuted[i]) else outer_aside)
        headers.append(o if o.header == SURE or (o.header and not refuted[i]) else outer_header)
    for block in blocks:
        if block.mark >= 0:
            block.aside, block.header = asides[block.mark], headers[block.mark]


def blocks_of(html: str) -> Page:
    """The blocks of a page in order, each with the container it stands in.

    A container is named ``tag.class``, numbers in the class written as #. Elements that
    are never text are left out; tags left open end where HTML says. The time goes with
    the length of the page, however its elements are nested.
    """
    page = Page()
    stack: list[_Open] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements in the stack, by tag and by kind
    boxes: list[int] = [0]  # the open containers
    marks: list[int] = []  # the open marked elements
    marked: list[_Open] = []
    endless: set[str] = set()  # elements without a further end tag
    current: Block | None = None
    at, size = 0, len(html)

    def kinds(tag: str) -> list[str]:
        named = (("#box", CONTAINERS), ("#heading", HEADINGS), ("#line", LINES))
        return [tag, *(kind for kind, tags in named if tag in tags)]

    def close_to(depth: int) -> None:
        nonlocal current
        while len(stack) > depth:
            gone = stack.pop()
            for kind in kinds(gone.tag):
                places[kind].pop()
            if gone.tag in CONTAINERS:
                boxes.pop()
            if gone.aside or gone.header:
                marks.pop()
            if gone.tag in CONTAINERS or gone.tag in LEAVES:
                current = None

    def innermost(tags, limits=()) -> int:
        """The place of the last open element of ``tags``, -1 if there is none or a limit is inside of it."""
        found, limit = (max((places[t][-1] for t in names if places.get(t)), default=-1) for names in (tags, limits))
        return found if found >= limit else -1

    while at < size:
        token = TOKEN.match(html, at)
        at = token.end()
        text, tag = token["text"], token["tag"]
        if text is None and tag is None:
            if token[0] != "<":
                continue
            text = "<"
        if text is not None:
            if current is None:
                if text.isspace():
                    continue
                current = Block(boxes[-1], bool(places["#heading"]), marks[-1] if marks else -1)
                page.blocks.append(current)
            text = entities.unescape(text)
            current.pieces.append(text)
            if places["a"]:
                current.linked += len(text)
            continue
        tag = tag.lower()
        attributes, closed, at = _attributes(html, at)
        if token["end"]:
            if (i := innermost((tag,))) >= 0:
                close_to(i)
            continue
        if tag in RAW or tag in UNSEEN:
            if tag in RAW or not (closed or tag in endless):
                after = _after(html, tag, at)
                endless.update([tag] if after == at else [])
                at = after
            continue
        if tag in CONTAINERS or tag in LEAVES:
            current = None
            if (i := innermost(("#line",), ("#box",))) >= 0:
                close_to(i)
            if tag in ENDS and (i := innermost(*ENDS[tag])) >= 0:
                close_to(i)
        elif tag == "br" and current is not None:
            current.pieces.append(" ")
        if tag in VOID:
            continue
        opened = _Open(tag, 0, 0, 0, boxes[-1])
        if tag in CONTAINERS or tag in LEAVES:
            opened.level = page.depths[boxes[-1]] + 1
            opened.aside, opened.header = _marks(tag, attributes)
            if opened.aside or opened.header:
                opened.outer = marks[-1] if marks else -1
                marks.append(len(marked))
                marked.append(opened)
            if tag in CONTAINERS:
                classes = ".".join(sorted(NUMBER.sub("#", attributes.get("class", "").lower()).split()))
                boxes.append(page.child(boxes[-1], f"{tag}.{classes}" if classes else tag))
        for kind in kinds(tag):
            places[kind].append(len(stack))
        stack.append(opened)
    _settle(page.blocks, marked)
    return page


def _attributes(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes of a tag from the end of its name on, whether it closes itself, and its end."""
    found: dict[str, str] = {}
    while True:
        step = ATTRIBUTE.match(html, at)
        at = step.end()
        if step["stop"] is not None:
            return found, "/" in step[0], at
        found.setdefault(step["name"].lower(), step["double"] or step["single"] or step["plain"] or "")


def _after(page: str, tag: str, at: int) -> int:
    """The place after the end tag of an element whose content does not count."""
    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
    if tag in RAW:
        return end.end() if end else len(page)
    return end.end() if end else at


def scores_of(page: Page) -> dict[int, float]:
    """How well each container holds the page's article, and little else; at most 1.

    Characters of running text in and below a container count for it; those of links and
    of blocks that are no article count against it, if they are part of its text. Blocks
    that are left out of its text do neither, so a container that holds the whole article
    never scores below a part of it. A block counts for its innermost container and is
    taken away above the last one that has it; sums are passed up once.
    """
    sums = [0] * len(page.tags)
    whole = root = 0
    for block in page.blocks:
        size = len(block.text)
        other = block.aside or (block.header and not page.own_heading(block))
        good = -size if other else max(size - 2 * block.linked, -size)
        whole += max(good, 0)
        level, above = block.from_level()
        stands = level <= page.depths[block.container] and not page.link_list(block)
        if stands:
            sums[block.container] += good
            if level:
                sums[above] -= good
        if block.heading and not block.aside and (level or not stands):
            root += good  # a heading counts for the root like for the body
    for i in range(len(sums) - 1, 0, -1):
        sums[page.parents[i]] += sums[i]
    sums[0] += root
    return {i: score / whole for i, score in enumerate(sums) if score > 0} if whole else {}


def main_text(page: Page, path: int | None) -> str:
    """The article's blocks in the container of that path number, in page order; in the
    page's own best container if there is no text (of equally good ones the innermost,
    then the first)."""
    text = _under(page, page.paths.index(path)) if path in page.paths else ""
    if text:
        return text
    scores = scores_of(page)
    return _under(page, max(scores, key=lambda i: (scores[i], page.depths[i], -i), default=0))


def _under(page: Page, container: int) -> str:
    inside = [i == container for i in range(len(page.tags))]
    for i in range(1, len(inside)):
        inside[i] = inside[i] or inside[page.parents[i]]
    level = page.depths[container]
    kept = (b.text for b in page.blocks if inside[b.container] and b.from_level()[0] <= level and not page.link_list(b))
    return "\n\n".join(t for t in kept if t)


def host_of(url: Column) -> Column:
    """The host in lower case, without a port; NULL if there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row per host: ``host`` and ``path``, the number of the path its pages vote for.

    A path is one ``tag.class`` per container from the page down; ``path_number`` gives its
    number. Every page gives each of its containers a share of a vote; shares are summed
    per host and path with map-side combine, so a host may hold any share of the pages. Of
    equally good paths the longest wins, then the one of the greatest number.
    """

    @F.pandas_udf("array<struct<path: long, depth: int, share: double>>")
    def votes(column: pd.Series) -> pd.Series:
        pages = (blocks_of(page) for page in column)
        return pd.Series([[(p.paths[i], p.depths[i], s) for i, s in scores_of(p).items()] for p in pages])

    voted = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host IS NOT NULL AND html IS NOT NULL")
    each = voted.select("host", F.explode(votes("html")).alias("vote")).select("host", "vote.*")
    summed = each.groupBy("host", "path", "depth").agg(F.round(F.sum("share"), 6).alias("votes"))
    rank = F.struct("votes", "depth", "path")
    return summed.groupBy("host").agg(F.max(rank).alias("best")).select("host", F.col("best.path").alias("path"))


#: Hosts up to which their paths are sent to every task; beyond it the pages are
#: joined with them by shuffle. A host and its path take some 200 bytes.
BROADCAST_HOSTS = 200_000


def extracted(pages: DataFrame, url: str = "url", html: str = "html", into: str = "main_text") -> DataFrame:
    """Adds the column ``into``: the main text, re-extracted under the host's path.

    Menus, headers, footers, asides, adverts, notices, forms, comments, scripts and
    hidden parts are left out; headings inside the article's own header stay. Blocks are
    joined by an empty line, white space in a block is one space, character references
    are decoded; nothing is cut. A page without text under its host's path, or without a
    host, uses its own best container. NULL or empty pages have an empty text. Repeated
    rows stay; a column that has the name ``into`` already is replaced.
    """
    host, path = _free(pages, "host"), _free(pages, "path")  # no clash with columns of the pages
    winners = materialize(host_paths(pages, url, html).withColumnsRenamed({"host": host, "path": path}))
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    joined = pages.withColumn(host, host_of(F.col(url))).join(winners, host, "left")

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for column, paths in batches:
            known = [None if pd.isna(p) else int(p) for p in paths]
            yield pd.Series([main_text(blocks_of(page or ""), p) for page, p in zip(column, known, strict=True)])

    added = [] if into.lower() in (c.lower() for c in pages.columns) else [into]
    found = text(F.col(html), F.col(path).cast("string"))  # a whole number is lost in a column of floats
    return joined.withColumn(into, found).select(*pages.columns, *added)


def _free(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name = f"_{name}"
    return name

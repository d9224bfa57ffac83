"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each under its path of tags from the root. For every path
the lengths of text and of link text, the punctuation and the number of blocks are added up; its ratio is the
text and punctuation a block of it has on average. Ratios are smoothed over paths that follow each other in the page,
fused with the share of text outside links, and paths above a part of the page's mean are content. The
smallest region that holds most of their text gives the article: all its blocks stay whatever their ratio, but for paths of
link text alone, and for parts that are navigation, notices, forms, adverts or comments by tag, role or class.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import slices, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
# Elements that never hold article text
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea input iframe "
    "object embed svg canvas math audio video map menu dialog".split()
)
RAW = frozenset("script style".split())
# Words of class, id and role that name parts beside the article
SIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent notice gdpr popup modal "
    "newsletter subscribe subscription signup login comment comments disqus reply replies respond discussion complementary contentinfo search "
    "pagination pager toolbar".split()
)
# Of these, words that also name an article's own parts and wrappers; alone they do not tell
LOOSE_WORDS = frozenset("header banner sidebar aside widget related recommended notice consent search discussion toolbar promotion".split())
REPLY_WORDS = frozenset("comment comments disqus reply replies respond".split())
ARTICLE_WORDS = frozenset("article post entry content story title page section".split())
ARTICLE_TAGS = ("article", "main")
# Elements that are parts of an article, never its region
PARTS = frozenset("p li dt dd ul ol dl pre table caption thead tbody tfoot tr figure figcaption blockquote h1 h2 h3 h4 h5 h6".split())
# A new paragraph ends the open one, a new item or cell the one before
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
SPACE = re.compile(r"\s+")
# A path is content above this part of the page's mean ratio; the article region holds this part of the content.
THRESHOLD = 0.5
REGION_PART = 0.6


class Block:
    __slots__ = ("path", "nodes", "inside", "pieces", "link")

    def __init__(self, path: tuple[str, ...], nodes: tuple[int, ...], inside: tuple[int, ...]):
        self.path, self.nodes, self.inside, self.pieces, self.link = path, nodes, inside, [], 0

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.pieces)).strip()


def side_words(attrs) -> frozenset[str]:
    """Side words of class, id and role; a header with a word for articles in its name is the article's own."""
    out = set()
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for own in value.lower().split():
                words = set(re.split(r"[^a-z]+", own))
                out |= (words & SIDE_WORDS) - ({"header"} if words & ARTICLE_WORDS else set())
    return frozenset(out)


class Blocks(HTMLParser):
    """Blocks of a page in order, without what stands in dropped elements; ``named`` has the side words of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, number of the element, whether its text is dropped
        self.blocks: list[Block] = []
        self.elements = 0
        self.current: Block | None = None
        self.tags: dict[int, str] = {}
        self.named: dict[int, frozenset[str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.current = None
            self._imply_end(tag)
        if tag == "br":
            self._add(" ")
        if tag in VOID:
            return
        hidden = any(n == "hidden" or (n == "aria-hidden" and v == "true") or (n == "style" and v and re.search(r"display\s*:\s*none", v)) for n, v in attrs)
        body = tag in ("html", "body", *ARTICLE_TAGS)
        inside = any(t in ARTICLE_TAGS for t, _, _ in self.open)
        out = tag in DROPPED and not (tag == "header" and inside) or (hidden and not body)
        self.elements += 1
        self.tags[self.elements] = tag
        if not body and (words := side_words(attrs)):
            self.named[self.elements] = words
        self.open.append((tag, self.elements, out or (bool(self.open) and self.open[-1][2])))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in RAW:
            self.handle_endtag(tag)

    def _imply_end(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            own = self.open[depth][0]
            if tag in CLOSED_BY.get(own, ()):
                del self.open[depth:]
                return
            if own not in INLINE:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in INLINE:
            self.current = None
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return
            # a stray end of an inline element never closes the block around it
            if tag in INLINE and self.open[depth][0] not in INLINE:
                return

    def handle_data(self, data):
        if not self.open or not self.open[-1][2]:
            self._add(data)

    def _add(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        if self.current is None:
            if not data.strip():
                return
            blocks = [(t, n) for t, n, _ in self.open if t not in INLINE]
            self.current = Block(tuple(t for t, _ in blocks), tuple(n for _, n in blocks), tuple(n for _, n, _ in self.open))
            self.blocks.append(self.current)
        self.current.pieces.append(data)
        if any(t == "a" for t, _, _ in self.open):
            self.current.link += len(data)


def path_scores(blocks: list[tuple[Block, str]]) -> dict[tuple[str, ...], float]:
    """Smoothed ratio of each path, times the share of its text outside links."""
    size, links, count = defaultdict(float), defaultdict(float), defaultdict(int)
    order: list[tuple[str, ...]] = []
    for block, text in blocks:
        if block.path not in count:
            order.append(block.path)
        count[block.path] += 1
        size[block.path] += len(text) + 10 * len(PUNCTUATION.findall(text))
        links[block.path] += min(block.link, len(text))
    raw = [size[p] / count[p] for p in order]
    out = {}
    for k, path in enumerate(order):
        near = raw[max(0, k - 1) : k + 2]
        smooth = 0.75 * raw[k] + 0.25 * sum(near) / len(near)
        out[path] = smooth * (1 - links[path] / max(1.0, size[path]))
    return out


def link_paths(blocks: list[tuple[Block, str]]) -> set[tuple[str, ...]]:
    """Paths that have text in links alone: menus."""
    out, plain = set(), set()
    for block, text in blocks:
        (out if block.link >= len(text) else plain).add(block.path)
    return out - plain


def without_sides(parser: Blocks) -> list[tuple[Block, str]]:
    """Blocks with their texts, but for those in elements that are beside the article by name.

    A name never outweighs the text: the element stays if it holds the page's largest article or main. On a page without
    one it stays with most of the text outside links (nine tenths, or an h1 besides, if firmly named: adverts and
    replies can be longer than a short article). With loose words only it
    also stays if the block around a character of it has as much such text as a block outside firmly named elements has on average.
    """
    blocks = [(b, t) for b in parser.blocks if (t := b.text())]
    if not parser.named:
        return blocks
    plain, own_squares = defaultdict(int), defaultdict(int)
    total = 0
    for b, t in blocks:
        n = max(0, len(t) - b.link)
        total += n
        for node in b.inside:
            plain[node] += n
            own_squares[node] += n * n
    replies = {n for n, words in parser.named.items() if words & REPLY_WORDS}
    articles = {}
    for b, _ in blocks:
        for node in b.inside:
            if parser.tags[node] in ARTICLE_TAGS and node not in articles:
                articles[node] = {n for n in b.inside if n <= node}
    own = {n: above for n, above in articles.items() if not above & replies} or articles
    largest = max(own, key=lambda n: plain[n], default=None)
    holders = own[largest] if largest is not None else set()
    firm = {n for n, words in parser.named.items() if not words <= LOOSE_WORDS} - holders
    titled = {n for b, _ in blocks if "h1" in b.path for n in b.inside}
    rest = [max(0, len(t) - b.link) for b, t in blocks if firm.isdisjoint(b.inside)]
    usual = sum(rest) / max(1, len(rest))

    def beside(node: int) -> bool:
        most = 9 if node in firm and node not in titled else 5
        if node in holders or (largest is None and 10 * plain[node] >= most * total > 0):
            return False
        return node in firm or own_squares[node] < usual * plain[node] or not plain[node]

    sides = {n for n in parser.named if beside(n)}
    return [(b, t) for b, t in blocks if sides.isdisjoint(b.inside)]


def main_text(html: str | None) -> str:
    """Article text of one page; empty if it has none."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    blocks = without_sides(parser)
    if not blocks:
        return ""
    scores = path_scores(blocks)
    total = sum(len(t) for _, t in blocks)
    mean = sum(scores[b.path] * len(t) for b, t in blocks) / total
    content = [(b, t) for b, t in blocks if scores[b.path] >= THRESHOLD * mean] or blocks
    weight = sum(len(t) for _, t in content)
    held, first = defaultdict(int), {}
    for b, t in content:
        for depth, node in enumerate(b.nodes):
            held[node] += len(t)
            first[node] = depth
    wanted = [n for n in held if held[n] >= REGION_PART * weight and parser.tags[n] not in PARTS]
    named = [n for n in wanted if parser.tags[n] in ARTICLE_TAGS]
    region = max(named or wanted, key=lambda n: first[n], default=None)
    chosen = [(b, t) for b, t in blocks if region is None or region in b.nodes]
    if not named:
        kept, menus = {b.path for b, _ in content}, link_paths(chosen)
        chosen = [(b, t) for b, t in chosen if b.path in kept or b.path not in menus or re.fullmatch("h[1-6]", b.path[-1])]
    return "\n".join(t for _, t in chosen)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` with ``text`` and ``n_chars`` (code points) of every whole page.

    A null or empty page has an empty text; broken markup is read as far as it says something; repeated rows stay.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    fields = [*pages.select(*keep).schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())]

    def read(batches):
        for part in slices(batches, "__html"):
            texts = [main_text(x) for x in part.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i) for i in range(part.num_columns - 1)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [f.name for f in fields],
            )

    return pages.select(*keep, text_or_empty(html).alias("__html")).mapInArrow(read, StructType(fields))

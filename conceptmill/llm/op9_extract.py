"""Main text of web pages by the distribution of text over lines.

The page's markup is stripped into lines, one a block, in page order. A line weighs as much as its text is long; mostly linked ones and
those of menus, headers, footers, adverts, comments and the like weigh nothing. The curve sums the weights of each few neighbouring
lines; it surges where text begins and dives where it ends. From the lines between a surge and the next dive the innermost element
around the heavy ones is found, and with it the light lines that belong to them: links in the middle, a list of references at the end.
Tags and names cut lines, lower weights and bound elements; what is text the curve says, over all lines alike.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Elements without text of the page, such that hold other text than the article's, elements without an end tag, and such within a block.
_DROPPED = frozenset("script style noscript template form button select textarea iframe svg math canvas object audio video dialog head title".split())
_ASIDE = frozenset("nav header footer aside menu".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img script style template".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
#: Whole words of class and role, and whole ids, of elements other than the article; and what such a word may begin or end with.
_NAMES = frozenset("""
    adbox banner breadcrumb breadcrumbs comment comment-list comment-section consent disqus_thread site-footer header site-header masthead main-menu navbar
    navigation notice notices pagination pager popup modal promo related related-posts related-articles replies share sharing share-buttons side-bar social
    subscribe subscription toolbar widget contentinfo complementary
""".split())
_PARTS = frozenset("ad ads advert adverts advertisement comments cookie cookies disqus footer menu nav newsletter sidebar sponsor sponsored".split())
#: A quote counts after an equals sign alone, so that a stray one hides no end of a tag.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?i)(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_WHITE = re.compile(r"\s+")
#: An open p ends where one of these begins.
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul details dialog figcaption menu".split())
_ITEMS = ("li", "dt", "dd", "tr", "td", "th", "option")
_KEPT, _ARTICLE = frozenset("article main body html".split()), frozenset("article main".split())
#: Elements whose lines count in full even if they are links, and whose names say nothing.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
#: What is around everything; lines have nothing in common by it.
_ROOT = frozenset(("html", "body", ""))


class Element:
    """An element whose lines weigh nothing, unless it turns out to hold the article or most of the page; around: the next such one."""

    __slots__ = ("around", "holds", "kind", "size", "void")

    def __init__(self, kind: str, around: Element | None):
        self.kind, self.around, self.holds, self.size, self.void = kind, around, False, 0, False


class Block:
    """A block element: what is around it, its depth, its number by beginning, its lines (first to last), and the article or main around
    it, itself included."""

    __slots__ = ("around", "article", "depth", "first", "last", "name", "serial")

    def __init__(self, name: str, around: Block | None, first: int, serial: int):
        self.name, self.around, self.first, self.last, self.serial = name, around, first, -1, serial
        self.depth = around.depth + 1 if around else 0
        self.article = self if name in _ARTICLE else around.article if around else None


class Line:
    __slots__ = ("block", "light", "text", "under")

    def __init__(self, text: str, light: bool, block: Block, under: Element | None):
        self.text, self.light, self.block, self.under = text, light, block, under


def _kind(name: str, rest: str, inside: bool) -> str:
    """What an element's tag and attributes make of it: "dropped", "aside", "named" or nothing."""
    named = ""
    for m in _ATTR.finditer(rest):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return "dropped"
        if key in ("class", "id", "role") and name not in _PROSE:
            for word in value.split():
                parts = re.split("[-_]", word)
                if word in _NAMES or parts[0] in _PARTS or parts[-1] in _PARTS:
                    named = "named"
    if name in _DROPPED:
        return "dropped"
    # a header inside an article holds its title
    if name in _ASIDE and not (name == "header" and inside):
        return "aside"
    return "" if name in _KEPT else named


def lines_of(page: str) -> list[Line]:
    """The page's lines of text, in order, each with its block and the elements around it that may not be text; light: mostly links,
    but in a paragraph or heading. Time and memory follow the page's length, however deep its elements."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, Element | None, Block | None]] = []  # open elements: name, what under was before, what block was before
    count: Counter[str] = Counter()  # of open elements, so that the stack is searched only for what it holds
    elements: list[Element] = []
    links = 0
    block, under = Block("", None, 0, 0), None
    at = serial = 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Line(text, 2 * links > len(text) and block.name not in _PROSE, block, under))
                if under is not None:
                    under.size += len(text)
            parts, links = [], 0

    def close(k: int) -> None:
        nonlocal block, under
        for name, _, before in reversed(stack[k:]):
            count[name] -= 1
            if before is not None:
                block.last, block = len(out), before
        under = stack[k][1]
        del stack[k:]

    def last(*names: str) -> int | None:
        return next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in names), None) if any(count[n] for n in names) else None

    def say(text: str) -> None:
        nonlocal links
        if text:
            parts.append(text)
            if count["a"]:
                links += len(text.strip())

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:  # a bare "<"
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        is_block = name not in _INLINE
        if is_block:
            flush()
        if m["end"]:
            k = last(name)
            # a stray end tag doesn't close the article
            if k is not None and (name in _KEPT or name in _ASIDE or name in _DROPPED or block.article is None or block.article.depth <= _depth(stack, k)):
                close(k)
            continue
        if name in _ENDS_P and (k := last("p")) is not None and not any(s[0] in _ENDS_P for s in stack[k + 1 :]):
            close(k)
        if name in _ITEMS:
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            if any(count[x] for x in same) and (k := last(*same, "ul", "ol", "dl", "table", "select")) is not None and stack[k][0] in same:
                close(k)
        if name in _VOID or m["rest"].rstrip().endswith("/"):
            continue
        if name in _RAW:  # its content isn't markup
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append((name, under, block if is_block else None))
        count[name] += 1
        if is_block:
            serial += 1
            block = Block(name, block, len(out), serial)
            if name in _ARTICLE and under is not None:
                under.holds = True
        if kind := _kind(name, m["rest"], block.article is not None):
            under = Element(kind, under)
            elements.append(under)
    flush()
    while stack:
        close(len(stack) - 1)
    block.last = len(out)
    for e in reversed(elements):
        if e.around is not None:
            e.around.size += e.size
            e.around.holds |= e.holds
    for e in elements:  # those around come first
        e.void = (e.kind != "named" and not e.holds) or (e.around is not None and e.around.void)
    marked = any(x.block.article is not None and not (x.under and x.under.void) for x in out)
    most = sum(len(x.text) for x in out) / 2
    for e in elements:  # an element that is most of a page without an article isn't struck by its name
        own = not e.holds and (e.kind != "named" or marked or e.size <= most)
        e.void = own or (e.around is not None and e.around.void)
    return out


def _depth(stack: list[tuple[str, Element | None, Block | None]], k: int) -> int:
    """The depth of the block that the stack's k-th element is or is in."""
    before = next((s[2] for s in stack[k:] if s[2] is not None), None)
    return before.depth + 1 if before is not None and stack[k][2] is not None else 1 << 30


#: Lines of a window, and the sum at which the curve surges; a page, or an article, whose curve stays below has its own highest sum as surge.
WIDTH, SURGE = 3, 60


def stretches(weights: list[int], width: int = WIDTH, surge: int = SURGE) -> list[tuple[int, int]]:
    """The lines from a surge to the next dive, in order. The curve at a line is the sum over it and the next width - 1 lines; it dives
    where that is nothing. A stretch between two dives counts if the curve reaches surge in it; it begins and ends with a line that weighs."""
    return [(a, b) for a, b, top in _rises(weights, width) if top >= max(1, min(surge, _top(weights, width)))]


def _top(weights: list[int], width: int) -> int:
    return max((sum(weights[k : k + width]) for k in range(len(weights))), default=0)


def _rises(weights: list[int], width: int) -> list[tuple[int, int, int]]:
    """The stretches between two dives, whether they surge or not: first and after the last line that weighs, and the curve's top."""
    sums = [sum(weights[k : k + width]) for k in range(len(weights))]
    found, k = [], 0
    while k < len(sums):
        end = k
        while end < len(sums) and sums[end]:
            end += 1
        if end > k:
            heavy = [i for i in range(k, end) if weights[i]]
            found.append((heavy[0], heavy[-1] + 1, max(sums[k:end])))
        k = end + 1
    return found


def _common(blocks: list[Block]) -> Block:
    """The innermost block around all: that around the first and the last that began."""
    a, b = min(blocks, key=lambda x: x.serial), max(blocks, key=lambda x: x.serial)
    while a is not b:
        if a.depth >= b.depth:
            a = a.around
        else:
            b = b.around
    return a


def main_text(page: str | None) -> str:
    """The main text of a whole page; empty if there is none. If the curve surges inside article or main, the stretches outside are
    none of it; an article whose curve stays below the surge has its own top as surge."""
    lines = lines_of(page or "")
    void = [x.under is not None and x.under.void for x in lines]
    weights = [0 if v or x.light else len(x.text) for x, v in zip(lines, void, strict=True)]
    if not any(weights):  # nothing but links
        weights = [0 if v else len(x.text) for x, v in zip(lines, void, strict=True)]
    rises = _rises(weights, WIDTH)
    least = max(1, min(SURGE, max((top for *_, top in rises), default=0)))
    marked = [r for r in rises if any(lines[i].block.article for i in range(r[0], r[1]) if weights[i])]
    if marked:
        least = min(least, max(top for *_, top in marked))
    kept: set[int] = set()
    for a, b, top in marked or rises:
        if top < least:
            continue
        heavy = [i for i in range(a, b) if weights[i] and (not marked or lines[i].block.article)]
        around = _common([lines[i].block for i in heavy])
        around = around.article or around
        if around.name in _ROOT:
            kept.update(range(heavy[0], heavy[-1] + 1))
        else:  # with the light lines of the same element, at its ends too
            kept.update(range(around.first, around.last))
    return "\n".join(lines[i].text for i in sorted(kept) if not void[i])


def extract(pages: DataFrame) -> DataFrame:
    """A row per row of pages: page_id, url, text, n_chars (code points). A null html is an empty page; nulls in the other columns
    and repeated rows stay; extra columns are left out; an empty table gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2, 500):
                texts = [main_text(p) for p in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages"))

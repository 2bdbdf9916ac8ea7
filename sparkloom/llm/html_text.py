"""Main text of web pages by tag-path ratios.

A page is a sequence of blocks, each with the path of elements from the root. Text length and sentence marks are summed
by path and divided by the number of its blocks; the ratios are smoothed along the page with a Gaussian and fused by
multiplication, and paths above a share of the page's best are content. What an element is called (nav, class="related")
is a factor on the ratio of its paths, and not even that if it holds nearly all text or the page's article. Content blocks
name the element that holds most of their text. All in it belongs to the text, also headings, short blocks and links, except
blocks whose names lower their ratio below that share; what is outside does not belong.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import spread
from .common import free_name, table

#: Share of the best path's fused ratio that makes a path content, and of content text that its element holds, or an
#: article or main element.
PATH_SHARE, HOLDER_SHARE, ARTICLE_SHARE = 0.12, 0.8, 0.5
#: Weights of the Gaussian for a block and its neighbours at distances 1 and 2.
SMOOTH = (0.5, 0.2, 0.05)
#: What names leave of a ratio: of an element for boilerplate; of a class or id for text that is not the page's, however long
#: it is; of one for what is mostly links, which prose outweighs; of one that has such a part.
BY_TAG, BY_NAME, BY_LINKS, BY_PART = 0.1, 0.1, 0.4, 0.5
#: An element with this share of the page's text is not boilerplate whatever its class; nor is a form then.
MOST_TEXT = 0.9

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/)?(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attributes2>[^<>]*+)(?:>|(?=<)|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements without text of the page.
_RAW = frozenset("script style noscript template textarea title iframe svg object canvas button select datalist audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FORMS = frozenset(("form", "fieldset"))
_WEAK = frozenset("nav header footer aside form fieldset dialog menu".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img math mi mo mn ms mrow msup msub msubsup mfrac msqrt mroot mtext mover munder munderover mstyle mspace semantics annotation".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that hold one block rather than a text.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre blockquote figcaption".split())
#: Where the search for an element of the same kind to close ends.
_SCOPE = frozenset("ul ol dl table article section div body html td th".split())
_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification overlay pagination paywall popup promo promoted promotion related recommended share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Of these, names of what is mostly links or short, and which are words of articles too.
_LINKS = frozenset("banner header login menu menus notice notices notification overlay pagination related recommended share sharing social toolbar widget widgets".split())
#: In a name of two parts these say little.
_VAGUE = frozenset("header widget widgets notice notices login paywall".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_ARTICLE = frozenset(("article", "main"))
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")
_SPACE = re.compile(r"\s+")


def _factor(tag: str, attributes: str) -> float:
    """What the name and attributes of an element leave of its ratio."""
    factor = BY_TAG if tag in _WEAK else 1.0
    if not attributes or attributes.isspace():
        return factor
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            for token in value.split():
                parts = [x for x in re.split(r"[^a-z]+", token) if x]
                named = [x for x in parts if x in _NAMES]
                if named:
                    whole = len(named) == len(parts) or len(parts) == 2 and named[0] not in _VAGUE
                    factor = min(factor, (BY_LINKS if set(named) <= _LINKS else BY_NAME) if whole else BY_PART)
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            factor = min(factor, BY_TAG)
    return factor


class Block:
    __slots__ = ("text", "path", "elements", "links", "heading")

    def __init__(self, text: str, path: str, elements: tuple[int, ...], links: int, heading: bool):
        self.text, self.path, self.elements, self.links, self.heading = text, path, elements, links, heading


def blocks(page: str) -> tuple[list[Block], list[tuple[str, float]]]:
    """The blocks of a page, in page order, and (tag, factor of its name) of its elements by number.

    Scripts, styles, controls and the like have no blocks. Character references are decoded and white space in a block is
    one space. br ends a block. Elements that are not closed end with their parent; a new paragraph or item ends the one
    before.
    """
    found: list[Block] = []
    elements: list[tuple[str, float]] = []
    stack: list[tuple[str, int, str]] = []  # tag, number, step of the path
    parts: list[str] = []
    links = 0
    at, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                own = [s for s in stack if s[0] not in _INLINE]
                found.append(Block(text, ">".join(s[2] for s in own), tuple(s[1] for s in own), links, any(s[0] in _HEADINGS for s in own[-2:])))
            parts.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if text and not (stack and stack[-1][0] == "head"):
            parts.append(text)
            if in_link:
                links += len(text)

    def pop_to(index: int) -> None:
        nonlocal in_link
        if any(s[0] not in _INLINE for s in stack[index:]):
            flush()
        in_link -= sum(s[0] == "a" for s in stack[index:])
        del stack[index:]

    def close(kinds: tuple[str, ...], scope: frozenset) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                pop_to(i)
                return
            if stack[i][0] in scope:
                return

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        attributes = m["attributes"] or m["attributes2"] or ""
        if m["end"] or m["end2"]:
            if tag == "p" and not any(s[0] == "p" for s in stack):
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE:
                    break
            continue
        if tag == "xmp":  # text as it is
            end = re.compile(r"</xmp\b[^>]*>", re.I).search(page, at)
            flush()
            say(html.escape(page[at : end.start() if end else size]))
            flush()
            at = end.end() if end else size
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag == "body":
            close(("head",), frozenset())
        if tag in _CLOSE_P:
            close(("p",), _SCOPE)
        if tag in _SAME:
            close(_SAME[tag], frozenset(("ul", "ol", "dl", "table")))
        if tag not in _INLINE:
            flush()
        if attributes.rstrip().endswith("/") and tag in _INLINE:
            continue
        factor = _factor("" if tag == "header" and any(s[0] in _ARTICLE for s in stack) else tag, attributes)  # an article has a header of its own
        named = re.search(r"""class\s*=\s*["']?([\w-]+)""", attributes) if attributes else None
        stack.append((tag, len(elements), f"{tag}.{named[1]}" if named else tag))
        elements.append((tag, factor))
        in_link += tag == "a"
    flush()
    return found, elements


def evidence(own: list[Block], elements: list[tuple[str, float]]) -> list[float]:
    """What the names of a block's elements leave of its ratio."""
    held = [0] * len(elements)
    for b in own:
        for e in b.elements:
            held[e] += len(b.text)
    total = sum(len(b.text) for b in own)
    trusted = {e for b in own for i, e in enumerate(b.elements) if any(elements[x][0] in _ARTICLE and held[x] >= ARTICLE_SHARE * total for x in b.elements[i + 1 :])}
    factors = [1.0 if e in trusted or held[e] >= MOST_TEXT * total and (tag not in _WEAK or tag in _FORMS) else f for e, (tag, f) in enumerate(elements)]
    return [min((factors[e] for e in b.elements), default=1.0) for b in own]


def ratios(own: list[Block]) -> tuple[dict[str, float], dict[str, float]]:
    """The fused ratio of each path: mean text length and sentence marks of its blocks, smoothed along the page; and the same
    without smoothing."""
    sums: dict[str, list[float]] = defaultdict(lambda: [0, 0, 0])
    for b in own:
        s = sums[b.path]
        plain = max(0, len(b.text) - b.links)
        s[0] += plain
        s[1] += len(_MARKS.findall(b.text)) if plain else 0
        s[2] += 1
    lengths = [sums[b.path][0] / sums[b.path][2] for b in own]
    marks = [sums[b.path][1] / sums[b.path][2] for b in own]

    def smooth(values: list[float]) -> list[float]:
        n = len(values)
        return [sum(w * (values[i + d] if 0 <= i + d < n else 0.0) for j, w in enumerate(SMOOTH) for d in ({0} if j == 0 else (-j, j))) for i in range(n)]

    fused: dict[str, float] = defaultdict(float)
    for b, x, y, raw in zip(own, smooth(lengths), smooth(marks), lengths, strict=True):
        fused[b.path] = max(fused[b.path], (x * (1 + y)) ** 0.5 * raw**0.5)
    return fused, {b.path: (x * (1 + y)) ** 0.5 * x**0.5 for b, x, y in zip(own, lengths, marks, strict=True)}


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line; empty for a null page or one without content."""
    own, elements = blocks(page or "")
    if not own:
        return ""
    (fused, alone), left = ratios(own), evidence(own, elements)
    least = PATH_SHARE * max(fused[b.path] for b in own)
    # a name that speaks against a block is not outweighed by the text around it
    high = [(fused[b.path] if f >= BY_PART else min(fused[b.path], alone[b.path])) * f >= least > 0 for b, f in zip(own, left, strict=True)]
    chosen = list(high)
    if not any(chosen):
        return ""
    content = sum(len(b.text) for b, c in zip(own, chosen, strict=True) if c)
    held: dict[int, int] = defaultdict(int)
    for b, c in zip(own, chosen, strict=True):
        if c:
            for e in b.elements:
                held[e] += len(b.text)
    # the innermost element that holds most of the content: elements are numbered from the root on
    article = [e for e, n in held.items() if elements[e][0] in _ARTICLE and n >= ARTICLE_SHARE * content]
    holder = max((e for e, n in held.items() if elements[e][0] not in _LEAVES and n >= HOLDER_SHARE * content), default=None)
    if article and (holder is None or max(article) > holder):
        holder = max(article)
    if holder is None:
        return "\n".join(b.text for b, c in zip(own, chosen, strict=True) if c)
    strict = elements[holder][0] in _ARTICLE
    for i, b in enumerate(own):
        if holder in b.elements:
            # without an article around them, paths that are links only are menus
            chosen[i] = high[i] or left[i] >= BY_PART and (strict or b.heading or fused[b.path] > 0)
        elif strict or not b.heading and fused[b.path] < 4 * least:
            chosen[i] = False
    # headings right before the element's text
    first = next(i for i, b in enumerate(own) if holder in b.elements)
    while first and own[first - 1].heading and left[first - 1] >= BY_PART:
        first -= 1
        chosen[first] = True
    return "\n".join(b.text for b, c in zip(own, chosen, strict=True) if c)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` without the html, with text and n_chars (code points). Null and empty pages have an empty text,
    an empty table gives an empty table, repeated rows are rows each, and very long pages are read whole."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema]
    return pages.select(F.col(html_col).cast("string").alias(free_name("_html", keep)), *keep).mapInArrow(run, ", ".join([*fields, "text string, n_chars long"]))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(table(spark, sf_dir, "pages")).select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")

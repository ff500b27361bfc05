"""Main text of web pages with removal of site templates.

A page is read once into text events and element ranges.  Every element outside
the running text has a hash of its subtree (tag names and text, attributes left
out).  Spark counts on how many pages of a host each subtree occurs; subtrees
that recur on many of them are template and are deleted, besides what tags and
class names already show to be navigation, adverts, forms or comments.  Pages
are counted once for each content: the longest block of their articles, or the
whole body where there is no article.  So copies of an article make no template,
and what lies in an article is template only if it recurs beside different
longest blocks; blocks of text (paragraphs, headings, list items and so on) and
whatever holds the longest block never are.

Counting is a grouped sum over (host, subtree), combined before the shuffle: a
host with a third of all pages is many keys.  The list of recurring subtrees a
page has returns by page; it is broadcast only up to ``broadcast_rows`` pages,
beyond that it is joined by a shuffle.

What a page is about are its articles, but for those in another article or in
comments, lists of related pages and the like; nothing that is or encloses one of them
is ever removed by its name.  Inside an article ids remove nothing but comments that
hold a list or form, names remove no paragraph, heading or list item, and words such as
``related`` or ``nav`` remove only what is half links.  Scripts, styles, titles and text areas that are not closed reach
to the end of the page; other embedded parts that are not closed, and self-closed
ones, are empty.

Defined cases: a null or empty page has the empty text; a null address is a host
of its own; repeated pages are extracted one by one and count as pages; unclosed
and stray tags are closed or ignored; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.llm.common import steady, written

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul head".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr caption figcaption article main body html b i em strong a span u s sub sup code small mark q".split())
OUTSIDE = frozenset("nav footer aside form head button select dialog menu".split())
# Words of class names and ids that mark parts beside the article; inside it the weak ones need links to bear them out.
_NAME = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
COMMENTS = re.compile(_NAME.format(r"comments?|comment-?list|commentlist|disqus\w*|respond|reply|replies"), re.I)
STRONG = re.compile(_NAME.format(r"ads?|advert\w*|sponsor\w*|promo\w*|sidebar\w*|notices?|cookies?|consent|breadcrumbs?|masthead|share|sharing|newsletter|subscribe|popup|modal"
                                 r"|pagination|toolbar|widget\w*"), re.I)
WEAK = re.compile(_NAME.format(r"side|banner\w*|menus?|nav\w*|footer|social|related|login|search"), re.I)
LAYOUT = re.compile(r"(?:has|with|no)-\S+", re.I)  # names that tell of other parts
LISTED = frozenset("article ol ul li form textarea".split())
SELF_CLOSING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)),
                "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>", re.S)
MARKS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW_TO_END = frozenset("script style title textarea".split())
CLOSED = re.compile(r"(?:^|[\s\"'])/$")
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


# For each tag that may close others: tags among which the nearest open one decides.
NEAREST = ({"li", "ul", "ol", "menu"}, {"dt", "dd", "dl"}, {"option", "select"}, {"tr", "td", "th", "table"}, {"p", "div", "article", "section", "td", "body"})
NONE, DECIDING = (-1,) * len(NEAREST), frozenset().union(*NEAREST)
GROUP = {"li": 0, "dt": 1, "dd": 1, "option": 2, "tr": 3, "td": 3, "th": 3}


@dataclass
class Element:
    tag: str
    start: int  # of its events
    above: Element | None
    main: bool  # an article or main element
    by_class: str
    by_id: str
    near: tuple  # of each set of NEAREST the depth of the nearest open element, this one included
    stop: int = -1
    digest: int = 0
    chars: int = 0  # of its text, and of that what stands in links
    linked: int = 0
    mains: int = 0  # article and main elements in it
    listed: bool = False  # holds a list, a form or an article
    nested: bool = False  # in an article
    away: int = 0  # 1: in a part that a weak name sets apart, 2: in one that its tag or a strong name does
    principal: bool = False  # is what the page is about
    around: bool = False  # is or encloses that
    within: bool = False  # is inside that
    beside: bool = False
    parts: list[str] = field(default_factory=list)


def read(html: str) -> tuple[list[str | None], list[Element]]:
    """Text events in page order (None: a block ends), and all elements in page order with the events they span.

    One pass: an element knows the nearest open elements that decide what it
    closes, so the time grows with the page and not with its depth.
    """
    events: list[str | None] = []
    made: list[Element] = []
    stack: list[Element] = []
    open_: Counter = Counter()
    without_end: set[str] = set()

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            open_[e.tag] -= 1
            e.stop = len(events)
            e.digest = xxhash.xxh64_intdigest(f"{e.tag}({''.join(e.parts)})") >> 1
            e.linked = e.chars if e.tag == "a" else e.linked
            if stack:
                up = stack[-1]
                up.parts.append(f"<{e.digest}>")
                up.chars, up.linked, up.mains, up.listed = up.chars + e.chars, up.linked + e.linked, up.mains + e.mains + e.main, up.listed or e.listed or e.tag in LISTED

    def say(raw: str) -> None:
        if raw:
            text = unescape(raw)
            events.append(text)
            if stack:
                stack[-1].parts.append(text)
                stack[-1].chars += len(text.strip())

    def end_of(tag: str, at: int) -> int | None:
        """Where the embedded part ends that began before ``at``; parts of its kind inside it count."""
        depth = 1
        for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(html, at):
            if m[1]:
                depth -= 1
            elif tag not in RAW_TO_END and not m[0].endswith("/>"):
                depth += 1
            if not depth:
                return m.end()
        return None

    at, last = 0, html.rfind(">")
    while True:
        m = TAG.search(html, at) if at <= last else None
        if not m:
            rest = html[at:]
            say(rest[:rest.find("<")] if re.search("<[/!?a-zA-Z]", rest) and last < at else rest)
            break
        say(html[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            if tag in BLOCKS:
                events.append(None)
            continue
        if tag == "br":
            events.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                events.append(None)
            continue
        if tag in RAW:
            empty = CLOSED.search(m[3] or "") or tag in without_end
            end = None if empty else end_of(tag, at)
            if end is not None:
                at = end
            elif not empty and tag in RAW_TO_END:
                at = len(html)
            elif not empty:
                without_end.add(tag)
            continue
        if tag in BLOCKS:
            if tag in GROUP:
                near = stack[-1].near[GROUP[tag]] if stack else -1
                if near >= 0 and stack[near].tag in SELF_CLOSING[tag][0].split():
                    close(near)
            near = stack[-1].near[4] if stack else -1
            if near >= 0 and stack[near].tag == "p":
                close(near)
            events.append(None)
        marks = {k.lower(): a or b or c for k, a, b, c in MARKS.findall(m[3])} if m[3] else {}
        above = stack[-1] if stack else None
        near = above.near if above else NONE
        if tag in DECIDING:
            near = tuple(len(stack) if tag in kinds else near[i] for i, kinds in enumerate(NEAREST))
        by_class, by_id = (LAYOUT.sub("", marks[k]) if k in marks else "" for k in ("class", "id"))
        e = Element(tag, len(events), above, tag in ("article", "main") or marks.get("role") == "main", by_class, by_id, near)
        e.nested = above is not None and (above.nested or above.tag == "article")
        stack.append(e)
        made.append(e)
        open_[tag] += 1
    close(0)
    judge(made)
    return events, made


def named(e: Element, *kinds: re.Pattern) -> bool:
    return bool(e.by_class or e.by_id) and any(k.search(e.by_class) or k.search(e.by_id) for k in kinds)


def judge(elements: list[Element]) -> None:
    """Which elements the page is about (principal), and which lie beside that (beside).

    Articles are principal that are in no other article and in no part beside the
    article (comments, related pages, navigation); a part that holds all of a
    page's articles is none such.  Without articles main elements are.
    """
    total = sum(e.main for e in elements)
    for e in elements:
        up = e.above
        if up is not None:
            e.away = up.away
            if up.mains < total and up.tag not in ("body", "html") and not up.main:
                hard = up.tag in OUTSIDE and up.tag != "form" or named(up, COMMENTS, STRONG)
                e.away = max(e.away, 2 if hard else int(named(up, WEAK)))
    free = [e for e in elements if e.main and not e.nested]
    for most, tags in ((0, {"article"}), (0, None), (1, {"article"}), (1, None), (2, {"article"}), (2, None)):
        choice = [e for e in free if e.away <= most and (tags is None or e.tag in tags)]
        if choice:
            for e in choice:
                e.principal = True
                up = e
                while up is not None and not up.around:
                    up.around, up = True, up.above
            break
    for e in elements:
        e.within = e.above is not None and (e.above.within or e.above.principal)
        prose = e.tag in PROSE and e.tag not in ("td", "article", "main")
        if e.around or e.tag in ("body", "html"):
            continue
        if e.tag in OUTSIDE or e.tag == "header" and not e.within:
            e.beside = True
        elif not (e.by_class or e.by_id):
            continue
        elif not e.within:
            e.beside = bool(STRONG.search(e.by_class) or COMMENTS.search(e.by_class)) if prose else named(e, COMMENTS, STRONG, WEAK)
        elif not prose:
            told = bool(STRONG.search(e.by_class) or COMMENTS.search(e.by_class))
            e.beside = told or bool(COMMENTS.search(e.by_id)) and e.listed or bool(WEAK.search(e.by_class)) and e.chars > 0 and 2 * e.linked >= e.chars


def articles(elements: list[Element]) -> list[Element]:
    return [e for e in elements if e.principal]


def longest(events: list[str | None], spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The longest text block in the spans of events, and where it begins."""
    best, place = "", 0
    for start, stop in spans:
        now, at = [], start
        for i in range(start, stop + 1):
            text = events[i] if i < stop else None
            if text is not None:
                now.append(text)
                continue
            block = SPACE.sub(" ", "".join(now)).strip(" ")
            if len(block) > len(best):
                best, place = block, next(k for k in range(at, i) if SPACE.sub("", events[k] or ""))
            now, at = [], i + 1
    return best, place


def candidates(html: str) -> tuple[int, set[int]]:
    """Hash of the content, and hashes of the subtrees that may be template: not prose, not around the article, not around its longest block."""
    events, elements = read(html)
    mains = sorted(e.start for e in elements if e.main)
    kept = articles(elements)
    if kept:
        block, place = longest(events, sorted({(e.start, e.stop) for e in kept}))
        content = xxhash.xxh64_intdigest(block.encode("utf-8", "surrogatepass")) >> 1
        own = {e.digest for e in elements if e.start <= place < e.stop}
    else:
        bodies = [e.digest for e in elements if e.tag == "body"]
        content = xxhash.xxh64_intdigest(repr(bodies or events).encode("utf-8", "surrogatepass")) >> 1
        own = set()
    return content, {e.digest for e in elements
                     if e.tag not in PROSE and not e.main and e.parts and bisect_right(mains, e.stop - 1) == bisect_right(mains, e.start - 1)} - own


def covered(n: int, spans: list[tuple[int, int]]) -> bytearray:
    """1 for each of ``n`` places that lies in a span."""
    steps = [0] * (n + 1)
    for start, stop in spans:
        steps[start] += 1
        steps[stop] -= 1
    return bytearray(depth > 0 for depth in accumulate(steps[:n]))


def extract(html: str | None, template: set[int]) -> str:
    """Text blocks of the article without what lies beside it or in ``template``."""
    events, elements = read(html or "")
    n = len(events)
    gone = covered(n, [(e.start, e.stop) for e in elements if e.beside or (e.digest in template and e.tag not in PROSE and not e.main)])
    kept = [e for e in articles(elements) if not (e.start < e.stop and gone[e.start])]
    shown = covered(n, [(e.start, e.stop) for e in kept] if kept else [(0, n)])
    blocks, now = [], []
    for i, text in enumerate([*events, None]):
        if text is None or i >= n:
            block = SPACE.sub(" ", "".join(now)).strip(" ")
            if block:
                blocks.append(block)
            now = []
        elif shown[i] and not gone[i]:
            now.append(text)
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, host, html) -> (rid, host, content, subtree), once a page, and a row without subtree for each page."""
    for batch in batches:
        places, contents, subtrees = [], [], []
        for i, html in enumerate(batch.column(2).to_pylist()):
            content, found = candidates(html or "")
            for s in (None, *found):
                places.append(i)
                contents.append(content)
                subtrees.append(s)
        at = pa.array(places, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(contents, pa.int64()), pa.array(subtrees, pa.int64())], names=["rid", "host", "content", "subtree"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, html, template) -> (row, text)."""
    for batch in batches:
        texts = [extract(h, set(t or ())) for h, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def main_text(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html", min_pages: int = 5, min_share: float = 0.005,
              broadcast_rows: int = 200_000) -> DataFrame:
    """One row per page: the columns ``keep``, and ``text``.

    A subtree is template on a host where it occurs with at least ``min_pages``
    contents and ``min_share`` of all; pages of one content count once.
    """
    held = steady(pages).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.monotonically_increasing_id().alias("rid"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    seen = written(held.select("rid", "host", "html").mapInArrow(_candidates, "rid long, host string, content long, subtree long"))
    counts = seen.select("host", "subtree", "content").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.where("subtree IS NULL").select("host", F.col("n").alias("n_host"))
    often = counts.where("subtree IS NOT NULL").where(F.col("n") >= min_pages)
    often = often.join(sizes, "host").where(F.col("n") >= min_share * F.col("n_host")).select("host", "subtree")
    template = written(seen.join(often, ["host", "subtree"]).groupBy("rid").agg(F.collect_list("subtree").alias("template")))
    side = F.broadcast(template) if template.count() <= broadcast_rows else template.hint("merge")
    end = StructType([held.schema["row"], *StructType.fromDDL("text string").fields])
    return held.join(side, "rid", "left").select("row", "html", "template").mapInArrow(_extract, end).select("row.*", "text")

"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block of text. What markup itself tells apart from the
article (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts) leaves a
blank line, and where a page marks its article the lines outside are blank too. The length of
text in a sliding window over the lines then shows where text surges and where it dives to
nothing; the lines between are kept whole. Where an article is marked any text is a surge,
elsewhere it takes a share of the densest window, so that stray lines stay out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, slices

#: Lines in a window, the text length that always is a surge, and the share of the densest window that is.
WINDOW, SURGE, SHARE = 3, 90, 0.5

# Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe svg math object canvas select xmp noembed noframes head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("nav footer aside form menu dialog button".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation "
    "menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar cookie cookies consent gdpr notice notices popup popups "
    "modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies reply related recommended "
    "recommendations share sharing social widget widgets pagination pager toolbar copyright disclaimer legal alert paywall".split()
)
NEUTRAL = frozenset("has with without no content main article layout".split())
# Elements whose end tag may be missing, and what ends them.
ENDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))|([^\s\"'<>/=]+)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _set_apart(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds something other than the article."""
    if name in OUTSIDE or (name == "header" and not inside):
        return True
    if not attributes.strip() or name in ("html", "body", "main"):
        return False
    given = _attributes(attributes)
    if given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true":
        return True
    words = {w.lower() for w in _NAME.findall(f"{given.get('class', '')} {given.get('id', '')}")}
    return bool(words & MARKS) and not words & NEUTRAL


def lines_of(page: str) -> tuple[list[tuple[str, int]], bool]:
    """``(text, weight)`` per line in page order, and whether the page marks its article.

    The weight is the text's length, zero for what is set apart or outside a marked article; text
    inside links has no weight where no article is marked.
    """
    lines: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, set apart, article
    apart = inside = linked = 0
    text: list[str] = []
    links = 0
    marked = False

    def flush() -> None:
        nonlocal links
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                lines.append((line, bool(apart), bool(inside), links))
        links = 0

    def drop(depth: int) -> None:
        nonlocal apart, inside, linked
        while len(stack) > depth:
            name, was_apart, was_article = stack.pop()
            apart -= was_apart
            inside -= was_article
            linked -= name == "a"

    def put(raw: str) -> None:
        nonlocal links
        if raw:
            plain = entities.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if linked:
                links += len(plain.strip())

    at, end = 0, len(page)
    while at < end:
        found = _MARKUP.search(page, at)
        if not found:
            put(page[at:])
            break
        put(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                put(found[0][9:].removesuffix("]]>"))
            continue
        closing = found[1] or found[4]
        if closing:
            if name in BLOCK:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                drop(depth)
            continue
        attributes = found[3] or found[6] or ""
        if name in RAW:
            if name == "head":
                close = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                if close:
                    at = close.start() if close[0][1] != "/" else close.end()
                continue
            if attributes.rstrip().endswith("/"):
                continue
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end if name in ("script", "style", "title", "textarea") else at
            text.append(" ")
            continue
        if name == "br":
            text.append("\n")
        if name in BLOCK:
            flush()
            # a block ends an open paragraph, an item the item before it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    drop(i)
                    break
                if stack[i][0] in BLOCK:
                    break
            if name in ENDS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ENDS[name]:
                        break
                    if stack[i][0] == name or name in ("dt", "dd") and stack[i][0] in ("dt", "dd") or name in ("td", "th") and stack[i][0] in ("td", "th"):
                        drop(i)
                        break
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        away = _set_apart(name, attributes, inside > 0)
        article = False
        if name in ("article", "main") or 'role="main"' in attributes:
            article = not away and not apart
            for i, (other, was_apart, was_article) in enumerate(stack):
                if other == "form" and was_apart and not away:  # a form around the whole page
                    stack[i] = (other, False, was_article)
                    apart -= 1
                    article = not apart
            marked = marked or article
        stack.append((name, away, article))
        apart += away
        inside += article
        linked += name == "a"
    flush()
    out = []
    for line, was_apart, was_inside, in_links in lines:
        if was_apart or (marked and not was_inside):
            weight = 0
        else:
            weight = len(line) if marked else max(0, len(line) - in_links)
        out.append((line, weight))
    return out, marked


def between(weights: list[int], marked: bool) -> list[bool]:
    """Which lines lie between a surge of text and the next dive."""
    n = len(weights)
    padded = [*weights, *[0] * WINDOW]
    sums, total = [], sum(padded[:WINDOW])
    for i in range(n):
        sums.append(total)
        total += padded[i + WINDOW] - padded[i]
    floor = 0 if marked else min(SURGE, int(SHARE * max(sums, default=0)) - 1)
    kept, i = [False] * n, 0
    while i < n:
        if sums[i] > floor and weights[i]:
            stop = i
            while stop < n and sums[stop] > 0:
                stop += 1
            kept[i:stop] = [True] * (stop - i)
            i = stop
        i += 1
    return kept


def main_text(page: str | None) -> str:
    """The article's blocks, one per line; empty if the page has none."""
    lines, marked = lines_of(page or "")
    weights = [w for _, w in lines]
    return "\n".join(line for (line, weight), kept in zip(lines, between(weights, marked)) if kept and weight)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row, from the whole html (null: empty).

    Repeated rows, null ids and urls and columns of any name are fine; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(p) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(field(page_id).cast("long").alias("page_id"), field(url).cast("string").alias("url"), F.coalesce(field(html).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

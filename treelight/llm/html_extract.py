"""Main text of web pages by line-block distribution.

1. Strip markup: elements that never hold main text (scripts, styles, navigation, headers, footers, sidebars, forms, and
   whatever a class, id or role names as a menu, notice, advert, comments and the like) become gaps of empty lines; block
   elements end lines; inline elements vanish; character references are decoded. A name counts by its whole words
   ("site-footer", but not "has-sidebar"), not beside one that names content ("entry-content share"), not on what holds the first
   article or main element, and not on headings and paragraphs inside one.
2. Distribution: a line's weight is its length without link text. Sums over WINDOW lines are taken at every line.
3. Surge and dive: a stretch begins where the sum rises from nothing and ends where it dives to nothing again; it's main text
   if somewhere inside it the sum reaches SURGE characters, and its lines are kept whole, links too. On pages without a marked part,
   shorter stretches between such ones, and the nearest on either side, are kept as well; all of them if none reaches it.
   This decides on every page. A marked part (<article> or <main>) raises its lines' weights: characters outside links weigh
   MARKED times as much there, those of links once; its edges are dives. Lines outside it surge by their own weight.

A page is read once from left to right; memory is in proportion to the page. There's no shuffle.

Defined results: a null page counts as empty and has the empty text; unclosed elements count as open to the next tag only, so a
truncated page keeps its text; in a line, white space becomes one space and is trimmed; lines are joined by one space; a very
long page is read whole; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelight.llm.common import text_of

WINDOW = 3
SURGE = 80
#: How much more a character weighs in an article or a main element.
MARKED = 40

#: Elements that hold no main text, those without an end tag, those that end a line.
DROPPED = set("script style noscript template svg head title nav footer aside form button select textarea iframe object canvas dialog menu audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
BLOCKS = set("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words of class, id and role that name other parts than main text, alone or first or last among words joined by "-" and "_".
NAMED = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert "
    "sidebar sidebars aside widget widgets menu menus navbar nav navigation navi breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments respond disqus "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay paywall pagination pager skip search complementary contentinfo dialog".split()
)

#: First words that only say that a page has or lacks such a part; last words that name main text.
ABOUT = set("has have with without no not is hide hides show shows".split())
CONTENT = set("content contents article entry post story body text main maincontent prose".split())
KEPT_BY_NAME = set("p h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _tokens(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of every tag; comments and declarations have no name; raw elements are one tag with a closing one."""
    out, at = [], 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        out.append((m.start(), at, name, bool(m[1]), m[3] or ""))
        if name in _RAW_END and not m[1] and (end := _RAW_END[name].search(page, at)):
            out.append((end.start(), end.end(), name, True, ""))
            at = end.end()
    return out


def _named_other(attributes: str) -> bool:
    """Whether a class, id or role names another part than main text, and none names main text."""
    other = False
    for value in _NAMES.findall(attributes):
        for word in value.strip("\"'").split():
            parts = [p.lower() for p in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", word))]
            if not parts or parts[0] in ABOUT:
                continue
            if parts[0] in NAMED or parts[-1] in NAMED:
                other = True
            elif parts[-1] in CONTENT:
                return False
    return other


def _is_hidden(attributes: str) -> bool:
    lowered = attributes.lower()
    return ("hidden" in lowered or "display" in lowered) and bool(_HIDDEN.search(attributes))


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, characters outside links, zone) of each line; zone: 2 in an article, 1 in a main element, 0 elsewhere. Gaps are empty lines."""
    tags = _tokens(page)
    closing: dict[int, int] = {}  # index of an opening tag: index of the tag that closes it
    opened: dict[str, list[int]] = {}
    for i, (_, _, name, closes, _) in enumerate(tags):
        if not name or name in VOID:
            continue
        if not closes:
            opened.setdefault(name, []).append(i)
        elif opened.get(name):
            closing[opened[name].pop()] = i
    marked = next((i for i, t in enumerate(tags) if t[2] in ("article", "main") and not t[3]), -1)  # the first marked part
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    plain: list[str] = []
    articles = mains = links = 0

    def end_line(gap: bool = False) -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            zone = 2 if articles else 1 if mains else 0
            lines.append((text, len(" ".join(html.unescape("".join(plain)).split())), zone))
        if gap:
            lines.extend([("", 0, 0)] * WINDOW)
        parts.clear()
        plain.clear()

    def add(text: str) -> None:
        parts.append(text)
        if not links:
            plain.append(text)

    at, i = 0, 0
    while i < len(tags):
        start, end, name, closes, attributes = tags[i]
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            if page.startswith("<![CDATA[", start):
                add(html.escape(page[start + 9 : end].removesuffix("]]>")))
        elif closes:
            if name in BLOCKS:
                end_line()
            if name == "a":
                links = max(0, links - 1)
            elif name == "article":
                articles = max(0, articles - 1)
            elif name == "main":
                mains = max(0, mains - 1)
        else:
            inside = articles + mains > 0
            other = name in DROPPED or name == "header" and not articles
            if not other and attributes:
                by_name = name not in ("html", "body", "main") and not (inside and name in KEPT_BY_NAME) and not (name == "article" and not inside)
                holds = i < marked < closing.get(i, -1)
                other = _is_hidden(attributes) or by_name and not holds and _named_other(attributes)
            if other and name not in VOID:
                end_line(gap=True)
                if i in closing:
                    i = closing[i]
                    at = tags[i][1]
                elif name in RAW:
                    at = len(page)
                    break
            else:
                if name in BLOCKS:
                    end_line()
                if name == "a" and i in closing:
                    links += 1
                elif name == "article":
                    articles += 1
                elif name == "main":
                    mains += 1
        i += 1
    if at < len(page):
        add(page[at:])
    end_line()
    return lines


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first, last, highest window sum) of the lines between each surge from nothing and the next dive to nothing."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    out, i = [], 0
    while i < len(weights):
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < len(weights) and sums[j]:
            j += 1
        first = next(k for k in range(i, len(weights)) if weights[k])
        out.append((first, j - 1, max(sums[i:j])))
        i = j
    return out


def main_text(page: str, surge: int = SURGE) -> str:
    lines: list[str] = []
    weights: list[int] = []
    inside, zones = False, []
    for text, plain, zone in lines_of(page):
        zones.append(zone > 0)
        if text and inside != (zone > 0):
            lines.extend([""] * WINDOW)
            weights.extend([0] * WINDOW)
            inside = zone > 0
        lines.append(text)
        weights.append(MARKED * plain + len(text) - plain if zone else plain)
    found = stretches(weights)
    high = [i for i, x in enumerate(found) if x[2] >= surge]
    if not high:
        chosen = found
    elif any(zones):
        chosen = [found[i] for i in high]
    else:
        chosen = found[max(0, high[0] - 1) : high[-1] + 2]
    return " ".join(text for a, b, _ in chosen for text in lines[a : b + 1] if text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")

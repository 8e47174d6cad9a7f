"""HTML extraction by line-block distribution.

Markup is stripped so that every block element becomes a line. The text lengths
of the lines are summed over sliding windows of lines; where a window's sum
surges above the threshold a run of main text begins, where it falls to zero
(the dive) the run ends, and the lines between are kept. Lines of containers
that never hold main text (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) weigh nothing, and so do lines made of
links only. Attributes are read as whole names with whole values; a container is
dropped by its class or id where that is a noise word, outside articles also where
it joins noise and layout words (``cookie-notice``, ``ad-slot``).

The sums decide on every page, with a threshold that follows the page's own peak.
Lines of an ``<article>`` or ``<main>`` weigh double, and a run does not cross its
edges. An article is kept whole; where a page has several, those far below the
lines outside (teaser cards beside a story in ``<div>``s) are left out. An article
in a container that is dropped, or that is itself marked as a comment or an advert,
is dropped; a container that is never closed does not swallow an article.

Edge cases: a null or empty page gives an empty text; broken or unclosed markup
is read to its end; an unknown tag is removed and its text kept; repeated rows
give repeated rows; extra columns are ignored. Nothing is capped.
"""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
SURGE_CHARS = 86
PEAK_SHARE = 0.25
ARTICLE_WEIGHT = 2

# Elements by their part in a page.
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noframes", "noembed")  # read as text to their end tag, or to the end of the page
UNSEEN = ("noscript", "template", "svg", "math", "select", "object")  # elements whose content is no text of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside form button label dialog menu fieldset audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert "
    "gdpr sidebar side-bar comment comments respond replies reply disqus footer header masthead nav navbar navigation menu breadcrumb breadcrumbs "
    "share sharing social related recommended newsletter subscribe subscription signup popup modal overlay widget widgets toolbar pagination pager "
    "skip skip-link login search".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
SPLIT_NAMES = frozenset("ad ads advert sponsor sponsored promo cookie consent comment comments sidebar footer nav navbar menu breadcrumb breadcrumbs social share newsletter disqus".split())
COMMENT_NAMES = frozenset("comment comments respond replies disqus".split())
#: Words that say where or how a container stands: a name that begins or ends with one of SPLIT_NAMES and is made of these and noise words only is noise.
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box button buttons center col column container content div form group holder icon icons id inner item items left link links "
    "list main message outer overlay panel placeholder policy primary right row secondary section slot space text thread title top unit wrap wrapper zone".split()
)

_REST = r"(?:(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*>)"
_HIDING = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>" + "|".join(RAW + UNSEEN) + r")(?=[\s/>])" + _REST, re.S | re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I) for name in RAW}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
#: One attribute: its whole name, and its value in double, single or no quotes.
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)))?")


def without_unseen(page: str, instead: str) -> str:
    """The page with ``instead`` for every comment and every element that shows no text.

    Elements end at their own end tag, nested ones of a name included. One without an end tag loses its tag only,
    except those read as raw text: they run to the end of the page, as in HTML. ``<svg/>`` and ``<math/>`` are empty,
    and inside these two every element that ends in ``/>``.
    """
    spans: list[tuple[int, int]] = []
    opened: dict[str, list[int]] = {name: [] for name in UNSEEN}
    at = 0
    while m := _HIDING.search(page, at):
        start, at = m.span()
        name = (m["name"] or "").lower()
        foreign = bool(opened["svg"] or opened["math"])
        if not name:
            spans.append((start, at))
        elif m["end"]:
            if opened.get(name):
                first = opened[name].pop()
                for others in opened.values():  # what was opened inside and never closed ends here
                    while others and others[-1] > first:
                        others.pop()
                spans.append((first, at))
        elif page[at - 2] == "/" and (foreign or name in ("svg", "math")):
            spans.append((start, at))
        elif name in RAW:
            at = _RAW_END[name].search(page, at).end()
            spans.append((start, at))
        else:
            opened[name].append(start)
    spans.sort()
    out, at = [], 0
    for start, end in spans:
        if end <= at:  # inside the one before
            continue
        out += (page[at:start], instead)
        at = end
    return "".join(out) + page[at:]


def _layout_noise(name: str) -> bool:
    parts = [x for x in name.split("-") if x and not x.isdigit()]
    return bool(parts) and (parts[0] in SPLIT_NAMES or parts[-1] in SPLIT_NAMES) and all(x in NOISE_NAMES or x in LAYOUT_WORDS for x in parts)


def _is_noise(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is no main text by its attributes; ``inside`` an article only whole names count."""
    seen = set()
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in seen:  # the first of a name holds
            continue
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value.strip() == "true":
            return True
        if key == "role" and value.strip() in NOISE_ROLES:
            return True
        if key == "id" and tag in HEADINGS:  # an anchor made of the heading's words
            continue
        if key in ("class", "id"):
            names = COMMENT_NAMES if key == "id" and inside and tag == "section" else NOISE_NAMES
            for name in value.replace("_", "-").split():
                if name in names or not inside and _layout_noise(name):
                    return True
    return False


class _Lines:
    """Lines of a page. A line in a dropped container keeps its place with no text; ``region`` numbers the articles, 0 is outside."""

    def __init__(self):
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.region: list[int] = []
        self.parts: list[str] = []
        self.link_chars = 0

    def add(self, text: str, in_link: bool) -> None:
        self.parts.append(text)
        if in_link:
            self.link_chars += len(text.strip())

    def end(self, region: int) -> None:
        if self.parts:
            text = " ".join(_html.unescape("".join(self.parts)).split())
            if text:
                self.texts.append(text)
                self.linked.append(self.link_chars)
                self.region.append(region)
            self.parts, self.link_chars = [], 0

    def gap(self, region: int) -> None:
        self.texts.append("")
        self.linked.append(0)
        self.region.append(region)


def _closed(tags: list[re.Match]) -> set[int]:
    """Places of the start tags whose elements an end tag closes."""
    opened: dict[str, list[int]] = {}
    closed = set()
    for i, m in enumerate(tags):
        name = (m["name"] or m["name2"] or "").lower()
        if not (m["end"] or m["end2"]):
            opened.setdefault(name, []).append(i)
        elif opened.get(name):
            closed.add(opened[name].pop())
    return closed


def _lines(page: str) -> _Lines:
    out, stack, at = _Lines(), [], 0
    articles = dropped = links = 0
    regions = 0
    tags = list(_TAG.finditer(page))
    closed = _closed(tags)

    def region() -> int:
        return regions if articles else 0

    def close(name: str) -> None:
        nonlocal articles, dropped, links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                for x, kind in stack[k:]:
                    articles -= kind == "article"
                    dropped -= kind in ("drop", "unclosed")
                    links -= kind == "link"
                del stack[k:]
                return

    for i, m in enumerate(tags):
        if m.start() > at and not dropped:
            out.add(page[at : m.start()], links > 0)
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        end, attrs = m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if name in BLOCKS and not dropped:
            out.end(region())
        if end:
            was = dropped
            if any(x == name for x, _ in stack):
                close(name)
            if was and not dropped:
                out.gap(region())
            continue
        if name in VOID:
            continue
        if name in ("article", "main") and not _is_noise(name, attrs, name == "main"):
            if dropped and not any(kind == "drop" for _, kind in stack):  # an unclosed menu does not swallow the article
                stack[:] = [(x, kind) for x, kind in stack if kind != "unclosed"]
                dropped = 0
            regions += not (dropped or articles)
            stack.append((name, "" if dropped else "article"))
            articles += not dropped
        elif name == "body" or name == "html":
            close("head")
        elif name in DROPPED or attrs and _is_noise(name, attrs, articles > 0):
            if not dropped:
                out.end(region())
            heading = articles and name == "header" and not _is_noise(name, attrs, True)
            stack.append((name, "heading" if heading else "drop" if i in closed else "unclosed"))
            dropped += not heading
        elif name == "a":
            stack.append((name, "link"))
            links += 1
        elif name in ("p", "li") and stack and stack[-1][0] == name:
            pass  # an unclosed paragraph ends where the next begins
        else:
            stack.append((name, ""))
    if at < len(page) and not dropped:
        out.add(page[at:], links > 0)
    out.end(region())
    return out


def extract(page: str | None) -> str:
    """Main text of one page; blocks are joined by one space."""
    if not page:
        return ""
    lines = _lines(without_unseen(page, "<!---->"))
    weight = [
        ARTICLE_WEIGHT * len(t) if region else len(t) - linked if linked < 0.8 * len(t) else 0
        for t, linked, region in zip(lines.texts, lines.linked, lines.region)
    ]
    n = len(weight)
    edges = [i for i in range(n) if not i or lines.region[i] != lines.region[i - 1]]
    stretches = list(zip(edges, [*edges[1:], n]))
    sums = [sum(weight[i : min(i + WINDOW, end)]) for start, end in stretches for i in range(start, end)]
    threshold = min(SURGE_CHARS, PEAK_SHARE * max(sums, default=0))
    outside = max((x for x, region in zip(sums, lines.region) if not region), default=0)
    several = sum(lines.region[start] > 0 for start, _ in stretches) > 1
    kept: list[str] = []
    for i, end in stretches:
        if lines.region[i]:
            if not several or max(sums[i:end]) > PEAK_SHARE * outside:
                kept.extend(t for t in lines.texts[i:end] if t)
            continue
        while i < end:
            if not (weight[i] and sums[i] > threshold):  # no surge yet
                i += 1
                continue
            dive = i
            while dive < end and sums[dive] > 0:
                dive += 1
            kept.extend(lines.texts[k] for k in range(i, dive) if weight[k])
            i = dive
    return " ".join(kept)


@F.pandas_udf(T.StringType())
def _extracted(pages: pd.Series) -> pd.Series:
    return pages.map(extract, na_action=None)


def extracted(page: Column) -> Column:
    return _extracted(F.coalesce(page, F.lit("")))


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text, n_chars (code points). One row per input row; no shuffle."""
    out = pages.select(*keep, extracted(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))

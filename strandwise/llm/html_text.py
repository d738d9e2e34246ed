"""Main text of web pages by line-block distribution: markup becomes lines, sliding sums of their lengths show where text surges and dives."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import ship

WINDOW = 3
SURGE = 86
#: The most that a menu entry weighs, and how many times a line in an article element counts.
ENTRY = 12
BOOST = 4

# Elements of HTML by what they mean here, and names that pages give to what is no article.
_RAW = "script|style|title|textarea|noscript|template|iframe|svg|object|canvas|audio|video|select|datalist|math"
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav footer aside form dialog menu button fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended widget pagination pager toolbar search login signup".split())
_FIRST = frozenset("ad ads advert comment comments cookie sidebar nav menu footer breadcrumb promo sponsored newsletter social share related popup modal".split())

_QUOTED = r"(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/<>]*)({_QUOTED})>|<(/?)([a-z][^\s/<>]*)([^<>]*)>|<[!?/][^<>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-z_:][-a-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _set_aside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds no part of an article: by its name, role, class or id, or because it is hidden."""
    if tag in _ASIDE or (tag == "header" and not in_article):
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return bool(tag == "article" and "comment" in attributes.lower())
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if word in _NAMES or parts[0] in _FIRST or (len(parts) > 1 and parts[-1] in _FIRST and parts[0] not in ("has", "with", "no", "without")):
                    return True
    return False


def lines(page: str) -> list[tuple[str, int, str]]:
    """(text, characters outside links, cue) for each block of the page, in order. The cue says what the markup hints at: ``aside`` (an element set aside is one line), ``article`` (in an article or main element) or ``open``."""
    tokens = list(_TOKEN.finditer(page))
    last_close: dict[str, int] = {}
    for t in tokens:
        if t[2] or t[5]:
            last_close[(t[3] or t[6]).lower()] = t.start()
    out: list[tuple[str, int, str]] = []
    parts: list[str] = []
    plain = 0
    dropped, depth, links = "", 0, 0
    article = main = 0
    end = 0

    def close() -> None:
        nonlocal parts, plain
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, min(plain, len(text)), "aside" if dropped else "article" if article or main else "open"))
        parts, plain = [], 0

    for t in [*tokens, None]:
        text = page[end : t.start() if t else len(page)]
        if text:
            parts.append(text)
            if not links:
                plain += len(text.strip())
        if t is None:
            break
        end = t.end()
        tag = (t[3] or t[6] or "").lower()
        if not tag:
            if t[1]:
                parts.append(" ")
            continue
        shut = bool(t[2] or t[5])
        if tag == "br":
            parts.append(" ")
            continue
        if dropped:
            if tag == dropped:
                depth += -1 if shut else 1
                if not depth:
                    close()
                    dropped = ""
            elif tag not in _INLINE:
                parts.append(" ")
            continue
        if not shut and tag not in _VOID and last_close.get(tag, -1) > end - 1 and _set_aside(tag, t[4] or t[7] or "", article > 0):
            close()
            dropped, depth = tag, 1
            continue
        if tag == "a":
            links = 0 if shut else 1
        if tag in _INLINE:
            continue
        close()
        links = 0
        if tag == "article":
            article = max(0, article + (-1 if shut else 1))
        elif tag == "main":
            main = max(0, main + (-1 if shut else 1))
    close()
    return out


def weigh(found: list[tuple[str, int, str]]) -> list[int]:
    """The weight of each line: its characters outside links; none if links take most of it. Cues only shift it: a line in an article counts ``BOOST`` times and an
    entry more (links too are an entry there), one set aside never counts more than an entry."""
    out = []
    for text, plain, cue in found:
        size = plain if 2 * plain >= len(text) else 0
        out.append(min(size, ENTRY) if cue == "aside" else ENTRY + BOOST * size if cue == "article" else size)
    return out


def main_text(page: str | None) -> str:
    r"""The article of a page: its blocks joined by ``\n\n``; none: empty.

    Each block is a line, and the weights of ``WINDOW`` lines are summed at every line of the page. Text surges at a line some window of which reaches the threshold (higher
    on pages with article elements; or the largest sum of a line that may be text, if smaller). It dives, to either side, where a whole window of lines weighs no more than an entry each: menus, lists of
    links, elements set aside; short lines of words next to the text belong to it. Between the dives around a surge every line is kept but those outside the articles, if there are any, that weigh little against the
    threshold, and links at either end where no article element holds them.
    """
    found = lines(page or "")
    weights = weigh(found)
    marked = any(cue == "article" for _, _, cue in found)
    best = [cue == ("article" if marked else "open") for _, _, cue in found]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    peaks = [max(sums[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(sums))]
    surge = min(SURGE * (BOOST if marked else 1), max((p for p, b, w in zip(peaks, best, weights, strict=True) if b and w), default=0))
    text = [b or (w > ENTRY and w * WINDOW >= surge) for b, w in zip(best, weights, strict=True)]
    words = [b and 2 * plain >= len(t) for b, (t, plain, _) in zip(best, found, strict=True)]
    kept: list[str] = []
    done = 0
    for a, b in _between_dives([t and w > ENTRY for t, w in zip(text, weights, strict=True)]):
        if not any(text[i] and weights[i] and peaks[i] >= surge for i in range(a, b)):
            continue
        while a > done and words[a - 1]:
            a -= 1
        while b < len(found) and words[b]:
            b += 1
        ends = [i for i in range(max(a, done), b) if text[i] and (marked or weights[i])]
        if ends:
            kept += [found[i][0] for i in range(ends[0], ends[-1] + 1) if text[i]]
        done = b
    return "\n\n".join(kept)


def _between_dives(strong: list[bool]) -> list[tuple[int, int]]:
    """Ranges of lines between runs of ``WINDOW`` or more lines that are not strong; a page of none is one range, shorter runs at its ends belong to it."""
    out, start, at, n = [], 0, 0, len(strong)
    while at < n:
        run = at
        while run < n and not strong[run]:
            run += 1
        if run - at >= WINDOW and run - at < n:
            if at > start:
                out.append((start, at))
            start = run
        at = run + 1
    if start < n:
        out.append((start, n))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``; null and empty pages have empty text. Unclosed tags, comments and scripts end at the page's end or are
    passed over. Repeated rows stay; other columns are not read. No shuffle."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")

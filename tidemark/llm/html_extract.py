"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels each block by the part of the page it stands in (names that
only may mean furniture raise what a block must show) and by length, link density and stop-word density: content, boilerplate, or undecided (short ones, and middling ones). In the second
pass an undecided block takes the label of its nearest decided neighbours (content, if they are equally near and it has no
link), so a one-word paragraph inside an article stays and one inside a menu goes. Headings go with the content that follows them. An article or main narrows both passes to itself if
it holds most of the text that they call good.

Cases: null or empty html gives an empty text; markup without text gives an empty text; unclosed and crossing tags, comments
and scripts are tolerated; whole pages are read, never a prefix; repeated rows give repeated results; other columns are
ignored by the query; an empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Elements of HTML by their role here.
RAW = "script style noscript template svg iframe canvas audio video textarea select title".split()
BLOCKS = set("p div section article main header footer aside nav form ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption pre blockquote figure figcaption address fieldset details summary hr body html head dialog center".split())
CONTAINERS = set("div section article main header footer aside nav form ul ol dl table blockquote figure fieldset details dialog body".split())
VOID = set("img input link meta wbr source track embed param area base col".split())
NOT_TEXT = set("nav footer aside form head dialog button fieldset menu".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing "
    "social related recommended comment comments commentlist disqus respond replies discussion widget widgets skip login search pagination pager header".split()
)
#: Names that say little in a longer name (share-price, related-work, content-header): there they only raise what a block must show.
WEAK_NAMES = set("share sharing social related recommended header banner notice notices widget widgets search login discussion overlay popup modal skip replies respond toolbar pager".split())
STOP_WORDS = set(
    "the of and to in is that it for was with as be on this are by from or an at not have has you he she they we his her "
    "le la les de des du et un une que qui pour dans est par sur pas au avec il elle "
    "der die das und ist nicht ein eine den von zu mit sich auf für als dem es er sie wir "
    "el los las y en por con para no se su del al lo como más".split()
)
SHORT, LONG = 70, 200
LINKS_HIGH, LINKS_MOST, STOPS_HIGH, STOPS_LOW = 0.33, 0.75, 0.25, 0.08

_raw = re.compile(r"<!--|<!\[CDATA\[|<(" + "|".join(RAW) + r")\b", re.I)
_ends = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_tag = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>")
_attribute = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_word = re.compile(r"[^\W\d_]+")


def _without_raw(page: str) -> str:
    """The page without comments, CDATA and elements whose content is no text, each found from where the last one ended; what is
    not closed reaches to the end, and an element without a closing bracket is left as it stands."""
    parts, at, missing = [], 0, set()
    look = 0
    while m := _raw.search(page, look):
        tag = (m[1] or "").lower()
        if tag:
            close = page.find(">", m.end()) if ">" not in missing else -1
            if close < 0:
                missing.add(">")
                look = m.end()
                continue
            end = close + 1
            if page[close - 1] != "/":
                stop = None if tag in missing else _ends[tag].search(page, end)
                if stop is None:
                    missing.add(tag)
                end = stop.end() if stop else len(page)
        else:
            mark = "-->" if page[m.start() + 2] == "-" else "]]>"
            stop = page.find(mark, m.end())
            end = stop + 3 if stop >= 0 else len(page)
        parts += [page[at : m.start()], " "]
        at = look = end
    return "".join(parts) + page[at:]


def _named_boiler(attributes: str) -> int:
    """2: class, id, role or hidden mark an element as furniture; 1: they may; 0: they do not."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return 0
    found = 0
    for m in _attribute.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return 2
        if key in ("class", "id"):
            for name in value.split():
                parts = re.split(r"[-_]+", name)
                if name in BOILER_NAMES or all(p in BOILER_NAMES for p in parts):
                    return 2
                told = [p for p in (parts[0], parts[-1]) if p in BOILER_NAMES]
                if told and not (parts[-1] in told and parts[0] in ("has", "with", "no", "without")):
                    if any(p not in WEAK_NAMES for p in told):
                        return 2
                    found = 1
    return found


class _Block:
    __slots__ = ("boiler", "heading", "inside", "label", "linked", "suspect", "text")

    def __init__(self, text: str, linked: int, inside: bool, boiler: bool, heading: bool, suspect: bool) -> None:
        self.text, self.linked, self.inside, self.boiler, self.heading, self.suspect, self.label = text, linked, inside, boiler, heading, suspect, ""


def blocks_of(page: str) -> list[_Block]:
    """The blocks of a page that have text, in order."""
    page = _without_raw(page)
    blocks: list[_Block] = []
    stack: list[tuple[str, int, bool]] = []  # open containers: tag, furniture (2 sure, 1 perhaps), an article or main
    count: Counter = Counter()  # of the stack: its tags, "sure", "perhaps", "header" among the sure ones, "article"
    texts: list[str] = []
    linked, in_link, heading, at = 0, False, False, 0
    mark = 0  # of a block that is no container, like a paragraph
    hidden: tuple[str, int] | None = None  # an inline element marked as furniture, and how many of its kind are open in it

    def close() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                inside = count["article"] > 0
                # A heading in the header of an article belongs to the article.
                kept = heading and inside and count["sure"] == count["sure header"] == 1
                sure = mark == 2 or count["sure"] > 0 and not kept
                blocks.append(_Block(text, linked, inside, sure, heading, mark == 1 or count["perhaps"] > 0))
            texts.clear()
        linked = 0

    def enter(tag: str, own: int, step: int) -> None:
        count["<" + tag] += step
        if own:
            count["sure" if own == 2 else "perhaps"] += step
            count["sure header"] += step if own == 2 and tag == "header" else 0
        count["article"] += step if tag in ("article", "main") else 0

    for m in _tag.finditer(page):
        if m.start() > at and not hidden:
            piece = htmllib.unescape(page[at : m.start()])
            texts.append(piece)
            linked += len(piece.strip()) if in_link else 0
        at = m.end()
        if not (tag := m[2]):
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in BLOCKS or tag == "button":
            close()
            in_link, hidden = False, None
            heading = tag in HEADINGS and not closing
            mark = 0
            if tag in CONTAINERS or tag in NOT_TEXT:
                if closing:
                    if count["<" + tag]:
                        last = ""
                        while last != tag:
                            last, own, _ = stack.pop()
                            enter(last, own, -1)
                else:
                    own = 2 if tag in NOT_TEXT or tag == "header" else 0 if tag in ("body", "main") else _named_boiler(m[3] or "")
                    stack.append((tag, own, False))
                    enter(tag, own, 1)
            elif not closing:
                mark = _named_boiler(m[3] or "")
        elif hidden and tag == hidden[0]:
            depth = hidden[1] + (-1 if closing else 1)
            hidden = (tag, depth) if depth else None
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            texts.append(" ")
        elif not closing and not hidden and not (m[3] or "").endswith("/") and tag not in VOID and _named_boiler(m[3] or "") == 2:
            hidden = (tag, 1)
    if at < len(page) and not hidden:
        texts.append(htmllib.unescape(page[at:]))
    close()
    return blocks


def label(blocks: list[_Block]) -> None:
    """Both passes; label is 'good' or 'bad' in the end. An article or main is trusted if it holds most of the text they call good."""
    _passes(blocks, False)
    inner = [b for b in blocks if b.inside and not b.boiler]
    good = sum(len(b.text) for b in blocks if b.label == "good")
    if inner and 2 * sum(len(b.text) for b in inner if b.label == "good") >= good:
        for b in blocks:
            b.label = "bad"
        _passes(inner, True)


def _passes(blocks: list[_Block], trusted: bool) -> None:
    """Both passes over blocks; in a trusted part what is undecided is good, unless all its decided neighbours are bad."""
    for b in blocks:
        n = len(b.text)
        links = b.linked > LINKS_HIGH * n and not (trusted and b.heading)
        if b.boiler or links and (n < SHORT or b.linked > LINKS_MOST * n):
            b.label = "bad"
        elif n < SHORT:
            b.label = "bad" if b.suspect or b.linked and not trusted else "short"
        else:
            words = _word.findall(b.text.lower())
            stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            if links:  # a sentence with long links goes with its neighbours, lists of links do not
                b.label = "near" if stops >= STOPS_HIGH and not b.suspect else "bad"
            elif b.suspect:
                b.label = "good" if n > LONG and stops >= STOPS_HIGH else "near"
            else:
                b.label = "good" if stops >= STOPS_HIGH or n > LONG and stops >= STOPS_LOW else "near"
    if not any(b.label == "good" for b in blocks):  # few stop words, as in other languages: the longer blocks without links count
        for b in blocks:
            b.label = "good" if b.label == "near" and not b.linked and not b.suspect else b.label
    before, last = [], None
    for i, b in enumerate(blocks):
        before.append(last)
        last = i if b.label in ("good", "bad") else last
    after, last = [None] * len(blocks), None
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = last
        last = i if blocks[i].label in ("good", "bad") else last
    decided = [b.label for b in blocks]
    for i, b in enumerate(blocks):
        if decided[i] in ("good", "bad"):
            continue
        left = decided[before[i]] if before[i] is not None else None
        right = decided[after[i]] if after[i] is not None else None
        if trusted:
            b.label = "bad" if "bad" in (left, right) and "good" not in (left, right) and decided[i] == "short" else "good"
        elif b.heading and right == "good" or left == right == "good":
            b.label = "good"
        elif left is None and right is None:
            b.label = "good" if decided[i] == "near" or len(blocks) == 1 else "bad"
        elif left is not None and right is not None and left != right:
            near = left if i - before[i] < after[i] - i else right if after[i] - i < i - before[i] else "bad" if b.linked else "good"
            b.label = near
        else:
            b.label = left or right


def main_text(page: str | None) -> str:
    """The main text of one page, a line for each block."""
    if not page:
        return ""
    blocks = blocks_of(page)
    label(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [main_text(x if isinstance(x, str) else None) for x in f["_html"]]
            yield pd.DataFrame({"page_id": f["page_id"].astype("Int64"), "url": f["url"], out: texts, "n_chars": [len(t) for t in texts]})

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html).alias("_html"))
    return chosen.mapInPandas(run, f"page_id long, url string, {out} string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))

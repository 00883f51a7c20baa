"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.stopwords import STOP_WORDS

# Block rules: a block of at least LONG characters is decided by its words alone.
LONG = 70
LINK_DENSITY = 0.5
STOP_DENSITY = 0.15

_STOP = frozenset(w for words in STOP_WORDS.values() for w in words)
# Elements whose text is never part of the page. Scripts and styles run to the end of the page if nothing
# closes them; the others hold what they hold up to their end tag, and nothing if it does not follow.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<code>script|style)(?=[\s/>])[^>]*>.*?(?:</(?P=code)\s*>|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>]*/)?>(?<=/>)"
    r"|<(?P<whole>noscript|template|textarea|select|svg|math|iframe|object|title|canvas|audio|video)(?=[\s/>])[^>]*>"
    r"[^<]*+(?:<(?!/?(?P=whole)[\s/>])[^<]*+)*+</(?P=whole)\s*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")

_VOID = frozenset("br img hr input meta link wbr area base col embed source track param".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_MAIN = frozenset(["article", "main"])
_BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset head".split())
# Names that pages give to parts beside the article.
_BOILERPLATE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup
    sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar
    comment comments commentlist disqus respond reply replies share sharing social related recommended widget login search
    searchform""".split())
# What may stand behind such a name in a class or id without changing what it names.
_PLAIN_NAMES = frozenset(
    """area bar block body bottom box button buttons container content form group header holder icon icons inner item items
    left link links list main module outer panel post posts right row section slot text title top unit wrap wrapper""".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    section: int  # number of the article it is in, 0 outside
    boilerplate: bool  # inside a part that is named or marked as no article text
    heading: bool


def _names(value: str, names: frozenset[str] | set[str]) -> bool:
    """Whether a class or id value has a token that is one of ``names``, ends with one, or only adds plain words to one."""
    for token in value.split():
        parts = [x for x in re.split(r"[^a-z]+", token) if x]
        if parts and (parts[-1] in names or (parts[0] in names and all(x in names or x in _PLAIN_NAMES for x in parts[1:]))):
            return True
    return False


def _marked(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether an element opens a part beside the article."""
    if tag in _BOILERPLATE_TAGS or (tag == "header" and not in_main):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).strip().lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in _BOILERPLATE_ROLES:
            return True
        if name in ("class", "id") and tag not in _MAIN | _HEADINGS and _names(value, _BOILERPLATE_NAMES):
            return True
        if name in ("class", "id") and tag == "article" and _names(value, {"comment", "comments", "ad", "related", "reply"}):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Inline elements and ``<br>`` stay inside a block."""
    out: list[Block] = []
    open_tags: list[tuple[str, int, bool, bool]] = []  # name, section, boilerplate, in an article's header
    parts: list[str] = []
    linked = depth_link = sections = 0
    section, boilerplate, in_header, heading = 0, False, False, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, section, boilerplate or (in_header and not heading), heading))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if depth_link:
            linked += len(text.strip())

    def state() -> tuple[str, int, bool, bool]:
        return open_tags[-1] if open_tags else ("", 0, False, False)

    def end_inline() -> None:
        """A marked inline element ends with the block it is in."""
        nonlocal section, boilerplate, in_header
        if open_tags and open_tags[-1][0] in _INLINE:
            while open_tags and open_tags[-1][0] in _INLINE:
                open_tags.pop()
            _, section, boilerplate, in_header = state()

    at = 0
    for found in _MARKUP.finditer(page):
        add(page[at:found.start()])
        at = found.end()
        tag = found["name"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            if tag == "a":
                depth_link = max(0, depth_link - 1)
            elif tag in _INLINE:
                if open_tags and open_tags[-1][0] == tag:
                    flush()
                    open_tags.pop()
                    _, section, boilerplate, in_header = state()
            else:
                flush()
                end_inline()
                if tag in _HEADINGS:
                    heading = False
                for back in range(len(open_tags) - 1, -1, -1):
                    if open_tags[back][0] == tag:
                        del open_tags[back:]
                        _, section, boilerplate, in_header = state()
                        break
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            depth_link += 1
        elif tag in _INLINE:
            attrs = found["attrs"]
            marked = bool(attrs) and _marked(tag, attrs, section > 0)
            if marked:
                flush()
                boilerplate = True
            if marked or (open_tags and open_tags[-1][0] == tag):
                open_tags.append((tag, section, boilerplate, in_header))
        elif tag == "hr" or tag not in _VOID:
            flush()
            end_inline()
            depth_link = 0
            if tag in _HEADINGS:
                heading = True
            elif tag not in ("p", "li", "td", "th", "tr", "dt", "dd", "option", "hr") or found["attrs"].strip():
                heading = False
                if tag in ("p", "li", "td", "th", "tr", "dt", "dd"):
                    while open_tags and open_tags[-1][0] == tag:  # these close themselves
                        open_tags.pop()
                    _, section, boilerplate, in_header = state()
                marked = _marked(tag, found["attrs"], section > 0)
                if tag in _MAIN and not marked and not boilerplate and not section:
                    sections += 1
                    section = sections
                boilerplate = boilerplate or marked
                in_header = in_header or (tag == "header" and section > 0)
                open_tags.append((tag, section, boilerplate, in_header))
            else:
                heading = False
                if open_tags and open_tags[-1][0] == tag:  # an unclosed marked one before it
                    open_tags.pop()
                    _, section, boilerplate, in_header = state()
    add(page[at:])
    flush()
    return out


def labels(found: list[Block]) -> list[bool]:
    """Which blocks are main text.

    First pass: blocks of marked parts are out for good and have no say; mostly linked blocks are
    bad; long blocks with enough stop words are good; others are undecided. Second pass: an
    undecided block takes the label of the nearest decided block of its section (good when both
    sides are as near); in a section without any, blocks are good inside an article and bad outside,
    unless the page has no decided block at all.
    When the page has an article element with text, text outside it is bad.
    """
    decided: list[bool | None] = []
    with_article = any(b.section and not b.boilerplate for b in found)
    for block in found:
        if block.boilerplate or (with_article and not block.section):
            decided.append(None)
            continue
        if block.linked > LINK_DENSITY * len(block.text):
            decided.append(False)
            continue
        words = _WORD.findall(block.text.lower()) if len(block.text) >= LONG else ()
        stops = sum(w in _STOP for w in words)
        decided.append(True if words and stops >= STOP_DENSITY * len(words) else None)
    out = [bool(d) for d in decided]
    voters: dict[int, list[int]] = {}
    for i, (block, label) in enumerate(zip(found, decided)):
        if label is not None:
            voters.setdefault(block.section, []).append(i)
    for section in {b.section for b in found}:
        have, left = voters.get(section, []), 0
        for i, block in enumerate(found):
            if block.section != section or decided[i] is not None or block.boilerplate or (with_article and not section):
                continue
            while left < len(have) and have[left] < i:
                left += 1
            before = have[left - 1] if left else None
            after = have[left] if left < len(have) else None
            if before is None and after is None:
                out[i] = section > 0 or not voters
            elif before is None or (after is not None and after - i < i - before):
                out[i] = bool(decided[after])
            elif after is None or i - before < after - i:
                out[i] = bool(decided[before])
            else:
                out[i] = bool(decided[before]) or bool(decided[after])
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, labels(found)) if good)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page.

    The main text is the kept blocks in page order, one per line; null and blank pages have an empty
    text. ``n_chars`` counts code points. Repeated rows give repeated rows, an empty table an empty
    table, other columns are ignored. No row needs another: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. What markup names as no part of the text
(navigation, footers, adverts, forms, comments) is out. Pass one classifies every other block by
stop-word density, length and link density: good, bad, near (good but short, or long with fewer
stop words), thin (long with hardly any, or a paragraph of links) or short. Stop words are those of four languages; text of a page in which they are
rare (another language or script) is judged by length and links alone. Pass two gives near and
short blocks the label of their nearest decided neighbours; a thin one is text only between two good ones.

article and main are a prior only: inside them a block that pass one would call bad for its
density is near, and a near or short block without decided neighbours of the same element is good;
outside them, on a page that has them, near and short blocks are bad, and good ones count
only if the element is a teaser, without a good block and shorter than LONG: however long a discussion beside an article is, it
stays out. Notices and adverts are out inside an article too. Names such as banner or share on an element
inside an article take its short and linked blocks only, for a section of the text may bear them too, and not
even these where the article has nothing else.

Defined results: null html counts as empty and gives the empty text; pages cut off in the
middle of a tag, comment or script lose only that; repeated rows give repeated results;
an empty table an empty result; columns other than page_id, url and html are not read. No page is shortened;
time and memory follow its length, whatever its tags are (open elements are counted by name and linked to the next one
that matters, so none is searched for).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, record_batch, table

STOP_WORDS = frozenset(
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which "
    "de la le les et des en un une du dans que qui il au pour pas sur est par avec ce se ne plus son sa ses ou "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "el los las del y por con una su al lo como más pero sus le ya o fue ha".split()
)

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUTSIDE = frozenset(
    "nav footer aside form fieldset head title menu search dialog select option optgroup button textarea label".split()
)
_INLINE_KEPT = frozenset("button label textarea a".split())  # inline elements whose state matters
_ROLE_OUTSIDE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())

_MARK = (
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup "
    "promo promos promoted promotion recommended related reply replies respond search sidebar signup sponsor sponsored "
    "subscribe subscription toolbar"
)
_WEAK = "banner share sharing social widget"
_MARKS = frozenset(_MARK.split())
_WEAK_MARKS = frozenset(_WEAK.split())
_HEADER_MARKS = frozenset(("header", "topbar", "site-header", "page-header"))
_NOT_MARK = frozenset("no has with without body entry post article content main hide not".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|canvas|object|math)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    link: int = 0  # characters inside links
    region: str = ""  # "out", "in", "weak" (in, under a weak mark) or unknown
    tag: str = ""  # the element it stands in, no link, label or button
    text: str = ""
    label: str = ""  # good, bad, near, thin or short
    rule: str = ""  # what decided


def _marked(token: str, marks: frozenset) -> bool:
    if token in marks:
        return True
    parts = re.split(r"[-_]+", token)
    return len(parts) > 1 and (parts[0] in marks or parts[-1] in marks) and not _NOT_MARK.intersection(parts)


def _region(tag: str, attributes: str, around: str) -> str:
    """What an element says of its content, in a part of the page that says ``around``."""
    if around == "out":
        return "out"
    inside = around in ("in", "weak")
    if tag in _OUTSIDE or tag == "header" and not inside:
        return "out"
    region = "in" if tag in ("article", "main") and around != "weak" else around
    if not attributes or tag in ("html", "body"):
        return region
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role":
            if value in _ROLE_OUTSIDE:
                return "out"
            if value in ("main", "article"):
                region = "in"
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return "out"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "out"
        elif name in ("class", "id"):
            for token in value.split():
                if _marked(token, _MARKS) or token in _HEADER_MARKS and not inside:
                    return "out"
                if _marked(token, _WEAK_MARKS):
                    if not inside:
                        return "out"
                    region = "weak"
    return region


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, those without text left out."""
    out: list[Block] = []
    # Open elements: name, region inside, and the places of the next one below (or itself) that is no label
    # or button, and that is no link either.
    stack: list[tuple[str, str, int, int]] = []
    opened: Counter[str] = Counter()
    current = Block()

    def close() -> None:
        nonlocal current
        if current.parts:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                out.append(current)
        current = Block()

    def add(text: str) -> None:
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        if not current.parts and stack:
            solid = stack[-1][3]
            current.tag, current.region = stack[solid][0] if solid >= 0 else "", stack[-1][1]
        current.parts.append(text)
        if opened["a"]:
            current.link += len(text.strip())

    def push(tag: str, region: str) -> None:
        k = len(stack)
        below = stack[-1] if stack else ("", "", -1, -1)
        solid = below[2] if tag in ("label", "button") else k
        stack.append((tag, region, solid, below[3] if tag in ("label", "button", "a") else k))
        opened[tag] += 1

    def pop(at: int) -> None:
        for name, *_ in stack[at:]:
            opened[name] -= 1
        del stack[at:]

    last = 0
    for m in _TOKEN.finditer(page):
        add(page[last : m.start()])
        last = m.end()
        name = m.group(3)
        if not name:
            continue
        tag = name.lower()
        block = tag in _BLOCK
        if m.group(2):
            if block:
                close()
            if opened[tag]:  # found at the latest where the search ends, and all above it goes
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag == "br":
            add(" ")
        if tag in _VOID:
            if block:
                close()
            continue
        if block:
            close()
            if tag not in ("title", "head") and stack:  # what may not hold a block ends here
                at = stack[-1][2 if tag in _ENDS_LINK else 3]
                if at >= 0 and (stack[at][0] in _ENDED or stack[at][0] == tag == "li"):
                    pop(at)
        if block or tag in _INLINE_KEPT:
            around = stack[-1][1] if stack else ""
            push(tag, _region(tag, m.group(4), around))
            if tag in ("button", "label", "textarea"):
                close()
    add(page[last:])
    close()
    return out


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What a block-level start tag ends, and the tags among them that end a link as well.
_ENDED = frozenset(("p", "a", "head", "title", *_HEADINGS))
_ENDS_LINK = frozenset(("article", "main", "p", "body", "footer", "nav"))
#: Elements of running text: a block of links in one may be a sentence, in another it is a list.
_PROSE = frozenset(("p", "blockquote", *_HEADINGS))
LONG, SHORT = 200, 70
DENSE, SPARSE = 0.20, 0.08
LINKED = 0.5
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")


def _length(text: str) -> int:
    """Characters; one of a script whose characters stand for syllables or words counts as three."""
    return len(text) + 2 * len(_WIDE.findall(text))


def _density(text: str) -> tuple[int, int]:
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found), len(found)


def _first_pass(blocks: list[Block]) -> None:
    open_ = [b for b in blocks if b.region != "out"]
    counts = [_density(b.text) for b in open_]
    words = sum(n for _, n in counts)
    known = words == 0 or sum(k for k, _ in counts) >= SPARSE * words
    for b in blocks:
        b.label, b.rule = "bad", "markup"
    for b, (stop, n) in zip(open_, counts):
        size, linked, inside = _length(b.text), b.link / len(b.text), b.region == "in"
        if linked > LINKED:
            b.label, b.rule = ("short" if inside else "thin" if b.tag in _PROSE and b.region != "weak" else "bad"), "links"
        elif size < SHORT:
            b.label, b.rule = ("bad" if b.region == "weak" else "short"), "length"
        elif not known:
            b.label, b.rule = ("good" if size > LONG else "near"), "length"
        elif stop >= DENSE * n and n:
            b.label, b.rule = ("good" if size > LONG else "near"), "density"
        else:
            b.label, b.rule = ("near" if inside or stop >= SPARSE * n and n else "thin"), "density"


def classify(blocks: list[Block]) -> None:
    """Pass one, then pass two for what is ambiguous: longer blocks come first."""
    _first_pass(blocks)
    inside = [b for b in blocks if b.region in ("in", "weak")]
    outside = [b for b in blocks if b.region == ""]
    if inside:
        # The good blocks outside an article are text only where the article is a teaser of them.
        teaser = not any(b.label == "good" for b in inside) and sum(_length(b.text) for b in inside) < LONG
        for b in outside:
            if b.label != "good" or not teaser:
                b.label, b.rule = "bad", "frame"
        if all(b.label == "bad" for b in inside) and not any(b.label == "good" for b in outside):
            for b in inside:  # nothing else is there, so a weak mark says nothing
                b.label = "short" if b.region == "weak" and b.link <= LINKED * len(b.text) else b.label
    for part in (inside, outside):
        for kind in ("near", "thin", "short"):
            decided = [(i, b.label) for i, b in enumerate(part) if b.label in ("good", "bad") and b.region != "weak"]
            _inherit(part, kind, decided)


def _inherit(blocks: list[Block], kind: str, decided: list[tuple[int, str]]) -> None:
    at = 0
    for i, b in enumerate(blocks):
        if b.label != kind:
            continue
        b.rule = "neighbours"
        while at < len(decided) and decided[at][0] < i:
            at += 1
        before = decided[at - 1] if at else None
        after = decided[at] if at < len(decided) else None
        if kind == "thin":
            b.label = "good" if before and after and before[1] == after[1] == "good" else "bad"
        elif not before and not after:
            b.label = "good"
        elif kind == "near":
            b.label = "bad" if before and after and before[1] == after[1] == "bad" else "good"
        elif not before or not after or before[1] == after[1]:
            b.label = (before or after)[1]
        elif b.tag in _HEADINGS and after[1] == "good":
            b.label = "good"
        else:
            nearer = (i - before[0]) - (after[0] - i)
            b.label = before[1] if nearer < 0 else after[1] if nearer > 0 else "bad"


def extract(page: str) -> str:
    blocks = blocks_of(page)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of (page_id, url, html)."""

    def rows(batch):
        texts = [extract(x or "") for x in batch.column(2).to_pylist()]
        return record_batch(SCHEMA, batch.column(0), batch.column(1), texts, [len(t) for t in texts])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_rows(source, rows, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))

"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. First pass, on every page alike:
length, share of stop words, share of linked characters and the tags around a
block each give it points; many make it good, few bad, the rest are ambiguous.
Second pass: ambiguous blocks take the label of the nearest decided neighbours.
A page on which nothing is good by itself is one of short blocks: its runs of
ambiguous blocks are then judged as one text each.

Tags are one of the marks: an article speaks for a block, a footer or a class
name such as "sidebar" against it. A name that is only a part of another counts
against a block where the page has as much good text without such names.
Parsing and both passes are linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodecast.llm.token_counts import balanced

#: Bytes of html a task works on at a time.
BATCH_BYTES = 8 << 20
#: Blocks of fewer characters are short, of at least so many long.
SHORT, LONG = 70, 200
#: Shares of stop words from which a block is doubtful or good, and of linked characters above which it is bad.
DOUBTFUL_STOPS, GOOD_STOPS, MOST_LINKED = 0.12, 0.22, 0.4
#: Points from which a block is good, up to which it is bad, and for standing in a main part or outside.
GOOD, BAD, WITHIN, WITHOUT = 3, -1, 2, -6
#: Pages with a smaller share of stop words than this are in a language without a list; length decides there.
KNOWN_LANGUAGE = 0.04

# Common words of four languages.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it not of on or she that the they this to was we were which will with you "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les mais ne nous on ou par pas plus pour qui que se son sont sur un une vous "
    "aber als am auch auf aus bei das dem den der des die durch ein eine einer er es für hat ich im ist mit nach nicht noch sich sie sind so und von war werden wie wir zu zum zur "
    "al como con de del el en era es esta este fue ha la las lo los más no o para pero por que se si sin su sus también un una y ya".split()
)

# Element names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("head nav footer aside form button select datalist dialog menu search template noscript iframe object svg math canvas audio video map".split())
#: What closes an inline element must not reach beyond the block it lies in.
HOLDERS = ("article", "main", "section", "div", "p", "li", "td")
MAIN = frozenset(["article", "main"])
#: Names in class, id and role values that mark what is not main text, and what is.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager sidebar footer masthead topbar toolbar comment comments disqus reply replies respond share sharing social related "
    "recommended newsletter subscribe subscription signup login popup modal overlay widget widgets tags skip hidden search contentinfo complementary".split()
)
#: First parts of names that say of what follows that it is there or not, and last parts that name a state: layouts, not parts of a page.
MODIFIERS = frozenset("has have no not without with is show hide hidden".split())
STATES = frozenset("enabled disabled open opened closed collapsed expanded visible hidden on off active inactive left right top bottom".split())
MAIN_NAMES = frozenset("articlebody article-body article-content article-text entry-content post-content post-body story-body main-content page-content".split())

_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_TOKEN = re.compile(
    r"(?P<note><!--).*?(?P<noted>-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp)\b[^>]*>.*?(?P<ended></(?P=raw)\s*>|\Z)"
    r"|<(?P<closing>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+(?=>)|[^>]*)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
_ATTR = re.compile(r"\b(class|id|role|itemprop|style|aria-hidden|hidden|type)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[_-]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: float
    main: bool
    outside: bool
    heading: bool
    hinted: bool = False
    stops: float = 0.0
    points: int = 0
    label: str = ""


@dataclass
class _Open:
    """An open element: its name, whether it starts a main part, and what held before it."""

    tag: str
    main: bool
    before: tuple[int, int, int]


@dataclass
class _State:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    #: For each name, the places of its open elements on the stack, so that nothing searches the stack.
    places: defaultdict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    chars: int = 0
    in_link: bool = False
    breaks: int = 0
    main: int = 0
    headings: int = 0
    #: Open outside parts: by elements or attributes, and by names alone. A main part ends the latter.
    firm: int = 0
    named: int = 0
    hinted: int = 0

    def flush(self) -> None:
        if self.parts:
            text = "".join(self.parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append(Block(text, self.linked / max(self.chars, 1), self.main > 0, self.firm > 0 or self.named > 0, self.headings > 0, self.hinted > 0))
            self.parts, self.linked, self.chars = [], 0, 0
        self.breaks = 0

    def add(self, text: str) -> None:
        """Text of the current block."""
        self.parts.append(text)
        size = len(text) - text.count(" ")
        self.chars += size
        self.linked += size * self.in_link
        if self.breaks and not text.isspace():
            self.breaks = 0

    def push(self, tag: str, main: bool, outside: str) -> None:
        """Opens an element; ``outside`` is "firm", "name", "hint" or empty."""
        self.places[tag].append(len(self.stack))
        self.stack.append(_Open(tag, main, (self.firm, self.named, self.hinted)))
        if main and self.named and not self.main:
            # An article under such a name may be a comment or a teaser, so the name stays as a hint.
            self.named, self.hinted = 0, self.hinted + (tag == "article")
        self.main += main
        self.headings += tag in _HEADINGS
        self.firm += outside == "firm"
        self.named += outside == "name"
        self.hinted += outside == "hint"

    def pop(self, place: int) -> None:
        """Closes the element at a place and all within it; each element is closed once."""
        self.firm, self.named, self.hinted = self.stack[place].before
        while len(self.stack) > place:
            gone = self.stack.pop()
            self.places[gone.tag].pop()
            self.main -= gone.main
            self.headings -= gone.tag in _HEADINGS

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def close(self, tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        """Ends the innermost open element of these names, unless one of ``stop`` lies further in."""
        place = self._last(tags)
        if place >= 0 and place > self._last(stop):
            self.pop(place)


def _named(names: list[str]) -> str:
    """What the names of an attribute say: "name" if one is, or begins with, an outside name, "hint" if one has it elsewhere."""
    found = ""
    for name in names:
        if name in OUTSIDE_NAMES:
            return "name"
        head, *rest = [p for p in _PARTS.split(name) if p] or [""]
        if head in MODIFIERS or not rest:
            continue
        if head in OUTSIDE_NAMES and rest[-1] not in STATES:
            return "name"
        if head in OUTSIDE_NAMES or not OUTSIDE_NAMES.isdisjoint(rest):
            found = "hint"
    return found


def _marks(tag: str, attrs: str, in_main: bool) -> tuple[bool, str]:
    """Whether an element starts a main part, and how it starts an outside one, if it does."""
    main, outside = tag in MAIN, "firm" if tag in OUTSIDE or tag == "header" and not in_main else ""
    if not attrs or tag in ("html", "body"):
        return main, outside
    hint = ""
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next(filter(None, values), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            outside = "firm"
        elif name in ("class", "id", "role", "itemprop"):
            own = value.split()
            if name == "role" and "main" in own or not MAIN_NAMES.isdisjoint(own):
                main = True
            elif tag in MAIN:
                outside = outside or ("name" if any(v in ("comment", "comments") for v in own) else "")
            elif (said := _named(own)) == "name":
                outside = outside or "name"
            elif said:
                hint = said
            elif "header" in own and not in_main:
                outside = outside or "name"
    return main and not outside, outside or ("" if main else hint)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order. Elements that are never closed end with what holds them."""
    s = _State()
    at = 0
    # No tag starts that the last ">" does not end; what follows it is text, unless a comment or script runs on.
    last = page.rfind(">") + 1
    runs_on = False
    for m in _TOKEN.finditer(page, 0, last):
        start, end = m.span()
        if start > at:
            s.add(page[at:start])
        at = end
        if m["note"] or m["raw"]:
            runs_on = not (m["noted"] or m["ended"])
            continue
        if not m["tag"]:
            continue
        closing, tag, attrs = m["closing"], m["tag"].lower(), m["attrs"]
        if closing:
            if tag == "a":
                s.in_link = False
            if tag in BLOCK or tag in OUTSIDE:
                s.flush()
            s.close((tag,), () if tag in BLOCK else HOLDERS)
            continue
        if tag == "br":
            s.breaks += 1
            if s.breaks > 1:
                s.flush()
            s.parts.append(" ")
            continue
        if tag == "a":
            s.in_link = True
        if tag in BLOCK:
            s.flush()
            s.close(("p",), ("div", "section", "article", "main", "li", "td", "blockquote"))
            if tag in ("li", "dt", "dd", "option"):
                s.close((tag,), ("ul", "ol", "dl", "menu", "select"))
            elif tag in ("td", "th", "tr"):
                s.close(("td", "th"), ("table",))
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        main, outside = _marks(tag, attrs, s.main > 0)
        if tag in BLOCK or outside or main:
            s.flush()
            s.push(tag, main, outside)
        elif s.firm or s.named:
            s.push(tag, False, "")
    if not runs_on:
        s.add(page[at:])
    s.flush()
    return s.blocks


def _stop_share(words: list[str]) -> float:
    return len([w for w in words if w in STOP_WORDS]) / len(words) if words else 0.0


def points(text: str, stops: float, linked: float, main: bool, outside: bool) -> int:
    """The first pass: what a block's text and place say for it. From GOOD on it is good, up to BAD it is bad.

    Links take three from a long block and two from a short one; stop words give
    one to three, by their share and the block's length, and length alone one; a
    short block's words say nothing.
    """
    size = len(text)
    if linked > MOST_LINKED:
        own = -3 if size >= LONG else -2
    elif size < SHORT:
        own = -1 if linked > 0 else 0
    elif stops >= GOOD_STOPS:
        own = 3 if size >= LONG else 2
    else:
        own = 1 if stops >= DOUBTFUL_STOPS or size >= LONG else 0
    return own + WITHIN * main + WITHOUT * outside


def classify(blocks: list[Block]) -> None:
    """Sets each block's label to good or bad."""
    hinted = [b for b in blocks if b.hinted and not b.outside]
    words = [_WORD.findall(b.text.lower()) for b in blocks]
    stops = [_stop_share(w) for w in words]
    _two_passes(blocks, words, stops)
    if not hinted:
        return
    within = sum(len(b.text) for b in hinted if b.label == "good")
    for b in hinted:
        b.outside = True
    _two_passes(blocks, words, stops)
    if sum(len(b.text) for b in blocks if b.label == "good") < within:
        for b in hinted:
            b.outside = False
        _two_passes(blocks, words, stops)


def _two_passes(blocks: list[Block], words: list[list[str]], stops: list[float]) -> None:
    inner = [i for i, b in enumerate(blocks) if not b.outside]
    total = sum(len(words[i]) for i in inner)
    known = total == 0 or sum(stops[i] * len(words[i]) for i in inner) / total >= KNOWN_LANGUAGE
    for i, b in enumerate(blocks):
        b.stops = stops[i] if known else GOOD_STOPS
        b.points = points(b.text, b.stops, b.linked, b.main, b.outside)
    # Where no block is good, those with the most points are, if their words say anything for them.
    good = min(GOOD, max(1, max((b.points for b in blocks), default=0)))
    for b in blocks:
        b.label = "good" if b.points >= good else "bad" if b.points <= BAD else ""
    if not any(b.label == "good" for b in blocks):
        _short_texts(blocks, words, known)
    decided = [b.label for b in blocks]
    before = list(_nearest(blocks, decided, range(len(blocks))))
    after = list(_nearest(blocks, decided, range(len(blocks) - 1, -1, -1)))[::-1]
    for b, d, left, right in zip(blocks, decided, before, after, strict=True):
        if not d:
            b.label = _inherited(b, *left, *right)


def _short_texts(blocks: list[Block], words: list[list[str]], known: bool) -> None:
    """Where no block is good by itself, as in verse, dialogues and short notices, runs of ambiguous blocks are judged as one text each.

    A run ends at links and at what is bad or outside. Good are those whose stop words, taken together, are at least
    doubtful; in a language without a list, those at least a quarter as long as the longest; and without either, the longest.
    """
    runs: list[list[int]] = [[]]
    for i, b in enumerate(blocks):
        if b.label or b.outside or b.linked > 0:
            runs.append([])
        else:
            runs[-1].append(i)
    runs = [run for run in runs if run]
    sizes = [sum(len(blocks[i].text) for i in run) for run in runs]
    longest = max(sizes, default=0)
    shares = [_stop_share([w for i in run for w in words[i]]) for run in runs]
    fit = [share >= DOUBTFUL_STOPS if known else 4 * size >= longest for share, size in zip(shares, sizes, strict=True)]
    for run, size, good in zip(runs, sizes, fit, strict=True):
        if good or not any(fit) and size == longest:
            for i in run:
                blocks[i].label = "good"


def _nearest(blocks: list[Block], decided: list[str], way: range) -> Iterator[tuple[str, int]]:
    """For each block, the label of the last decided block before it on this way, and how far off it is.

    The end of the page is bad. So is what lies outside, two steps further off, as a
    short block often is the first or last of a text. Past the border of a main
    part there is no neighbour, as what surrounds it says nothing of what lies within.
    """
    label, place, main = "bad", -1, False
    for k, i in enumerate(way):
        b = blocks[i]
        if b.main != main and not b.outside:
            label, place, main = "" if b.main else "bad", k - 2, b.main
        yield label, k - place
        if b.outside:
            label, place = (label, place) if main else ("bad", k - 2)
        elif decided[i]:
            label, place = decided[i], k


def _inherited(b: Block, left: str, near_left: int, right: str, near_right: int) -> str:
    """The second pass: an ambiguous block's label from the decided ones to both sides (empty: none in its part)."""
    if not left or not right:
        # Without neighbours the block's own points have the word.
        return left or right or ("good" if b.points > 0 else "bad")
    if left == right:
        return left
    if b.points > 0 or b.heading and right == "good":
        return "good"
    if near_left != near_right:
        return left if near_left < near_right else right
    return "good" if b.stops >= GOOD_STOPS and not b.linked else "bad"


def main_text(page: str) -> str:
    """The good blocks in page order, one line each."""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text string, n_chars long)`` for every row of ``pages``.

    White space within a block becomes one space; null html and pages without main
    text give an empty text. Null ids and urls and repeated rows are kept as they
    come; other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    slim = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    schema = slim.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in balanced(batches, "_html", BATCH_BYTES):
            texts = [main_text(t) for t in table.column("_html").to_pylist()]
            found = table.drop_columns(["_html"]).append_column("text", pa.array(texts, pa.string()))
            yield from found.append_column("n_chars", pa.array([len(t) for t in texts], pa.int64())).combine_chunks().to_batches()

    found = slim.mapInArrow(extract, schema)
    return found.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")

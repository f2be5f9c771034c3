"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block; lines of menus, forms and the like count as blank. The text
lengths over a sliding window of lines surge where the article starts and dive to nothing where it ends; what
stands between is the main text. <article> and <main> are hints that lower the surge.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_strings, slices

WINDOW, SURGE = 3, 80
#: Text in <article> or <main> weighs so many times as much: it surges earlier, and decides unless other text is far longer.
HINT = 4
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|title|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: A tag by HTML's rules: a value begins behind its equals sign, in quotes or up to the next blank.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?![^\s/>])((?>[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?|[\"'])*)>|<[!?/][^>]*>")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANK = re.compile(r"\s+")
#: Elements that end a line of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never part of the article.
BOILERPLATE = frozenset("aside button dialog footer form head menu nav select".split())
_CELLS = frozenset("td th tr tbody thead tfoot".split())
_ITEMS = frozenset("li dd dt".split())
#: Elements whose end tag may be left out: the start tags that end them.
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()) | _CELLS | _ITEMS,
    "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]),
    "td": _CELLS, "th": _CELLS, "tr": _CELLS - {"td", "th"}, "tbody": frozenset(["tbody", "tfoot"]), "thead": frozenset(["tbody", "tfoot"]), "tfoot": frozenset(["tbody"]),
    "head": BLOCKS - {"head", "html"},
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A class, id or role marks such text in an element of any kind if it is made of these words alone ...
MARKS = frozenset("ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: ... and of these, which say nothing by themselves.
FILLERS = frozenset("area articles bar block bottom box button buttons container desktop form global icons inner item items left link links list mobile panel posts reader right row signup site slot sticky thread top unit user wrap wrapper".split())
_PARTS = re.compile(r"[^a-z]+")


def _is_mark(name: str) -> bool:
    words = set(filter(None, _PARTS.split(name.lower())))
    return not words.isdisjoint(MARKS) and words <= MARKS | FILLERS


def _is_marked(attributes: str) -> bool:
    return any(_is_mark(name) for m in _NAMES.finditer(attributes) for name in "".join(filter(None, m.groups())).split()) if attributes else False


def _is_boilerplate(name: str, attributes: str) -> bool:
    return name in BOILERPLATE or name == "header" or (name not in ("html", "body") and _is_marked(attributes))


def _ends(tags: list[re.Match]) -> dict[int, int]:
    """Of each element that may be boilerplate, by the index of its start tag: the index of the tag that ends it."""
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []  # blocks, and other elements if one of their name is boilerplate
    times: Counter[str] = Counter()

    def end(at: int) -> None:
        name, start = open_.pop()
        times[name] -= 1
        if start in ends:
            ends[start] = at

    for i, m in enumerate(tags):
        name = (m[2] or "").lower()
        if not name or name in VOID and name != "hr":
            continue
        block = name in BLOCKS or name in BOILERPLATE
        if m[1]:
            at = len(open_) - 1
            if times[name]:
                while open_[at][0] != name and (block or open_[at][0] not in BLOCKS):
                    at -= 1
                if open_[at][0] == name:
                    while len(open_) > at:
                        end(i)
            continue
        if block:
            while open_:
                at = len(open_) - 1
                while at > 0 and open_[at][0] not in BLOCKS and open_[at][0] not in BOILERPLATE:
                    at -= 1
                if name not in ENDED_BY.get(open_[at][0], ()):
                    break
                while len(open_) > at:
                    end(i)
        if name in VOID:
            continue
        skippable = _is_boilerplate(name, m[3])
        if block or skippable or times[name]:
            if skippable:
                ends[i] = len(tags)
            open_.append((name, i))
            times[name] += 1
    return ends


class Line(NamedTuple):
    text: str
    inside: bool  # does it stand in <article> or <main>
    link: bool  # is all of it a link


def lines_of(page: str) -> list[Line]:
    """The page's lines, boilerplate as empty ones; tags with no text between them make no line.

    Boilerplate that holds most of the page's articles, or of a page without any nearly all text, is a wrapper and
    not skipped.
    """
    page = _SKIP.sub(" ", page)
    tags = list(_TAG.finditer(page))
    ends = _ends(tags)
    # before each tag: characters of text, of those the ones in <article> or <main>, and such elements started
    texts, within, starts = [0], [0], [0]
    at = depth = 0
    for m in tags:
        n = len(page[at : m.start()].strip())
        at = m.end()
        texts.append(texts[-1] + n)
        within.append(within[-1] + n * (depth > 0))
        started = (m[2] or "").lower() in ("article", "main")
        starts.append(starts[-1] + (started and not m[1]))
        if started:
            depth = max(0, depth - 1) if m[1] else depth + 1
    total = texts[-1] + len(page[at:].strip())

    def wraps(i: int, name: str) -> bool:
        last = min(ends[i], len(tags) - 1) + 1
        if not within[-1]:
            return (name == "form" or name not in BOILERPLATE) and 4 * (texts[last] - texts[i + 1]) > 3 * total
        own, before = within[last] - within[i + 1], within[i + 1]
        return starts[last] > starts[i + 1] and 2 * own > within[-1] and (not article or 10 * before < own)

    lines: list[Line] = []
    text: list[str] = []
    plain = link = False  # has the line text outside of links, and is a link open
    article, at, i = 0, 0, 0

    def add(part: str) -> None:
        nonlocal plain
        text.append(part)
        plain = plain or not link and bool(part.strip())

    def end_line() -> None:
        nonlocal plain, link
        if line := _BLANK.sub(" ", entities.unescape("".join(text))).strip():
            lines.append(Line(line, article > 0, not plain))
        text.clear()
        plain = link = False

    while i < len(tags):
        m = tags[i]
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        i += 1
        if not name:
            continue
        if name in BLOCKS or name in BOILERPLATE:
            end_line()
        elif name == "br":
            text.append(" ")
        elif name == "a":
            link = not m[1]
        if m[1]:
            article -= name in ("article", "main") and article > 0
        elif name in ("article", "main"):
            article += 1
        elif i - 1 in ends and not (name == "header" and article and not _is_marked(m[3])) and not wraps(i - 1, name):
            end_line()
            lines += [Line("", article > 0, False)] * WINDOW
            i = ends[i - 1]
            at = len(page) if i == len(tags) else tags[i].start()
    add(page[at:])
    end_line()
    return lines


def _peak(lines: list[Line]) -> int:
    """The most text in a window."""
    return max((sum(len(x.text) for x in lines[i : i + WINDOW]) for i in range(max(1, len(lines) - WINDOW + 1))), default=0)


def _without_menus(stretch: list[Line], surge: int) -> list[Line]:
    """Without windows of short links at its start and its end, if it has other text."""
    for _ in range(2):
        run = next((i for i, x in enumerate(stretch) if x.inside or not x.link), 0)
        stretch = stretch[run if run >= WINDOW and _peak(stretch[:run]) < surge else 0 :][::-1]
    return stretch


def between_surge_and_dive(page: list[Line], surge: int = SURGE) -> list[str]:
    """The lines of each stretch in which a window's text reaches surge; a stretch ends where boilerplate dives to nothing.

    Within <article> or <main> a stretch goes on behind boilerplate and surges at a part of it. What surges there is
    all of the text, unless a stretch outside has more than HINT times as much; then the elements count for nothing.
    The longest stretch if none surges.
    """
    stretches: list[list[Line]] = [[]]
    for line in page:
        if stretches[-1] and (line.inside != stretches[-1][-1].inside or not (line.text or line.inside)):
            stretches.append([])
        if line.text:
            stretches[-1].append(line)
    stretches = [_without_menus(s, surge) for s in stretches if s]
    size = lambda s: sum(len(x.text) for x in s)
    inner = [s for s in stretches if s[0].inside and HINT * _peak(s) >= surge]
    outer = [s for s in stretches if not s[0].inside and _peak(s) >= surge]
    if inner and HINT * sum(map(size, inner)) >= max(map(size, outer), default=0):
        kept = inner
    else:
        kept = [s for s in stretches if _peak(s) >= surge] or [max(stretches, key=size, default=[])]
    return [x.text for s in kept for x in s]


def main_text(page: str) -> str:
    return " ".join(between_surge_and_dive(lines_of(page)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page, or one without an article, has an empty text. Null ids and urls stay null; repeated
    rows are extracted each; an empty table gives no rows. Nothing of the article is cut at any length.
    """

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(t) for part in slices(batch) for t in as_strings(part)], pa.string())

    rows = pages.select("page_id", "url", text("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))

"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one for each block element, and lines are laid out in tracks: those of each part that element,
role or name call a side part, those of each article or main element, and those of the rest. A line weighs as much as
it has characters outside links, scaled down in side parts and up in articles. Sums of weights over a sliding window of lines surge
where text begins and dive where it ends. The lines between such points are the text, on every track whose sums
come near the greatest of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from billweave.llm.tables import with_python_columns

WINDOW = 3
#: A side part that its name puts aside needs a window of so many characters to be taken for the article.
SURGE = 80
#: A surge has at least this share of the greatest window sum of the page, and one whole character.
SHARE, LEAST_SUM = 0.25, 1.0
#: What weights are scaled by: parts put aside by element or role, by name, by a name of readers' comments; article and main elements.
SIDE_SCALE, NAME_SCALE, READER_SCALE, LANDMARK_SCALE = 0.001, 0.02, 0.005, 8.0
#: A line with a greater share of its characters in links weighs nothing.
LINKED = 0.5
#: A part whose name puts it aside, but that holds more than so many times the text left, is no side part.
OUTWEIGHS = 3
#: Share of the heaviest part's text that a part within must have to be taken for the same.
LEAST_SHARE = 0.9

# Element names of HTML by what they mean for text.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "canvas", "iframe", "object", "select", "textarea",
          "button", "title", "datalist", "audio", "video", "map"}
ASIDE = {"nav", "aside", "footer", "form", "dialog", "menu", "head", "fieldset"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
          "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements whose end may be left out, or that stand alone; they never open a part of the page.
OPEN_ENDED = {"p", "li", "dd", "dt", "td", "th", "tr", "hr", "option", "tbody", "thead", "tfoot", "html", "body"}
#: Elements that hold the lines of one part of a page; the latter may be parts of one article.
HOLDERS, SECTIONS = {"div", "center", "section", "article", "main"}, {"section", "article", "main"}
SIDE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "promotion", "banner", "sidebar", "aside", "widget", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "footer", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing",
    "social", "related", "recommended", "recommendations", "outbrain", "taboola", "comment", "comments", "commentlist",
    "respond", "disqus", "discussion", "replies", "reply", "pagination", "pager", "hidden", "skip", "search",
    "copyright", "disclaimer", "reviews", "feedback"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog",
              "menu", "menubar", "form"}
#: Words at the start of a name that tell what a part has, not what it is.
HAVING = {"has", "with", "without", "no", "is", "js", "layout"}
#: Words at the end of a longer name that do the same.
STATES = {"open", "opened", "closed", "enabled", "disabled", "on", "off", "allowed"}
#: Heads of a page, unless their name says that they are those of an article.
HEADS, OF_ARTICLE = {"header"}, {"article", "post", "entry", "story", "content", "title"}
READERS = {"comment", "comments", "commentlist", "respond", "disqus", "discussion", "replies", "reply", "reviews",
           "feedback"}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?=/?[a-zA-Z]?\Z)|</?\Z",
    re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}


class Line:
    """``landmark`` is the number of the outermost article or main element around the line, 0 without one;
    ``group`` that of the element which holds the landmark; ``holder`` that of the innermost holder.
    ``named`` is the number of the innermost part that only its name puts aside, 0 without one; ``side`` says
    that element or role do so."""
    __slots__ = ("parts", "linked", "side", "landmark", "group", "holder", "named")

    def __init__(self, side: bool, landmark: int, group: int, holder: int, named: int):
        self.parts, self.linked, self.side, self.landmark, self.group = [], 0, side, landmark, group
        self.holder, self.named = holder, named

    def value(self) -> str:
        return " ".join("".join(self.parts).split())


def side_of(name: str, attributes: str, landmark: int) -> tuple[bool, bool, bool]:
    """Whether an element begins a part beside the article, whether its classes or id say so, and whether they
    say that it holds readers' comments."""
    if not attributes:
        return name in ASIDE, False, False
    words: set[str] = set()
    hidden = head = False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            for part in value.lower().split():
                own = WORD.findall(part)
                if own and own[0] not in HAVING and (len(own) == 1 or own[-1] not in STATES):
                    words.update(own)
                    head |= not landmark and bool(HEADS & {*own}) and not OF_ARTICLE & {*own}
        elif key == "role":
            hidden |= value.lower() in SIDE_ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
    return name in ASIDE or hidden, head or bool(words & SIDE_WORDS), bool(words & READERS)


class Page:
    """``lines`` in order; of each holder, the number of the one around it and whether it is a section; of each
    part that its name puts aside, the number of the one around it, the element's place in the page and
    whether it holds readers' comments. Number 0 is the page itself."""

    def __init__(self):
        self.lines = [Line(False, 0, 0, 0, 0)]
        self.holders: list[tuple[int, bool]] = [(0, False)]
        self.named: list[tuple[int, int, bool]] = [(0, -1, False)]


def lines_of(page: str, names: bool = True, disbelieved: frozenset[int] = frozenset()) -> Page:
    """Lines of a page. Elements stay open until their end or that of an outer one; an article or main element
    that begins in a menu left open ends that menu. Names of elements at the places ``disbelieved``
    do not count, and none without ``names``."""
    # open elements: name, beside the article, readers' comments, landmark number, holder number, named part
    stack: list[tuple[str, bool, bool, int, int, int]] = []
    read = Page()
    lines, holders = read.lines, read.holders
    groups = [0]  # of each landmark, the holder around it
    opened: Counter[str] = Counter()  # open elements of each name
    endless: set[str] = set()  # silent elements that have no end from here on
    links, at, end = 0, 0, len(page)

    def state() -> tuple[bool, bool, int, int, int]:
        return stack[-1][1:] if stack else (False, False, 0, 0, 0)

    def new_line() -> None:
        side, _, landmark, holder, named = state()
        lines.append(Line(side, landmark, groups[landmark], holder, named))

    def begun(name: str, attributes: str) -> tuple[bool, bool, bool]:
        own, by_name, readers = side_of(name, attributes, state()[2])
        believed = names and at not in disbelieved
        return own, by_name and believed, readers and believed

    def text(value: str) -> None:
        if value:
            lines[-1].parts.append(value)
            if links:
                lines[-1].linked += len(value.strip())

    while at < end:
        found = MARKUP.search(page, at)
        if not found:
            text(html.unescape(page[at:]))
            break
        text(html.unescape(page[at:found.start()]))
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or ""
        if name in SILENT and not closing:
            if not attributes.rstrip().endswith("/"):
                stop = None if name in endless else re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
                if stop is None:
                    endless.add(name)
                if stop:
                    at = stop.end()
                elif name in RAW:
                    at = end
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            text(" ")
        if name not in BLOCKS:
            continue
        if closing:
            if opened[name]:
                while True:
                    ended = stack.pop()[0]
                    opened[ended] -= 1
                    if ended == name:
                        break
                links = 0
        elif name == "body":
            stack.clear()
            opened.clear()
        elif name not in OPEN_ENDED and not attributes.rstrip().endswith("/"):
            side, readers, landmark, holder, named = state()
            begins, by_name, begins_readers = begun(name, attributes)
            if name == "header":
                begins |= not landmark
            if name in ("article", "main"):
                if not readers and not begins_readers and not begins and not by_name:
                    if (side or named) and not opened["aside"] and not opened["footer"]:
                        side, named = False, 0
                    if not side and not named and not landmark:
                        landmark = len(groups)
                        groups.append(holder)
            side |= begins
            if by_name and not begins:
                read.named.append((named, at, begins_readers))
                named = len(read.named) - 1
            if name in HOLDERS:
                holders.append((holder, name in SECTIONS))
                holder = len(holders) - 1
            opened[name] += 1
            stack.append((name, side, readers or begins_readers, landmark, holder, named))
            links = 0
        elif name in ("li", "p", "td", "th") and attributes:
            begins, by_name, begins_readers = begun(name, attributes)
            new_line()
            lines[-1].side |= begins
            if by_name and not begins:
                read.named.append((lines[-1].named, at, begins_readers))
                lines[-1].named = len(read.named) - 1
            continue
        new_line()
    return read


def main_text(page: str) -> str:
    """Lines between surge and dive points, joined by line ends. Names that would put the article itself aside are not
    believed: each time one is not, the text that is not aside becomes several times as much, so the readings end."""
    read, disbelieved = lines_of(page), frozenset()
    while more := outweighing(read) - disbelieved:
        disbelieved |= more
        read = lines_of(page, disbelieved=disbelieved)
    return text_between(read) or text_between(lines_of(page, names=False))


def outweighing(read: Page) -> frozenset[int]:
    """Places of elements that their names put aside though they hold the article. Such an element has a surge
    of text of its own, and OUTWEIGHS times the text that is not aside; readers' comments may well have
    more text than the article, so these count only if no surge is left. The heaviest part
    comes with the parts around and within it that have nearly all of its text."""
    if len(read.named) == 1:
        return frozenset()
    sums, weights = [0] * len(read.named), []
    for line in read.lines:
        value = "" if line.side else line.value()
        weight = 0 if line.linked > LINKED * len(value) else len(value)
        sums[line.named] += weight
        weights.append(weight)
    left = sums[0]
    for k in range(len(sums) - 1, 0, -1):  # an outer part has the smaller number
        sums[read.named[k][0]] += sums[k]
    for readers in (False, True):
        held = [k for k in range(1, len(sums)) if read.named[k][2] == readers and sums[k] >= SURGE]
        most = max(held, key=lambda k: (sums[k], -k), default=0)
        if most and (left < SURGE if readers else True) and sums[most] > OUTWEIGHS * left:
            places, k = {read.named[most][1]}, read.named[most][0]
            while k:
                places.add(read.named[k][1])
                k = read.named[k][0]
            inner = most
            for k in range(most + 1, len(sums)):
                if read.named[k][0] == inner and sums[k] > LEAST_SHARE * sums[most] and read.named[k][2] <= readers:
                    places.add(read.named[k][1])
                    inner = k
            return frozenset(places)
    return frozenset()


Track = tuple[bool, int, int]  # side part, part put aside by its name, holder of the landmark or -1


def text_between(read: Page) -> str:
    """The tracks are weighed twice: once a surge is found on the track of the rest, lines of the holder with most of
    its text weigh all their characters and have a track of their own, as lines of a landmark do."""
    found = [(line.value(), line) for line in read.lines]
    found = [(value, line) for value, line in found if value]
    weights = [len(v) if x.landmark or x.linked <= LINKED * len(v) else 0 for v, x in found]
    tracks: dict[Track, list[int]] = {}
    for i, (_, x) in enumerate(found):
        tracks.setdefault((x.side, x.named, x.group if x.landmark else -1), []).append(i)
    kept = surge_and_dive(tracks, weights, read)
    low = [t for t, lines in tracks.items() if t[:2] == (False, 0) and t[2] >= 0 and kept.isdisjoint(lines)]
    if low:  # landmarks with next to no text are lines like others
        tracks[False, 0, -1] = sorted(sum((tracks.pop(t) for t in low), tracks.get((False, 0, -1), [])))
        kept = surge_and_dive(tracks, weights, read)
    rest = tracks.get((False, 0, -1), [])
    if any(i in kept for i in rest):
        run = [i in kept for i in rest]
        begin, end = run.index(True), len(run) - run[::-1].index(True)
        inside = in_holder_of([found[i][1].holder for i in rest], [weights[i] for i in rest], begin, end, read.holders)
        own = [i for i, held in zip(rest, inside, strict=True) if held]
        for i in own:
            weights[i] = len(found[i][0])
        outside = [i for i, held in zip(rest, inside, strict=True) if not held]
        kept |= surge_and_dive(tracks | {(False, 0, -1): outside, (False, 0, -2): own}, weights, read)
    return "\n".join(found[i][0] for i in sorted(kept))


def scale_of(track: Track, read: Page) -> float:
    side, named, landmark = track
    scale = SIDE_SCALE if side else LANDMARK_SCALE if landmark >= 0 else 1.0
    return scale * ((READER_SCALE if read.named[named][2] else NAME_SCALE) if named else 1.0)


def surge_and_dive(tracks: dict[Track, list[int]], weights: list[int], read: Page) -> set[int]:
    """Lines between the surge and dive points of all tracks: a surge is a run of filled windows, one of which comes to the
    share of the greatest sum, and its dive is where the run ends."""
    runs = []
    for track, lines in tracks.items():
        scale = scale_of(track, read)
        for begin, end, most in filled_runs([weights[i] for i in lines]):
            runs.append((most * scale, lines[begin:end]))
    least = max([LEAST_SUM, *(SHARE * most for most, _ in runs)])
    return {i for most, lines in runs if most >= least for i in lines}


def in_holder_of(
    places: list[int], weights: list[int], begin: int, end: int, holders: list[tuple[int, bool]],
) -> list[bool]:
    """Whether each line stands in the innermost holder with more than half of the text of a run, or, if that
    is a section, in the holder of the section. The page itself holds only what is in no holder within."""
    sums = [0] * len(holders)
    for place, weight in zip(places[begin:end], weights[begin:end], strict=True):
        sums[place] += weight
    for k in range(len(holders) - 1, 0, -1):  # an outer holder has the smaller number
        sums[holders[k][0]] += sums[k]
    most = max((k for k, n in enumerate(sums) if 2 * n > sums[0]), default=0)
    while holders[most][1]:
        most = holders[most][0]
    inside = [most == 0]
    for k, (outer, section) in enumerate(holders[1:], 1):
        inside.append(k == most or (inside[outer] and (most > 0 or section)))
    return [inside[k] for k in places]


def filled_runs(weights: list[int]) -> list[tuple[int, int, int]]:
    """Stretches of lines from where window sums rise above nothing to where they fall to nothing: first line with a weight, end
    (exclusive), and the greatest sum."""
    before = [0, *accumulate(weights)]
    sums = [before[min(i + WINDOW, len(weights))] - before[i] for i in range(len(weights))]
    runs, at = [], 0
    while at < len(sums):
        if not sums[at]:
            at += 1
            continue
        stop = at
        while stop < len(sums) and sums[stop]:
            stop += 1
        begin = at
        while not weights[begin]:
            begin += 1
        runs.append((begin, stop, max(sums[at:stop])))
        at = stop
    return runs


def page_texts(df: DataFrame, page: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) with the main text of each page.

    Character references are decoded, white space within a block becomes one space, blocks are
    trimmed and joined by a line end. A page without text, a null or an empty one gives the
    empty text. Repeated rows give equal results, an empty table an empty one. Input
    columns named like a new one are replaced.
    """
    fields = [StructField("text", StringType()), StructField("n_chars", LongType())]

    def columns(column: pa.Array) -> list[pa.Array]:
        found = [main_text(v.as_py() or "") for v in column]
        return [pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]

    return with_python_columns(df, page, fields, lambda: columns)

"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import schema_of
from .tokens import mapped

# Elements of HTML, by what they do to text (fixed values).
RAW = "script style textarea title iframe noembed noframes xmp"
EMPTY = "area base br col embed hr img input link meta param source track wbr"
BLOCKS = (
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul"
)
HEADINGS = "h1 h2 h3 h4 h5 h6 hgroup"
#: Start tags that end an open paragraph.
ENDS_P = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section table ul"
)
#: Elements that an end tag of something else doesn't reach through.
BARRIERS = "button caption object table td template th"

# What we take for parts of a page other than its article: choices, not values of HTML.
#: Content that is no text of the page.
DROPPED = "head noscript template svg object canvas audio video select button datalist"
#: Elements for menus, headers, footers, sidebars and dialogs; a header inside an article is the article's own.
PARTS = "nav header footer aside dialog menu search"
#: Names in class, id or role that hint at such a part. They only make its text weigh less.
HINTS = (
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promotion banner "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead topbar footer copyright "
    "contentinfo sidebar sidebars aside complementary widget widgets related recommended recommendations "
    "cookie cookies consent gdpr notice notices notification alert popup modal dialog overlay "
    "form search newsletter subscribe subscription signup login "
    "comment comments commentlist respond disqus replies share sharing social"
)
#: Last words of a name that only say what kind of box it is, and first words after which it tells of something else.
BOXES = "area bar block body box container inner item items link links list section text wrapper"
ABOUT = "has no with without hide show is not"
#: First words before ``header`` in names of an article's own header.
OWN = "article content entry post story"

_raw, _empty, _blocks, _headings, _ends_p, _barriers, _dropped, _parts, _hints, _boxes, _about, _own = (
    frozenset(x.split()) for x in (RAW, EMPTY, BLOCKS, HEADINGS, ENDS_P, BARRIERS, DROPPED, PARTS, HINTS, BOXES, ABOUT, OWN)
)
_table_parts = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
_up_to = {"td": "tr", "th": "tr", "tr": "tbody thead tfoot", "tbody": "", "thead": "", "tfoot": ""}
_up_to = {k: frozenset(f"{v} table template".split()) for k, v in _up_to.items()}
_siblings = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup")}
_passable = frozenset("address div p".split())
#: Containers whose boundary is an empty line; others only end a line.
_spaced = frozenset("div section center figure details".split())

_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_REST = re.compile(r"(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|style|aria-hidden|hidden|href)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)|(?=[\s/>]))", re.I)
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

#: What a character in a part that names hint at weighs.
HINTED = 0.01
#: So many times the weight of a page's articles is taken for text of the article outside of them.
OUTSIDE = 5
#: Share of the page's text from which on a hint, or an element for parts, is taken for an error.
MOST = {"hint": 0.5, "part": 0.9}


def hints_at_part(name: str, in_article: bool = False) -> bool:
    """Whether a name is one of ``HINTS`` or ends in one. ``has-sidebar`` and the like tell of something else on the page."""
    words = [x.lower() for x in _WORD.findall(name)]
    while len(words) > 1 and words[-1] in _boxes:
        words.pop()
    if not words or words[-1] not in _hints or words[0] in _about:
        return False
    return not (words[-1] == "header" and (in_article or words[0] in _own))


@dataclass
class Line:
    """A line of the page: its text, the characters of it outside links, the article or main element it stands in (0:
    none), the open elements that mark it as a part, and whether it is a heading. An empty line has no text."""

    text: str = ""
    size: int = 0
    article: int = 0
    marks: tuple[int, ...] = ()
    heading: bool = False


@dataclass
class Run:
    """Lines that are kept or dropped together, with their places on the page and what they weigh."""

    hinted: bool = False
    article: bool = False
    headings: bool = True  # and nothing else
    places: list[int] = field(default_factory=list)
    sizes: list[float] = field(default_factory=list)

    def weight(self, window: int) -> float:
        """The greatest sum of ``window`` lines one after the other."""
        most = total = sum(self.sizes[:window])
        for old, new in zip(self.sizes, self.sizes[window:], strict=False):
            total += new - old
            most = max(most, total)
        return most


class _Reader:
    """Walks over a page's markup and collects its lines. What is open is a list of (name, marks, article, dropped)."""

    def __init__(self, window: int):
        self.window = window
        self.lines: list[Line] = []
        self.kinds: dict[int, str] = {}  # of marks
        self.open: list[tuple[str, tuple[int, ...], int, bool]] = []
        self.count: Counter[str] = Counter()  # of open elements
        self.parts: list[str] = []
        self.size = self.articles = self.link = 0
        self.loose = False  # the link has no end tag, and ends with its line

    def text(self, data: str) -> None:
        if self.open and self.open[-1][3]:
            return
        self.parts.append(data)
        if not self.link:
            self.size += len(data) - data.count(" ") - data.count("\n")

    def end_line(self, empty: int = 0) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                name, marks, article, _ = self.open[-1] if self.open else ("", (), 0, False)
                self.lines.append(Line(text, self.size, article, marks, name in _headings))
            self.parts.clear()
            self.link = 0 if self.loose else self.link
        self.size = 0
        if empty and self.lines:
            self.lines += [Line()] * empty

    def gap(self, name: str, marked: bool) -> int:
        """Empty lines at an element's boundary."""
        return self.window if marked or name in ("article", "main") else int(name in _spaced)

    def pop(self, at: int) -> None:
        """Close what is open from position ``at`` on."""
        while len(self.open) > at:
            self.end_line()
            name, marks, _, _ = self.open.pop()
            self.count[name] -= 1
            if gap := self.gap(name, marks != (self.open[-1][1] if self.open else ())):
                self.end_line(gap)
        if self.link > len(self.open) + 1:
            self.link = 0

    def find(self, names: tuple[str, ...] | frozenset[str], stop: frozenset[str]) -> int:
        """Position of the innermost open element of ``names``, unless one of ``stop`` comes before it; else -1."""
        if not any(self.count[x] for x in names):
            return -1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in names:
                return at
            if self.open[at][0] in stop:
                return -1
        return -1

    def implied_ends(self, name: str) -> None:
        """End elements whose end tags may be left out before the start tag ``name``."""
        if name in _ends_p and (at := self.find(("p",), _barriers)) >= 0:
            self.pop(at)
        if name in _siblings and any(self.count[x] for x in _siblings[name]):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in _siblings[name]:
                    self.pop(at)
                    break
                if self.open[at][0] in _blocks and self.open[at][0] not in _passable:
                    break
        if name in _up_to and (at := self.find(_up_to[name], frozenset())) >= 0:
            self.pop(at + 1)

    def start(self, name: str, rest: str, closed: bool) -> None:
        if name == "a":
            if _has_href(rest):
                self.link, self.loose = len(self.open) + 1, not closed
            return
        if name in _empty:
            if name in _blocks:
                self.end_line()
            return
        if name not in _blocks and name not in _dropped:
            return
        if name in _blocks and self.open and self.open[-1][0] == "head":
            self.pop(len(self.open) - 1)
        self.implied_ends(name)
        self.end_line()
        _, marks, article, dropped = self.open[-1] if self.open else ("", (), 0, False)
        kind = "" if dropped else _kind(name, rest, bool(article or self.count["main"]))
        if kind:
            marks = (*marks, len(self.kinds))
            self.kinds[marks[-1]] = kind
        if gap := self.gap(name, bool(kind)):
            self.end_line(gap)
        if name in ("article", "main"):
            self.articles += 1
            article = self.articles
        self.open.append((name, marks, article, dropped or name in _dropped))
        self.count[name] += 1

    def end(self, name: str) -> None:
        if name == "a":
            self.link = 0
        elif name in _blocks or name in _dropped:
            at = self.find((name,), frozenset() if name in _table_parts else _barriers - {name})
            if at >= 0:
                self.pop(at)
            self.end_line()

    def read(self, page: str) -> None:
        at = 0
        while found := _MARKUP.search(page, at):
            if found.start() > at:
                self.text(page[at : found.start()])
            at, name = found.end(), found[2]
            if name is None:
                continue
            name, rest = name.lower(), _REST.match(page, at)
            if rest is None:  # a tag that is cut off
                at = len(page)
                break
            at = rest.end()
            if found[1]:
                self.end(name)
            elif name in _raw:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
            else:
                after = _ANCHOR.search(page, at) if name == "a" else None
                self.start(name, rest[0], bool(after and after[1]))
        self.text(page[at:])
        self.pop(0)
        self.end_line()


def _attributes(rest: str) -> list[tuple[str, str]]:
    return [(k.lower(), v.strip("\"'")) for k, v in _ATTRIBUTE.findall(rest)] if len(rest) > 1 else []


def _has_href(rest: str) -> bool:
    return any(k == "href" for k, _ in _attributes(rest))


def _kind(name: str, rest: str, in_article: bool) -> str:
    """What an element is marked as: a ``part`` of the page or hidden, a ``hint`` by its names (or a form), or nothing."""
    if name in ("html", "body") or name in _dropped:
        return ""
    kind = "part" if name in _parts and not (name == "header" and in_article) else ""
    kind = kind or ("hint" if name in ("form", "fieldset") else "")
    for key, value in _attributes(rest):
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return "part"
        if not kind and key in ("class", "id", "role") and name not in _headings and name != "main":
            kind = "hint" if any(hints_at_part(x, in_article) for x in value.split()) else ""
    return kind


def lines_of(page: str, window: int) -> tuple[list[Line], dict[int, str]]:
    """The page's lines, and the kind of each mark. Block elements end lines; boundaries of containers leave an empty
    line, those of articles and of what is marked ``window`` ones."""
    reader = _Reader(window)
    reader.read(page)
    return reader.lines, reader.kinds


def mistaken(lines: list[Line], kinds: dict[int, str], surge: int) -> set[int]:
    """Marks that can't be right: what they mark holds most of the page's text and ``surge`` characters of it, and no
    article stands outside it."""
    inside, articles = dict.fromkeys(kinds, 0), dict.fromkeys(kinds, 0)
    total = sum(x.size for x in lines)
    in_articles = sum(x.size for x in lines if x.article)
    for x in lines:
        for m in x.marks:
            inside[m] += x.size
            articles[m] += x.size if x.article else 0
    return {
        m for m, kind in kinds.items() if inside[m] >= max(1, surge) and inside[m] > MOST[kind] * total and articles[m] == in_articles
    }


def runs_of(lines: list[Line], kinds: dict[int, str], window: int, surge: int) -> list[Run]:
    """Lines between surge and dive. An article is one run, and so is what names hint at; elsewhere a run ends where
    ``window`` lines one after the other have no text outside links, and begins with the next one that has some."""
    wrong = mistaken(lines, kinds, surge)
    closed: dict[tuple[int, int], Run] = {}
    runs: list[Run] = []
    run, pending, zeros = Run(), [], window
    for place, line in enumerate(lines):
        marks = [m for m in line.marks if m not in wrong]
        if any(kinds[m] == "part" for m in marks):
            continue
        key = (line.article, marks[0] if marks else -1)
        if line.text and key != (0, -1):
            own = closed.get(key)
            if own is None:
                own = closed[key] = Run(bool(marks), line.article > 0)
                runs.append(own)
            own.places.append(place)
            own.sizes.append(line.size * (HINTED if marks else 1))
            continue
        if not line.size:
            zeros += 1
            pending.append(place)
            continue
        if zeros >= window:
            run = Run()
            runs.append(run)
        else:
            run.places += pending
            run.sizes += [0] * len(pending)
        run.headings &= line.heading
        run.places.append(place)
        run.sizes.append(line.size)
        pending, zeros = [], 0
    return runs


def kept_runs(runs: list[Run], window: int, surge: int, share: float) -> list[Run]:
    """The runs that are text of the article.

    Where articles (or a main element) have text, they are the text, however short one is, and anything outside needs
    ``OUTSIDE`` times their greatest weight. Elsewhere text surges with the first run that weighs enough and dives after the last
    one, so what has text outside links between the two stays as well, and so do headings right before.
    """
    weights = [x.weight(window) for x in runs]
    peak = max(weights, default=0)
    need = max(min(surge, peak / 2), share * peak)
    articles = [w for x, w in zip(runs, weights, strict=True) if x.article and not x.hinted]
    if any(articles):
        outside = max(need, OUTSIDE * max(articles))
        return [x for x, w in zip(runs, weights, strict=True) if w and (w >= outside or x.article and not x.hinted)]
    kept = [w >= need and (w > 0 or not x.hinted) for x, w in zip(runs, weights, strict=True)]
    plain = [i for i, x in enumerate(runs) if not x.hinted]
    surged = [k for k, i in enumerate(plain) if kept[i]]
    if surged:
        first = surged[0]
        while first and runs[plain[first - 1]].headings and weights[plain[first - 1]]:
            first -= 1
        for k in range(first, surged[-1]):
            kept[plain[k]] |= weights[plain[k]] > 0
    return [x for x, k in zip(runs, kept, strict=True) if k]


def main_text(page: str, window: int = 3, surge: int = 80, share: float = 0.2) -> str:
    """The text between surge and dive points of the page's lines.

    The weight of a line is the length of the text outside links in the ``window`` lines from it. Where it dives to
    nothing a run of lines ends. A run weighs enough if its weight surges to ``surge`` characters (to half of the page's
    greatest weight where that is less), and to ``share`` of the page's greatest weight; see ``kept_runs`` for others.
    """
    lines, kinds = lines_of(page, window)
    kept = sorted(p for run in kept_runs(runs_of(lines, kinds, window, surge), window, surge, share) for p in run.places)
    return " ".join(lines[p].text for p in kept if lines[p].text)


def extract_text(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", window: int = 3, surge: int = 80, share: float = 0.2
) -> DataFrame:
    """``id``, ``text``, ``n_chars`` (code points) of each page, from its whole markup.

    Markup is stripped into lines, and the distribution of their text decides what is kept (see ``main_text``). Scripts,
    styles and controls are no text; elements for menus, headers, footers, sidebars and dialogs, and what is hidden, are
    cut; class, id and role only make text weigh less, and neither counts where it would take most of the page. Character
    references are decoded, white space in a line becomes one space, lines are joined by one space. Elements that are
    not closed end with their parent, markup that is cut off ends with the page. Null and empty pages, and pages without
    text, give the empty string. Runs that weigh alike are kept or dropped alike. Repeated ids give repeated rows; other
    columns are not read.
    """

    def work(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x.as_py() or "", window, surge, share) for x in batch.column(1)]
        return {"id": batch.column(0), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    return mapped(pages, [id_col, html_col], schema_of(pages, {"id": id_col}, "text string, n_chars long"), work)

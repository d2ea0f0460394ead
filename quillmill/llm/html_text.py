"""HTML extraction: the main text of a page from streamed parser events and text-to-tag ratios.

The standard library's parser is fed a page once; its events build the page's lines (blocks), each with its
text, the number of tags seen in it and the element it stands in. A line's ratio is its characters of text that
is not in links by its tags; lines in elements that are boilerplate by tag (menus, footers, forms, scripts ...)
or by the words of their class or id have ratio 0. Words that mark an element for what it is (adverts, cookie notices, reader comments)
count in any element; words that may mean something else (share, related, notice ...) count in elements that group
others, and words for a page's head do not count within an article. The ratios are smoothed with
a Gaussian, and lines of at least half the mean form clusters. The clusters choose the content region: the articles (or
the main element) that hold at least half of the clustered text, or else the deepest element that holds nine tenths
of it. An article's lines that are not boilerplate are all text, short ones too. In any other region the clusters decide about
its lines: the text runs from the first to the last clustered line, with the headings right above, and lines that are mostly links and in no
cluster are left out.

What is dropped within a line (a script, a drawing, a button) leaves the line whole. In a line white space is turned into one space and
trimmed; lines are joined by ``\\n``. A page takes time in proportion to its length, however its elements are nested. Defined cases: null or
empty html and pages without text give the empty string; unclosed and crossed tags are closed where the
public rules imply it; whole pages are read whatever their length; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text.
HIDDEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option button textarea form title".split())
#: Page furniture.
FURNITURE = frozenset("nav footer aside menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div td body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class or id that mark page furniture wherever they stand.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo cookie cookies consent gdpr newsletter subscribe signup paywall "
    "comments commentlist disqus respond sidebar sidebars navbar breadcrumb breadcrumbs footnav pagination pager popup modal overlay".split()
)
#: Words that mark it in elements that group others, not in a paragraph, heading or quotation.
GROUP_MARKS = frozenset(
    "promotion promoted banner notice notices notification alert subscription comment reply replies widget widgets menu menus nav navigation toolbar footer share sharing social related recommended recommendations".split()
)
GROUPS = frozenset("div section ul ol dl table tbody tr td li form fieldset figure details a span article".split())
#: Words that mark the head of a page, or of an article where they stand in one.
HEAD_MARKS = frozenset("header masthead topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NEVER_MARKED = frozenset("html body main".split())
#: Words that stand beside those of GROUP_MARKS in the name of a box; beside others (social-policy, tag-notices) they are about the content.
BESIDE = frozenset(
    "area bar block body box button buttons container content entry form group head heading header icon icons inner item items left link links list main more nav outer panel post posts article articles page "
    "right row section side site story stories title top bottom widget wrap wrapper first last large small mobile desktop inline this us thread count feed".split()
)
#: What the ratios of lines in a marked element are multiplied with.
LOWERED = 0.1
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Opening the first closes an open second.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: An implied close does not reach beyond these.
SCOPE = frozenset("ul ol dl table tbody thead tfoot select body html article main".split())


class Line:
    """A block's pieces of text, its tags, characters in links, whether it is dropped, the container and the marked element it stands in (-1: none)."""

    __slots__ = ("words", "tags", "linked", "dropped", "within", "mark", "heading", "text")

    def __init__(self, dropped: bool, within: int, mark: int, heading: bool):
        self.words: list[str] = []
        self.tags = self.linked = 0
        self.dropped, self.within, self.mark, self.heading, self.text = dropped, within, mark, heading, ""


class Lines(HTMLParser):
    """Collects lines, and the containers with the one around each (numbers rise from the outer to the inner ones)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, bool, int, int]] = []  # tag, dropped, mutes its line, innermost container, outermost marked element
        self.doubtful: list[bool] = []  # of each marked element, whether it may be the article all the same
        self.open: Counter[str] = Counter()
        self.kinds: list[str] = []
        self.around: list[int] = []
        self.muted = 0
        self.line = Line(False, -1, -1, False)

    def _break(self) -> None:
        if self.line.words:
            self.lines.append(self.line)
        top = self.stack[-1] if self.stack else ("", False, False, -1, -1)
        self.line = Line(top[1], top[3], top[4], any(self.open[h] for h in HEADINGS))

    def _furniture(self, tag: str, attrs: list) -> bool:
        if tag in HIDDEN or tag in FURNITURE:
            return True
        inside = self.open["article"] + self.open["main"] > 0
        if tag == "header" and not inside:
            return True
        for k, v in attrs:
            if k == "role" and v and v.lower() in ROLES or k == "hidden" or k == "aria-hidden" and v == "true":
                return True
            if k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
                return True
        return False

    def _marked(self, tag: str, attrs: list) -> str:
        """What a name among the classes or the id says of page furniture: "always", "group" or nothing."""
        inside = self.open["article"] + self.open["main"] > 0
        for name in " ".join(v for k, v in attrs if k in ("class", "id") and v and tag not in NEVER_MARKED).split():
            words = {p.lower() for p in _PARTS.findall(name)}
            if words & MARKS or not inside and words & HEAD_MARKS:
                return "always"
            if tag in GROUPS and words & GROUP_MARKS and words <= GROUP_MARKS | BESIDE | HEAD_MARKS:
                return "group"
        return ""

    def _pop(self, at: int) -> None:
        gone = self.stack[at:]
        blocks = any(x[0] in BLOCK for x in gone)
        if blocks:
            self._break()
        del self.stack[at:]
        self.open.subtract(x[0] for x in gone)
        self.muted -= sum(x[2] for x in gone)
        if blocks:
            self._break()

    def _close_open(self, tags: frozenset, beyond: frozenset) -> None:
        if not any(self.open[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in tags:
                return self._pop(at)
            if self.stack[at][0] in beyond:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.line.tags += 1
            if tag == "hr":
                self._break()
            elif tag in ("br", "img", "input") and not self.muted:
                self.line.words.append(" ")
            return
        if tag in BLOCK:
            self._close_open(frozenset(["p"]), SCOPE | {"div", "section", "li", "td", "th", "button"})
        if tag in CLOSES:
            self._close_open(CLOSES[tag], SCOPE)
        if tag == "body":
            self._close_open(frozenset(["head"]), frozenset())
        inherited, within, mark = (self.stack[-1][1], self.stack[-1][3], self.stack[-1][4]) if self.stack else (False, -1, -1)
        dropped = inherited or self._furniture(tag, attrs)
        told = self._marked(tag, attrs) if mark < 0 and not dropped else ""
        if told:
            if tag in BLOCK:
                mark = len(self.doubtful)
                self.doubtful.append(tag == "article" and told == "group")
            else:  # part of a line, which has one ratio
                dropped = True
        mutes = dropped and not inherited and tag not in BLOCK
        if tag in CONTAINER:
            self.around.append(within)
            within = len(self.kinds)
            self.kinds.append(tag)
        self.stack.append((tag, dropped, mutes, within, mark))
        self.open[tag] += 1
        self.muted += mutes
        if tag in BLOCK:
            self._break()
        self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if tag == "br" and not self.muted:
            self.line.words.append(" ")
        if tag in VOID or not self.open[tag]:
            return
        inline = tag not in BLOCK and tag not in HIDDEN
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                return self._pop(at)
            if inline and self.stack[at][0] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.line.words.append(data)
            if self.open["a"]:
                self.line.linked += len(data)

    def done(self) -> list[Line]:
        self.close()
        self._break()
        for x in self.lines:
            x.text = " ".join("".join(x.words).split())
            x.linked = min(x.linked, len(x.text))
        return [x for x in self.lines if x.text]


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the kernel reaches three sigmas, and the ends are padded with zeros."""
    reach = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[reach : reach + len(ratios)]


def _region(parser: Lines, lines: list[Line], weight: np.ndarray) -> tuple[list[bool], bool]:
    """For each container whether it is in the content region (the last entry: lines in none), and whether that is an article or main element.

    weight: characters of each line that is in a cluster.
    """
    kinds, around, total = parser.kinds, parser.around, weight.sum()
    held = [0.0] * len(kinds)
    for x, w in zip(lines, weight):
        if x.within >= 0:
            held[x.within] += w
    in_article, depth = [False] * len(kinds), [0] * len(kinds)
    for c in range(len(kinds) - 1, -1, -1):
        if around[c] >= 0:
            held[around[c]] += held[c]
    for c, a in enumerate(around):
        if a >= 0:
            in_article[c], depth[c] = in_article[a] or kinds[a] == "article", depth[a] + 1
    articles = [c for c, k in enumerate(kinds) if k == "article" and not in_article[c] and held[c]]
    mains = [c for c, k in enumerate(kinds) if k == "main" and held[c]]
    marked = True
    if articles and sum(held[c] for c in articles) >= 0.5 * total:
        chosen = set(articles)
    elif mains and max(held[c] for c in mains) >= 0.5 * total:
        chosen = {max(mains, key=lambda c: held[c])}
    else:
        deep = [c for c in range(len(kinds)) if held[c] >= 0.9 * total]
        chosen, marked = ({max(deep, key=lambda c: depth[c])} if deep else set()), False
    inside = [False] * len(kinds)
    for c, a in enumerate(around):
        inside[c] = c in chosen or not chosen or a >= 0 and inside[a]
    return [*inside, not chosen], marked


def main_text(html: str | None, sigma: float = 1.0) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.done()
    size = np.array([0 if x.dropped else len(x.text) for x in lines], dtype=float)
    if not size.any():
        return ""
    plain = np.array([0 if x.dropped else len(x.text) - x.linked for x in lines], dtype=float)
    if not plain.any():
        plain = size
    # A box's name on the article that has most of the text marks nothing.
    held = np.bincount([x.mark + 1 for x in lines], weights=plain)
    marked_lines = np.array([x.mark >= 0 and not (parser.doubtful[x.mark] and held[x.mark + 1] >= 0.5 * plain.sum()) for x in lines])
    lowered = np.where(marked_lines, LOWERED, 1.0)
    # Lowered before, so that marked lines do not lift those beside them, and after, so that those do not lift them.
    ratio = smoothed(lowered * plain / np.array([max(1, x.tags) for x in lines]), sigma) * lowered
    # Lines of at least half the mean smoothed ratio of lines that may be content form the clusters.
    high = (ratio >= 0.5 * ratio[plain > 0].mean()) & (plain > 0)
    inside, marked = _region(parser, lines, np.where(high, size, 0.0))
    kept = [k for k, x in enumerate(lines) if not x.dropped and inside[x.within] and (high[k] or not marked_lines[k])]
    if not marked and any(high[k] for k in kept):
        first, last = (next(i for i in order if high[kept[i]]) for order in (range(len(kept)), range(len(kept) - 1, -1, -1)))
        while first and lines[kept[first - 1]].heading:
            first -= 1
        kept = [k for k in kept[first : last + 1] if high[k] or lines[k].linked <= 0.5 * len(lines[k].text)]
    return "\n".join(lines[k].text for k in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row for each page; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, url string, text string, n_chars long"
    return slim.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})

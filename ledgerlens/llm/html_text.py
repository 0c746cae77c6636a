"""Main text of HTML pages from streaming parser events.

The standard library's parser is read once per page. Its events give lines (the text of one block element each) with
the count of their tags. Elements that are never content (scripts, buttons and the like) have no lines. Others are
marked on the way: as menus, footers and the like, by the words of class and id, or as forms. A mark holds unless the
element has most of the page's text and the build of an article (a title or an article element; for a form, a
paragraph or a long line), as wrappers around a whole page do, and menus and the like that are never closed. The
text-to-tag ratios of the lines left are smoothed by a Gaussian, and those above a threshold (their deviation) are the
seeds. The cluster of seeds is the innermost element with most of the seeds' text. If an article or main element is
around it, that is the content, without rows of links; else from the first to the last line of the cluster that is a
seed or shares its container with most of the seeds' text, with seeds of paragraphs in containers beside it and the
headings just before, without lines that are mostly links, unless they are paragraphs of the container itself. A class
or id whose words say more than a mark (``social-history``) takes a line out of the search for the cluster, but not out
of the cluster. Copyright lines at the end go.

Free style (Arrow batches in Python), as there is no native HTML parser; work is per row, without a shuffle, and in
proportion to the page: open elements are found by name, and marks and containers form trees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, unused

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
DROPPED = frozenset("audio button canvas datalist dialog head iframe input label noscript object script select style svg template textarea title video".split())
#: Dropped, too, where they are closed; an open one may have the page in it.
SECTIONS = frozenset("aside footer header menu nav".split())
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup sidebar aside widget"
    " menu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer copyright comment comments respond disqus replies share sharing social related recommended pagination pager toolbar login search hidden".split()
)
#: Words that begin so mark elements too.
DROPPED_STEMS = re.compile(r"advert|comment|cookie|sidebar|newsletter|sponsor|navbar")
#: Words that may stand with a mark in a name; any other word makes a mark loose.
BESIDE_MARKS = frozenset(
    "above area article articles bar below block blocks body bottom box button buttons by col column container content contents desktop end form global group head header icon icons in inline inner item items js label left link links"
    " list main middle mobile module news of on outer page panel post posts primary right row secondary section side site slot stories story text the this title top unit widget widgets wrap wrapper".split()
)
#: Words that mark reader comments, and those that may stand with them in the name of one that marks an article.
COMMENTS = frozenset("comment comments commentlist respond disqus reply replies".split())
OF_COMMENTS = COMMENTS | frozenset("list item body thread entry depth reader user".split())
#: Names with these say what an element has beside it or has not.
ABOUT = frozenset("has have with without no not is show hide".split())
#: Elements whose class or id marks them only as reader comments, or not at all.
KEPT = frozenset(("article", "main"))
NEVER = frozenset(("html", "body", *HEADINGS))
REGIONS = frozenset(("article", "main"))
#: Elements that hold the paragraphs of a text side by side.
BOXES = frozenset("article body div main section td".split())
#: Open elements that a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("ul ol dl table article section div main body html td th blockquote".split())
_WORD = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
KERNEL /= KERNEL.sum()
LINKS_AT_MOST = 0.6
#: Characters outside links that several links may have beside them and still be a row of links.
BESIDE_LINKS = 24
#: Characters outside links from which a line of a form is prose.
LONG_LINE = 80
COPYRIGHT = re.compile(r"(copyright\s*)?(©|\(c\))|copyright\s+\d{4}", re.IGNORECASE)
SENTENCE_ENDS = tuple(".!?…:;\"'”’»。")
#: Share of a page's text beyond which a mark doesn't hold, and of the seeds' text that their cluster has at least.
MOST = 0.6
CLUSTER = 0.75


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters in links
    heading: bool
    box: int
    mark: int
    links: int
    place: str  # "p" in a paragraph, quotation or heading, "li" in an item or cell, else empty

    @property
    def texty(self) -> bool:
        return self.linked <= LINKS_AT_MOST * len(self.text)

    @property
    def navigation(self) -> bool:
        """A row of links, or a link by itself; not a paragraph, item, cell or heading that is a link."""
        if self.links < 2:
            return not self.texty and not self.place
        beside = self.texty and len(self.text) - self.linked > BESIDE_LINKS
        return not (beside or self.heading or self.place == "li" or self.text.endswith(SENTENCE_ENDS))


class Reader(HTMLParser):
    """Lines of a page; boxes and marks, to whose numbers they refer, are trees."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []
        self.places: dict[str, list[int]] = {}
        self.dropped = self.tags = self.linked = self.links = 0
        self.box = self.mark = 0
        self.boxes: list[tuple[int, str]] = [(0, "")]  # container around it, element
        self.marks: list[tuple[int, str]] = [(0, "")]  # mark around it, kind
        self.titles, self.paragraphs = [0], [0]  # of each mark
        self.text: list[str] = []
        self.heading = False
        self.place = ""
        self.lines: list[Line] = []

    def inside(self, *tags: str) -> bool:
        return any(self.places.get(t) for t in tags)

    def end_line(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.lines.append(Line(text, self.tags, self.linked, self.heading, self.box, self.mark, self.links, self.place))
            self.text = []
        self.tags = self.linked = self.links = 0
        self.heading = False
        self.place = ""

    def marked(self, tag: str, value: str) -> str:
        """"comments", "words", "loose" or "" by the names in a class or id."""
        kind = ""
        for name in value.split():
            found = _WORD.findall(_HUMP.sub(r"\1 \2", name).lower())
            if not ABOUT.isdisjoint(found):
                continue
            comments = not COMMENTS.isdisjoint(found) or any(w.startswith("comment") for w in found)
            if tag in KEPT:
                if comments and all(w in OF_COMMENTS or w.isdigit() for w in found):
                    kind = "words"
            elif comments:
                return "comments"
            elif not DROPPED_WORDS.isdisjoint(found) or any(DROPPED_STEMS.match(w) for w in found) or ("header" in found and not self.inside("article", "main")):
                marks = (w for w in found if w not in DROPPED_WORDS and not w.isdigit() and not DROPPED_STEMS.match(w))
                kind = "words" if kind == "words" or BESIDE_MARKS.issuperset(marks) else "loose"
        return kind

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and self.places.get("head"):
            self.close_open({"head"}, ())
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            self.close_open({"p"}, LIMITS)
            if tag in CLOSES:
                self.close_open(CLOSES[tag], LIMITS - CLOSES[tag])
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        drop = tag in DROPPED
        mark = "form" if tag == "form" else ""
        for name, value in attrs:
            if name in ("class", "id"):
                if tag not in NEVER and value and (found := self.marked(tag, value)):
                    mark = next(k for k in ("comments", "words", "form", "loose") if k in (mark, found))
            elif name == "role":
                drop |= value in DROPPED_ROLES
                mark = mark or ("form" if value == "form" else "")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "")):
                drop = True
        if tag in SECTIONS and (tag != "header" or not self.inside("article", "main")):
            mark = "section"
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, drop, self.box, self.mark))
        if tag in BOXES:
            self.boxes.append((self.box, tag))
            self.box = len(self.boxes) - 1
        if mark:
            self.marks.append((self.mark, mark))
            self.titles.append(0)
            self.paragraphs.append(0)
            self.mark = len(self.marks) - 1
        if tag == "p":
            self.paragraphs[self.mark] += 1
        elif tag == "h1" or (tag in REGIONS and not mark):
            self.titles[self.mark] += 1
        self.dropped += drop
        self.links += tag == "a"

    def last(self, tags) -> int:
        """Place of the innermost open element of ``tags``, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def close_open(self, tags, limits) -> None:
        """Close the innermost open element of ``tags``, with all in it, unless one of ``limits`` stands before it."""
        at = self.last(tags)
        if at >= 0 and at > self.last(limits):
            self.pop(at)

    def pop(self, size: int) -> None:
        for tag, drop, box, mark in reversed(self.open[size:]):
            self.places[tag].pop()
            self.dropped -= drop
            self.box, self.mark = box, mark
        del self.open[size:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        at = self.last((tag,))
        if at >= 0:
            if tag in SECTIONS and self.mark:
                self.close_section(self.open[at][3])
            self.pop(at)

    def close_section(self, around: int) -> None:
        """The mark that the element made whose mark around is ``around``: its end is told, so it holds."""
        mark = self.mark
        while mark != around and self.marks[mark][0] != around:
            mark = self.marks[mark][0]
        if mark != around and self.marks[mark][1] == "section":
            self.marks[mark] = (around, "closed")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.dropped and self.open[-1][0] == "head" and not data.isspace():
            self.close_open({"head"}, ())
        if not self.dropped:
            self.text.append(data)
            if self.inside("a"):
                self.linked += len(data)
            if not self.heading and self.inside(*HEADINGS):
                self.heading = True
            if not self.place:
                self.place = "p" if self.heading or self.inside("p", "blockquote") else "li" if self.inside("li", "td", "th", "dd", "dt") else ""


def _sums(own: list[int], parents: list[int]) -> list[int]:
    """Of each node of a tree, whose parents come first, with all below it."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def _unmarked(reader: Reader) -> tuple[list[Line], set[int]]:
    """The lines in no element whose mark holds, and the places among them of those whose marks are loose."""
    parents = [p for p, _ in reader.marks]
    closed = [False] * len(parents)
    for i, (parent, kind) in enumerate(reader.marks[1:], 1):
        closed[i] = closed[parent] or kind == "closed"
    own, prose = [0] * len(parents), [0] * len(parents)
    for x in reader.lines:
        if not closed[x.mark]:
            own[x.mark] += len(x.text)
            prose[x.mark] += len(x.text) - x.linked >= LONG_LINE
    titles, paragraphs = ([0 if c else n for n, c in zip(counts, closed, strict=True)] for counts in (reader.titles, reader.paragraphs))
    held, titles, paragraphs, prose = (_sums(x, parents) for x in (own, titles, paragraphs, prose))
    drops, loose = list(closed), [False] * len(parents)
    for i, (parent, kind) in enumerate(reader.marks[1:], 1):
        wraps = titles[i] or (kind == "form" and (paragraphs[i] or prose[i]))
        holds = kind == "comments" or not wraps or held[i] <= MOST * held[0]
        drops[i] |= drops[parent] or (holds and kind != "loose")
        loose[i] = loose[parent] or (holds and kind == "loose")
    kept = [x for x in reader.lines if not drops[x.mark]]
    return kept, {i for i, x in enumerate(kept) if loose[x.mark]}


def _without_copyright(lines: list[Line]) -> str:
    while lines and COPYRIGHT.match(lines[-1].text):
        lines = lines[:-1]
    return "\n\n".join(x.text for x in lines)


def main_text(html: str | None) -> str:
    """The article's lines joined by blank lines; empty if there is none."""
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.end_line()
    lines, loose = _unmarked(reader)
    if len(loose) == len(lines):
        loose = set()
    sure = [i for i in range(len(lines)) if i not in loose]
    if not sure:
        return ""
    ratio = np.array([len(lines[i].text) / max(1, lines[i].tags) for i in sure])
    smooth = np.convolve(np.pad(ratio, 2, mode="edge"), KERNEL, mode="valid")
    least = smooth.std()
    seeds = {i for i, level in zip(sure, smooth, strict=True) if level >= least and lines[i].texty}
    parents, own = [p for p, _ in reader.boxes], [0] * len(reader.boxes)
    for i in seeds:
        own[lines[i].box] += len(lines[i].text)
    held = _sums(own, parents)
    if not held[0]:
        return ""
    cluster = max(i for i, n in enumerate(held) if n >= CLUSTER * held[0])  # the elements with most of it lie in each other
    around, region = cluster, 0
    while around:
        if reader.boxes[around][1] in REGIONS and reader.boxes[region][1] != "article":
            region = around
        around = parents[around]

    def below(top: int) -> list[bool]:
        out = [i == top for i in range(len(parents))]
        for i in range(1, len(parents)):
            out[i] |= out[parents[i]]
        return out

    within = below(region or cluster)
    if region:
        return _without_copyright([x for i, x in enumerate(lines) if within[x.box] and not x.navigation and (x.texty or i not in loose)])
    box = max((i for i in range(len(own)) if within[i]), key=lambda b: (own[b], -b))
    at = [i for i in sure if lines[i].texty and within[lines[i].box] and (lines[i].box == box or i in seeds)]
    first, last = at[0], at[-1]
    if cluster and reader.boxes[parents[cluster]][1] not in ("", "body"):
        beside = below(parents[cluster])

        def joins(i: int) -> bool:
            return i in seeds and beside[lines[i].box] and (lines[i].place == "p" or len(lines[i].text) >= least * max(1, lines[i].tags))

        while first and joins(first - 1):
            first -= 1
        while last + 1 < len(lines) and joins(last + 1):
            last += 1
    while first and lines[first - 1].heading and first - 1 not in loose:
        first -= 1
    kept = []
    for i in range(first, last + 1):
        x = lines[i]
        own_link = x.box == box and x.place == "p" and not x.navigation
        if (x.texty or own_link) and (i not in loose or within[x.box]):
            kept.append(x)
    return _without_copyright(kept)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the html) with text and n_chars, one row per input row.

    Null or empty pages, and pages without content, get an empty text; repeated rows stay repeated; of elements with
    equally much text the first counts. Kept columns named text or n_chars give way to the results.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars") and (keep is not None or c != html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=[*keep, "text", "n_chars"])

    arrow_batches(pages.sparkSession)
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*keep, F.col(html).cast("string").alias(unused(keep))).mapInArrow(run, schema)

"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. A line is the text between two block boundaries; its ratio is its
characters outside of links over its tags. The logarithms of the ratios are smoothed by a Gaussian over neighbouring
lines and split in two clusters (one-dimensional 2-means); the midpoint of the clusters is the threshold.

Article and main elements compete by their own lines' characters outside of links: the best one is the main article, with
what its enclosing ones hold beside it; other articles (teasers, and readers' comments, which may be nested) are left
out. But where an article holds less itself than the articles within it, these are its parts, and all of them stay. Within
the main article, a line that is mostly links goes if its smoothed ratio is below the threshold; all others stay, short
ones too. If there is no such element, or the lines outside of them hold more than twice as much, a region is a run of
lines of the nearest sectioning element, and those with a line above the threshold, smoothed or not, are content as a whole.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are no candidates, by
element or by the words of class, id and role; within an article a header is part of it, and an element of which only a
part of a class word is a mark (`related-work`) is left to the ratios: it stays if the logarithm of its own ratio is
at least half the article's threshold. An article inside of such an element counts only on a page that has nothing else, as where the element is never
closed.

Defined results: a null or empty page, or one without text, gives the empty text; an unclosed element ends with its
parent; repeated rows are extracted alike; an empty table gives no rows; extra columns are ignored. The time is in
proportion to the page, however its tags are nested.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from loamdex.llm.common import only

#: Radius and width of the Gaussian, in lines.
RADIUS, SIGMA = 2, 1.0

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_SECTION = frozenset("article aside body div footer form header main nav section table td".split())
_SILENT = frozenset("audio button canvas datalist head iframe input label map math noscript object option script select style svg template textarea title video".split())
_BOILERPLATE = frozenset("aside dialog fieldset footer form header menu nav".split())
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words in class or id that mark what isn't the article.
_MARK = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|commentarea|commentform|commentlist|"
    r"commentsection|commentslist|commentthread|cookie|cookies|consent|disqus|footer|"
    r"header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|popup|promo|promotion|related|recommended|respond|share|sharing|sidebar|"
    r"sidenav|social|sponsor|sponsored|subscribe|tags|toolbar|widget)(?:$|[\s_\d-])",
    re.I,
)
#: What may stand beside marks in a class word that is a mark as a whole, and the joints of a word.
_BESIDE = frozenset(
    "" " area bar block body bottom box button buttons column container content entry form group head heading holder icons inner item items left link links list main notice "
    "outer page panel post posts primary right row secondary section site stories story text thread title top unit widgets wrap wrapper zone".split(" ")
)
_JOINT = re.compile(r"[_-]|(?<=[a-z])(?=[A-Z])")
#: Class words that tell of a mark elsewhere; and marks that are part of an article within one.
_ABOUT = ("has-", "no-", "with-", "without-", "hide-", "show-")
_OWN_HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_\d-])", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?]")
#: What an opening tag closes implicitly, up to the nearest of these ends.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class _Line(NamedTuple):
    text: str
    free: int  # characters outside of links
    tags: int
    region: int
    article: int  # the innermost article or main element, 0 outside
    spare: bool  # in an article within boilerplate
    doubt: int  # the element of an article that may be boilerplate, 0 for none


class _Open(NamedTuple):
    tag: str
    silent: bool = False
    boilerplate: bool = False
    region: int = 0
    article: int = 0
    spare: bool = False
    link: bool = False
    doubt: int = 0


class _Lines(HTMLParser):
    """Collects the candidate lines, and the article around each article (0 for none)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.around: dict[int, int] = {}
        self.mains: set[int] = set()
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of open tags in the stack, and of "block" ones
        self.now = _Open("")
        self.regions = self.doubts = 0
        self.text: list[str] = []
        self.free = self.tags = 0

    def _line(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.lines.append(_Line(text, min(self.free, len(text)), self.tags, self.now.region, self.now.article, self.now.spare, self.now.doubt))
                self.tags = 0
            self.text, self.free = [], 0

    def _restore(self) -> None:
        self.now = self.stack[-1] if self.stack else _Open("", region=self.now.region if self.regions else 0)

    def _last(self, tag: str) -> int:
        """The place of the innermost open element of this tag; -1 if there is none."""
        return self.places[tag][-1] if self.places.get(tag) else -1

    def _push(self, element: _Open) -> None:
        for name in (element.tag, *([" block"] if element.tag in _BLOCK else [])):
            self.places[name].append(len(self.stack))
        self.stack.append(element)
        self._restore()

    def _pop_to(self, depth: int) -> None:
        for element in reversed(self.stack[depth:]):
            self.places[element.tag].pop()
            if element.tag in _BLOCK:
                self.places[" block"].pop()
        del self.stack[depth:]
        self._restore()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self._line()
            if (i := self._last("p")) >= 0 and i == self._last(" block"):  # a block ends a paragraph
                self._pop_to(i)
        elif tag == "br":
            self.text.append(" ")
        if tag in _CLOSES:
            closed, ends = _CLOSES[tag]
            end = max(self._last(x) for x in ends)
            within = [at[i] for x in closed if (at := self.places.get(x)) and (i := bisect_right(at, end)) < len(at)]
            if within:
                self._pop_to(min(within))
        if tag in _VOID:
            return
        _, silent, boilerplate, region, article, spare, link, doubt = self.now
        silent, link = silent or tag in _SILENT, link or tag == "a"
        marked, perhaps = (False, False) if tag in ("html", "body") else self._marked(attrs, bool(article))
        if tag in ("article", "main") or ("role", "main") in attrs:
            spare = spare or boilerplate
            silent, boilerplate, link = False, marked or perhaps, False  # an article ends what was left open before it
            self.around[len(self.around) + 1] = article
            article = len(self.around)
            if tag != "article":
                self.mains.add(article)
        elif tag in _BLOCK and tag not in ("html", "body") or marked or perhaps:
            boilerplate = boilerplate or marked or tag in _BOILERPLATE and not (article and tag == "header")
            if perhaps and not doubt:
                self.doubts += 1
                doubt = self.doubts
        if tag in _SECTION:
            self.regions += 1
            region = self.regions
        self._push(_Open(tag, silent, boilerplate, region, article, spare, link, doubt))

    @staticmethod
    def _marked(attrs: list, in_article: bool) -> tuple[bool, bool]:
        """(marked, perhaps): by the words of class, id and role. In an article, a class word that is more than marks and
        what stands beside them is left in doubt."""
        perhaps = False
        for k, v in attrs:
            if k == "hidden" or k == "role" and v in _ROLES:
                return True, False
            if k in ("class", "id") and v:
                for w in v.split():
                    word = _JOINT.sub("-", w)
                    if word.lower().startswith(_ABOUT) or not _MARK.search(_OWN_HEADER.sub(" ", word) if in_article else word):
                        continue
                    if not in_article or all(x.lower().rstrip("0123456789") in _BESIDE or _MARK.search(x) for x in word.split("-")):
                        return True, False
                    perhaps = True
        return False, perhaps

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _BLOCK:
            self._line()
        edge = -1 if tag in ("html", "body", "article", "main") else max(self._last("article"), self._last("main"))
        if (i := self._last(tag)) > edge:  # a stray end doesn't leave the article
            self._pop_to(i)
        if tag in _SECTION:  # lines after a closed section of the same parent are a region of their own
            self.regions += 1
            self.now = self.now._replace(region=self.regions)
            if self.stack:
                self.stack[-1] = self.now

    def handle_data(self, data: str) -> None:
        if not (self.now.silent or self.now.boilerplate):
            self.text.append(data)
            if not self.now.link:
                self.free += len(data.strip())

    def parse_html_declaration(self, i: int) -> int:
        """A marked section is a comment up to the next >, as in browsers; the library stops at names it doesn't know."""
        if self.rawdata.startswith("<![", i):
            end = self.rawdata.find(">", i + 3)
            return end + 1 or -1
        return super().parse_html_declaration(i)

    def close(self) -> None:
        super().close()
        self._line()


def _smoothed(values: list[float]) -> list[float]:
    weights = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        near = [(w, values[j]) for w, j in zip(weights, range(i - RADIUS, i + RADIUS + 1), strict=True) if 0 <= j < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def _threshold(values: list[float]) -> float:
    """Between the two clusters of the values; the least value if they are all alike."""
    low, high = min(values, default=0.0), max(values, default=0.0)
    if high - low < 1e-9:
        return low
    for _ in range(30):
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The blocks of the page's content regions, joined by line feeds."""
    if not html:
        return ""
    # A tag that the end of the page cuts off is no text. Without it, no < is tried again and again for want of a >.
    end = html.rfind(">") + 1
    if cut := _TAG.search(html, end):
        html = html[: cut.start()]
    parser = _Lines()
    parser.feed(html)
    parser.close()
    # Boilerplate's articles count only where there is nothing else.
    lines = [x for x in parser.lines if not x.spare] or parser.lines
    if not lines:
        return ""
    ratios = [math.log1p(x.free / max(1, x.tags)) for x in lines]
    own: dict[int, int] = {}
    for x in lines:
        own[x.article] = own.get(x.article, 0) + x.free
    outside = own.pop(0, 0)
    best = max(own, key=lambda a: (own[a], -a), default=0)
    if best and outside <= 2 * sum(own.values()):
        chosen = _parts(best, own, parser)
        lines, ratios = _without_doubt([(x, r) for x, r in zip(lines, ratios, strict=True) if x.article in chosen])
        smooth = _smoothed(ratios)
        limit = _threshold(smooth)
        return "\n".join(x.text for x, value in zip(lines, smooth, strict=True) if 2 * x.free >= len(x.text) or value >= limit)
    smooth = _smoothed(ratios)
    limit = _threshold(smooth)
    content = {x.region for x, *values in zip(lines, smooth, ratios, strict=True) if max(values) >= limit}
    return "\n".join(x.text for x in lines if x.region in content)


def _parts(best: int, own: dict[int, int], parser: _Lines) -> set[int]:
    """The main article and those around it; and all articles within an article that holds less itself than they do."""
    inner: dict[int, list[int]] = {}
    for a, outer in parser.around.items():
        inner.setdefault(outer, []).append(a)
    within = dict(own)
    for a in sorted(parser.around, reverse=True):  # inner ones have larger numbers
        within[a] = within.get(a, 0)
        if outer := parser.around[a]:
            within[outer] = within.get(outer, 0) + within[a]
    chosen: set[int] = set()
    whole: set[int] = set()  # articles whose inner ones are all chosen
    a = best
    while a:
        chosen.add(a)
        wanted = [a] if a not in parser.mains and 2 * own.get(a, 0) < within[a] else []
        while wanted:
            if (b := wanted.pop()) not in whole:
                whole.add(b)
                chosen.update(inner.get(b, []))
                wanted += inner.get(b, [])
        a = parser.around[a]
    return chosen


def _without_doubt(rows: list[tuple[_Line, float]]) -> tuple[list[_Line], list[float]]:
    """Lines without the elements in doubt whose ratio is below half the threshold of the others, or that are mostly links."""
    sure = [r for x, r in rows if not x.doubt]
    limit = _threshold(sure) / 2 if sure else 0.0
    sums: dict[int, list[int]] = {}
    for x, _ in rows:
        total = sums.setdefault(x.doubt, [0, 0, 0])
        for i, n in enumerate((x.free, x.tags, len(x.text))):
            total[i] += n
    bad = {d for d, (free, tags, size) in sums.items() if d and (2 * free < size or math.log1p(free / max(1, tags)) < limit)}
    kept = [(x, r) for x, r in rows if x.doubt not in bad]
    return [x for x, _ in kept], [r for _, r in kept]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every whole page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return only(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")

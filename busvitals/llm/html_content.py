"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive, tags negative; how much is learned from labelled
pages. One linear scan finds the contiguous stretch with the greatest sum, which is where the article is. Inside the
stretch, elements that are never article text (menus, forms, adverts, comments ...) are left out. A tag or role says so for
certain; a name in a class or id only lowers an element's score: it is left out unless it still outweighs the rest of the page.
Some tags are less than certain: forms are also put around whole pages, and a menu or header whose end is missing takes in what
follows. They, too, give way to a ``main`` in them, and to running text that outweighs the rest. What is hidden gives way only to a
``main`` in it (pages are hidden from readers while a dialog is open).

Labelled pages are those whose author marked the main text with ``article`` or ``main``: what lies inside is content,
everything else is not. A word's weight is the log-odds of content for the block element it stands in (apart for
links), a tag's the log-odds of its name, kept below zero. The fit uses a bounded number of labelled pages
(about ``FIT_PAGES``, chosen by hash); the weights then go to every page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.llm.arrow import batched

FIT_PAGES = 2_000
#: Elements whose text is never shown as an article's, elements that end a line of text, and words in class
#: and id attributes that name menus, adverts, notices and the like.
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp".split())
OUTSIDE = frozenset("head nav header footer aside form button select menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NESTING = frozenset(
    "article aside blockquote body center details dialog div dl fieldset figure footer form head header html main menu nav ol "
    "section select button table td th tr ul".split())
NAMES_OUTSIDE = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie "
    "cookies consent notice notices gdpr alert nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar sidebar rail "
    "widget widgets related recommended recommendations trending share sharing social subscribe subscription newsletter signup "
    "login comment comments commentlist discussion disqus respond replies reply footer foot copyright legal header masthead pagination "
    "pager form search skip".split())
ROLES_OUTSIDE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKED = ("article", "main")
LISTED = frozenset("w:li w:ul w:ol w:menu w:dt w:dd".split())
WHOLE = frozenset("html body main article".split())  # a name never puts these, or what is around them, outside
DOUBTED = frozenset("form fieldset".split())  # always, and these where one of the page has no end
MAY_LACK_END = frozenset("nav header".split())
#: What is left of the score of an element whose class or id names a menu, advert and the like, and of a doubted one.
NAMED_SHARE, DOUBTED_SHARE, NAMED_COST = 0.5, 0.25, 5.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)|([^<]+|<)",
    re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I | re.S)
_NAME = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

WORD_DEFAULT, WORD_LEAST, WORD_MOST = 0.5, -3.0, 3.0
TAG_DEFAULT, TAG_LEAST, TAG_MOST = -0.3, -6.0, -0.05
#: Tags of running text cost least while nothing is learned about them.
TEXT_TAGS = frozenset("p b i em strong span br h1 h2 h3 h4 h5 h6 blockquote pre code sup sub".split())
OUTSIDE_COST, OUTSIDE_MOST = -0.2, -2.0

TEXTS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType()),
])
COUNTS = T.StructType([
    T.StructField("token", T.StringType()), T.StructField("inside", T.LongType()), T.StructField("outside", T.LongType()),
])


CERTAIN, HIDDEN, DOUBT, NAMED = 4, 3, 2, 1


def _says_outside(attributes: str) -> int:
    """Do role (``CERTAIN``), a hidden state (``HIDDEN``), or class or id (``NAMED``) say that the element is not article text?"""
    said = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            said = HIDDEN
        elif key == "role":
            if value.lower() in ROLES_OUTSIDE:
                return CERTAIN
        elif key in ("class", "id"):
            names = _NAME.findall(_CAMEL.sub("-", value))
            if any(n.lower() in NAMES_OUTSIDE for n in names):
                said = max(said, NAMED)
    return said


class _Page:
    """A page's tokens (kind, text, words, certainly outside, marked, innermost named element or -1), and its named elements
    (or doubted or hidden ones): why, which one is around each, and whether it counts as any other element."""

    def __init__(self, page: str) -> None:
        self.why: list[int] = []
        self.around: list[int] = []
        self.hidden: list[bool] = []  # the element or one around it is hidden
        self.free: list[bool] = []
        self.plain_article = False  # has an article that no name is on or around
        self.named_articles: list[int] = []
        self.tokens = list(self._read(page))
        # next to a plain article, named ones may be comments
        for number in [] if self.plain_article else self.named_articles:
            self.release(number)

    def release(self, number: int) -> None:
        while number >= 0 and not self.free[number]:
            self.free[number] = True
            number = self.around[number]

    def _name(self, around: int, why: int = NAMED) -> int:
        self.why.append(why)
        self.around.append(around)
        self.hidden.append(why == HIDDEN or around >= 0 and self.hidden[around])
        self.free.append(False)
        return len(self.free) - 1

    def outside(self) -> list[bool]:
        """Of each named element, and last of -1: is it or one around it left out?"""
        out: list[bool] = []
        for around, free in zip(self.around, self.free):
            out.append(not free or around >= 0 and out[around])
        return [*out, False]

    def resolved(self) -> Iterator[tuple[str, str, int, bool, bool]]:
        out = self.outside()
        for kind, text, words, certain, marked, number in self.tokens:
            yield kind, text, words, certain or out[number], marked

    def _read(self, page: str) -> Iterator[tuple[str, str, int, bool, bool, int]]:
        stack: list[tuple[str, bool, bool, int]] = []  # name, certainly outside, marked, named element
        open_: Counter = Counter()  # names in the stack
        endless: dict[str, bool] = {}  # has the page more starts than ends of it?

        def close(name: str) -> None:
            while open_[name]:
                last = stack.pop()[0]
                open_[last] -= 1
                if last == name:
                    return

        def lacks_end(name: str) -> bool:
            if name not in endless:
                ends = [m[1] for m in re.finditer(rf"<(/?){name}(?=[\s/>])", page, re.I)]
                endless[name] = 2 * ends.count("/") < len(ends)
            return endless[name]

        block, link, paragraph = "", 0, -1
        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.match(page, at)
            if m is None:
                return
            at = m.end()
            outside, marked, number = stack[-1][1:] if stack else (False, False, -1)
            if m[7] is not None:
                parts = [m[7]]
                while at < end and (n := _TOKEN.match(page, at)) and n[7] is not None:  # a lone "<" belongs to the text
                    parts.append(n[7])
                    at = n.end()
                text = "".join(parts)
                yield f"w:{block}+a" if link else f"w:{block}", text, len(text.split()), outside, marked, paragraph if paragraph >= 0 else number
                continue
            closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name in RAW and not closing:
                closed = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = closed.end() if closed else end
                yield "t:" + name, "", 0, outside, marked, number
                continue
            inner = number
            if name == "a":
                link = 0 if closing else 1
            elif name in NESTING:
                if closing:
                    close(name)
                else:
                    if name in ("main", "article", "section"):  # a menu or header without end ends here
                        for other in MAY_LACK_END:
                            while open_[other] and (name == "main" or lacks_end(other)):
                                close(other)
                        outside, marked, number = stack[-1][1:] if stack else (False, False, -1)
                        inner = number
                    said = _says_outside(rest) if rest and name not in ("html", "body", "main") else 0
                    if name in OUTSIDE:
                        doubted = name in DOUBTED or name in MAY_LACK_END and lacks_end(name)
                        said = max(said, DOUBT if doubted else CERTAIN)
                    if 0 < said < CERTAIN:
                        inner = self._name(number, said)
                    certain = outside or said == CERTAIN
                    if name == "article" and not certain:
                        if inner < 0:
                            self.plain_article = True
                        elif not self.hidden[inner]:
                            self.named_articles.append(inner)
                    elif name in WHOLE and not certain:
                        self.release(number)
                    stack.append((name, certain, marked or name in MARKED, inner))
                    open_[name] += 1
                block, link, paragraph = stack[-1][0] if stack else "", 0, -1
            elif name in BLOCKS and name != "br":
                block, paragraph = (stack[-1][0] if stack else "") if closing else name, -1
                if not closing and name == "p" and rest and (said := _says_outside(rest)):
                    if said >= HIDDEN:
                        block = "p.outside"
                    else:
                        paragraph = self._name(number)
            yield "t:" + name, "", 0, outside or bool(stack and stack[-1][1]), marked, inner


def page_tokens(page: str) -> Iterator[tuple[str, str, int, bool, bool]]:
    """Tokens of a page: (kind, text, words, outside, marked).

    Kind is ``t:name`` for a tag and ``w:block`` or ``w:block+a`` for a run of text; ``outside`` is true within elements that
    are never article text or are named so, ``marked`` within the author's own ``article`` or ``main``. Elements left open end
    where an element around them ends.
    """
    yield from _Page(page).resolved()


def token_counts(page: str) -> Counter:
    """(kind, inside the marked text) -> how often, for a page whose author marked it; empty for others."""
    # what stands in elements that are left out anyway says nothing, except that lists of links are menus
    found = [(k, w, marked and not outside) for k, _, w, outside, marked in page_tokens(page)
             if not outside or k.endswith("+a") or k in ("t:a", "t:li", "t:ul")]
    if not any(inside for _, _, inside in found):
        return Counter()
    total: Counter = Counter()
    for kind, words, inside in found:
        total[kind, inside] += words if kind[0] == "w" else 1
    return total


def _step(kind: str, words: int, weights: dict[str, float]) -> float:
    if kind[0] == "w":
        return words * weights.get(kind, WORD_DEFAULT)
    return weights.get(kind, TAG_MOST if kind[2:] in TEXT_TAGS else TAG_DEFAULT)


def _best_stretch(page: _Page, weights: dict[str, float]) -> tuple[list[tuple[str, str]], float]:
    """The tokens (kind, text) of the stretch with the greatest sum, and the sum."""
    pieces: list[tuple[str, str]] = []
    best, best_from, best_to = 0.0, 0, 0
    total, begin, cost = 0.0, 0, 0.0
    for kind, text, words, outside, _ in page.resolved():
        if outside or kind == "w:p.outside":
            step = max(OUTSIDE_COST * max(words, 1), OUTSIDE_MOST - cost)  # an element inside an article must not break it in two
            cost += step
            pieces.append((kind, "" if kind[0] == "w" else text))
        else:
            cost = 0.0
            step = _step(kind, words, weights)
            pieces.append((kind, text))
        total += step
        if total <= 0:
            total, begin = 0.0, len(pieces)
        elif total > best:
            best, best_from, best_to = total, begin, len(pieces)
    return pieces[best_from:best_to], best


def main_text(page: str | None, weights: dict[str, float]) -> tuple[str, float]:
    """The main text of a page and the score of its stretch."""
    read = _Page(page or "")
    pieces, best = _best_stretch(read, weights)
    if not all(read.free):  # does a named or doubted element outweigh the rest even with its score lowered?
        own = [0.0] * len(read.free)
        for kind, _, words, certain, _, number in read.tokens:
            if number < 0 or certain or kind == "w:p.outside":
                continue
            if read.why[number] != DOUBT:
                own[number] += NAMED_SHARE * _step(kind, words, weights)
            elif kind not in LISTED and not kind.endswith("+a"):  # running text, not entries of a menu
                own[number] += DOUBTED_SHARE * _step(kind, words, weights)
        heavy = [k for k, score in enumerate(own) if not read.free[k] and not read.hidden[k] and score - NAMED_COST > best]
        for k in heavy:
            read.release(k)
        if heavy:
            pieces, best = _best_stretch(read, weights)
    out = [html.unescape(text) if kind[0] == "w" else " " * (kind[2:] in BLOCKS) for kind, text in pieces]
    return " ".join("".join(out).split()), best


def fit_weights(pages: DataFrame, html_col: str = "html", most_pages: int = FIT_PAGES) -> dict[str, float]:
    """Weights of words and tags from about ``most_pages`` labelled pages, or fewer; empty (defaults apply) if there are none.

    What comes to the driver is one row per kind of token, of which there are as many as block and tag names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                total.update(token_counts(page.as_py()))
        kinds = {k for k, _ in total}
        known = [k for k in kinds if k.split(":")[1].split("+")[0].split(".")[0] in BLOCKS | {"", "a", "b", "i", "em", "strong", "span", "img"}]
        yield from batched(((k, total[k, True], total[k, False]) for k in sorted(known)), COUNTS)

    total = pages.count()  # from the files' own counts
    marked = pages.select(html_col).where(F.lower(html_col).rlike("<(article|main)[ >]"))
    fit = marked.where(F.pmod(F.xxhash64(html_col), F.lit(1_000_000)) < min(1_000_000, int(1_000_000 * most_pages / max(total, 1))))
    rows = fit.mapInArrow(count, COUNTS).groupBy("token").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    weights = {}
    for kind in ("w", "t"):
        own = [r for r in rows if r["token"][0] == kind]
        all_in, all_out = sum(r["i"] for r in own) + 1, sum(r["o"] for r in own) + 1
        least, most = (WORD_LEAST, WORD_MOST) if kind == "w" else (TAG_LEAST, TAG_MOST)
        for r in own:
            odds = math.log((r["i"] + 0.5) / all_in) - math.log((r["o"] + 0.5) / all_out)
            weights[r["token"]] = min(most, max(least, odds))
    return weights


def extract(
    pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars`` (code points) and the stretch's ``score``.

    Null and empty pages have an empty text; a page without tags is text as a whole; null ids and urls stay null; repeated
    rows are read each; other columns are not read; an empty table gives an empty result. Whole pages, however long, in one
    narrow pass; the weights are a few hundred numbers. Without ``weights`` they are fitted on ``pages``.
    """
    weights = fit_weights(pages, html_col) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for page, url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    text, score = main_text(source.as_py(), weights)
                    yield page, url, text, len(text), score

        yield from batched(rows(), TEXTS, lambda r: len(r[2]) + 64)

    slim = pages.select(
        F.col(id_col).cast("bigint").alias("i"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h"))
    return slim.mapInArrow(run, TEXTS)

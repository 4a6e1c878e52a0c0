"""Main text of web pages: the contiguous run of words and tags with the largest score.

A page becomes a sequence of words and tags. Words score positive, tags negative; the weights come from labelled pages
as log odds of standing inside the main text, words set to 1. One linear scan keeps the best run so far (Kadane).
Elements that are never main text by what they are (menus, footers, forms, scripts ...) score only their tags, and
their words never reach the output even inside the run. The same holds for elements that a whole class, id or role
names as such (``ad``, ``site-footer``, ``comment-list``): every part of the name must be a word for such matter or for
a container, so ``has-sidebar`` or ``comments-open`` name nothing. An element that holds an article or main element, or
more than half of the page's words, is never taken for noise by its name; the scan decides on it.

Defined results: null, empty and tagless-wordless html give the empty text; a page whose tags outweigh all words gives
the empty text too; broken markup is read as browsers do: a close tag closes what is open inside it, an unfinished tag
at the end is dropped; repeated rows agree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.common import batch_of, slices

LEARN_PAGES = 400

#: Elements of the HTML vocabulary by what they are for.
NOISE = set("head script style noscript template iframe object svg canvas audio video nav footer aside form button select option textarea input label dialog menu".split())
RAW = set("script style noscript template iframe textarea title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"html", "body"}
NOISE_CLASS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side rail widget widgets related recommended trending share sharing social footer masthead topbar toolbar comment comments commentlist respond disqus discussion replies copyright skip hidden".split())
#: Weights before any page is seen, as counts inside and outside the main text.
PRIOR = {**{t: (20, 2) for t in "p b i em strong br h1 h2 h3 h4 h5 h6 blockquote pre code q sub sup span article section ul ol li a img figure figcaption table tr td th tbody thead".split()}, **{t: (1, 20) for t in NOISE}}
TAG_FLOOR, TAG_TOP = -8.0, -0.05

#: Words that only say where or what kind of box, beside a word for noise in one name.
BOX_WORDS = set("list box container wrapper wrap block section area inner outer bar item items post posts site page top bottom left right primary secondary slot unit link links thread group panel zone".split())

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>|[^>]*\Z)""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def named_noise(name: str, attrs: str) -> bool:
    """A whole class, id or role says that the element is no main text."""
    if len(attrs) < 4 or name in ("body", "html", "main"):
        return False
    for m in _NAMES.finditer(attrs):
        for token in m[1].strip("\"'").lower().split():
            parts = [p for p in re.split(r"[-_\d]+", token) if p]
            if any(p in NOISE_CLASS for p in parts) and all(p in NOISE_CLASS or p in BOX_WORDS for p in parts):
                return True
    return False


class Piece:
    """A stretch of text or one tag: its tag, text, noise, whether a block ends before it."""

    __slots__ = ("tag", "text", "noise", "cut")

    def __init__(self, tag: str, text: str, noise: bool, cut: bool):
        self.tag, self.text, self.noise, self.cut = tag, text, noise, cut

    @property
    def kind(self) -> str:
        """The tag, with ! before it where it is noise; empty for text."""
        return "!" + self.tag if self.noise and self.tag else self.tag


class Named:
    """An element that its name calls noise: the range of its pieces, and whether it holds the main text's own element."""

    __slots__ = ("start", "end", "holds")

    def __init__(self, start: int):
        self.start, self.end, self.holds = start, start, False


class _Page:
    """The pieces of a page and its open elements."""

    def __init__(self):
        self.pieces: list[Piece] = []
        self.open: list[tuple[str, bool, Named | None]] = []
        self.noise = 0  # open elements that are noise by what they are
        self.named: list[Named] = []

    def add(self, tag: str, text: str, cut: bool, noise: bool = False) -> None:
        self.pieces.append(Piece(tag, text, noise or self.noise > 0, cut))

    def enter(self, name: str, bad: bool, named: bool) -> None:
        if name in ("article", "main"):
            for _, _, n in self.open:
                if n:
                    n.holds = True
        mark = Named(len(self.pieces) - 1) if named else None
        if mark:
            self.named.append(mark)
        self.open.append((name, bad, mark))
        self.noise += bad

    def leave(self, to: int, count_last: bool = False) -> None:
        """Closes the elements from ``to`` on; the close tag, if one was added, is inside them."""
        for _, bad, mark in self.open[to:]:
            self.noise -= bad
            if mark:
                mark.end = len(self.pieces) + count_last
        del self.open[to:]

    def settle(self) -> list[Piece]:
        """Marks the named elements that are neither the page's bulk nor around its article."""
        self.leave(0)
        words = [len(p.text.split()) if not p.tag and not p.noise else 0 for p in self.pieces]
        sums = np.concatenate([[0], np.cumsum(words)]) if words else np.zeros(1, int)
        for n in self.named:
            if not n.holds and 2 * (sums[n.end] - sums[n.start]) <= sums[-1]:
                for p in self.pieces[n.start : n.end]:
                    p.noise = True
        return self.pieces


def pieces(html: str) -> list[Piece]:
    page = _Page()
    at, cut = 0, True
    while at < len(html):
        m = _TAG.search(html, at)
        if not m:
            break
        if m.start() > at:
            page.add("", html[at : m.start()], cut)
            cut = False
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[0][-1] != ">":
            return page.settle()
        if name in BLOCK or name == "title":
            cut = True
        if m[1]:
            found = next((k for k in range(len(page.open) - 1, -1, -1) if page.open[k][0] == name), None)
            inside = page.noise > 0
            if found is not None:
                page.leave(found, True)
            page.add("/" + name, "", cut, inside)
            continue
        if name in ENDS_P:
            for k in range(len(page.open) - 1, -1, -1):
                if page.open[k][0] == "p":
                    page.leave(k)
                    break
                if page.open[k][0] in ("div", "article", "section", "td", "th", "li", "blockquote", "button", "body", "main", "aside", "nav", "form", "footer"):
                    break
        bad = name in NOISE or (name == "header" and not any(n in ("article", "main", "section") for n, _, _ in page.open))
        page.add(name, "\n" if name == "br" else "", cut, bad)
        if name in VOID or m[3].endswith("/>") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        page.enter(name, bad, not bad and named_noise(name, m[3]))
    if at < len(html):
        page.add("", html[at:], cut)
    return page.settle()


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run with the largest positive sum, the first of equals; (0, 0) without one."""
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0 < s:
            run, start = 0.0, i
        run += s
        if run > best:
            best, best_at = run, (start, i + 1)
    return best_at


def main_text(html: str, weights: dict[str, float]) -> str:
    """The best run's blocks, joined by line ends."""
    list_ = pieces(html)
    other = {False: weights["?"], True: weights["!?"]}
    lo, hi = best_run([weights.get(p.kind, other[p.noise]) if p.tag else 0.0 if p.noise else float(len(p.text.split())) for p in list_])
    blocks, now = [], []
    for p in list_[lo:hi]:
        if p.cut and now:
            blocks.append("".join(now))
            now = []
        if p.text and not p.noise:
            now.append(unescape(p.text))
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def default_weights(inside: Counter | None = None, outside: Counter | None = None) -> dict[str, float]:
    """Log odds of each tag from its counts inside and outside of main texts, a word being 1."""
    inside, outside = Counter(inside or {}), Counter(outside or {})
    for t, (a, b) in PRIOR.items():
        for k in ("!" + t, "!/" + t) if t in NOISE else (t, "/" + t):
            inside[k] += a
            outside[k] += b
    out = {k: float(np.clip(np.log((inside[k] + 0.5) / (outside[k] + 0.5)), TAG_FLOOR, TAG_TOP)) for k in {*inside, *outside}}
    out |= {"?": -0.5, "!?": -3.0}
    return out


def count_tags(html: str, text: str) -> tuple[Counter, Counter]:
    """Tags inside and outside of the main text of a labelled page: between its first and its last words or outside."""
    found = [(p, set(unescape(p.text).split())) for p in pieces(html)]
    words = set(text.split())
    hit = [i for i, (p, w) in enumerate(found) if w and not p.noise and w <= words]
    lo, hi = (hit[0], hit[-1]) if hit else (len(found), -1)
    inside, outside = Counter(), Counter()
    for i, (p, _) in enumerate(found):
        if p.tag:
            (inside if lo < i < hi else outside)[p.kind] += 1
    return inside, outside


def learn(labelled: DataFrame) -> dict[str, float]:
    """Weights from labelled pages (html, text): one row a kind of tag reaches the driver."""
    schema = pa.schema([("kind", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for html, text in zip(batch.column("html").to_pylist(), batch.column("text").to_pylist()):
                a, b = count_tags(html or "", text or "")
                inside += a
                outside += b
        kinds = sorted({*inside, *outside})
        yield batch_of({"kind": kinds, "inside": [inside[k] for k in kinds], "outside": [outside[k] for k in kinds]}, schema)

    rows = labelled.select("html", "text").mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    return default_weights(Counter({r["kind"]: r["i"] for r in rows}), Counter({r["kind"]: r["o"] for r in rows}))


def self_labelled(pages: DataFrame, limit: int = LEARN_PAGES) -> DataFrame:
    """(html, text) of at most ``limit`` pages that mark their own main text with one article element."""
    body = F.regexp_extract("html", r"(?s)<article[^>]*>(.*?)</article>", 1)
    one = F.regexp_count("html", F.lit(r"<article[\s>]")) == 1
    text = F.regexp_replace(body, r"<[^>]*>", " ")
    return pages.select("page_id", "html").where(one).orderBy(F.md5(F.concat(F.lit("page|"), F.col("page_id").cast("string")).cast("binary")), "html").limit(limit).select("html", text.alias("text"))


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    weights = weights or default_weights()
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8_000_000, "html"):
            texts = [main_text(h or "", weights) for h in batch.column("html").to_pylist()]
            yield batch_of({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}, schema)

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")

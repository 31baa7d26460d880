"""Main text of web pages: flat text blocks classified by a decision tree.

One pass over the markup gives a page's text blocks in order.  A block is
described by its words, the share of them inside links, the same of the blocks
before and after it, and where it stands: inside an article, a heading, an
element for navigation, a comment section, or a *marked* element - a form, or one
named like an advert, a notice or a sidebar.  A mark alone decides nothing: a
block has the share of the page's text that its smallest marked element holds,
0 where one of them holds nothing that a page is built of (its title, an article,
menus), since names of adverts and sidebars are also given to the frame around
everything.  A decision tree grown from the labelled pages
of ``page_examples`` tells article blocks from the rest.

One pass over the pages, no shuffle; the tree is grown on the driver from the
bounded examples and sent along.

Cases: null html is an empty page; a page without article blocks has empty text;
broken markup - open comments, tags, quotes, unknown elements - is read on as
browsers do; a page of any length is read whole; repeated rows give repeated
results; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import html as markup
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .page_examples import PAGES

# Elements by what they do to text.
RAW = frozenset("script style noscript template title iframe noembed noframes xmp textarea object svg math canvas "
                "audio video select datalist button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var img input wbr br nobr".split())
ASIDE = frozenset("nav footer aside menu dialog fieldset head".split())
#: Elements that a page is built of, besides its title.
FRAME = frozenset("h1 main article nav header footer".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
          "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
          "option": ("option", ("select",))}
#: Words in class, id and role that name something beside the article, whatever stands with them in a name.
BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted cookie cookies consent "
    "gdpr popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "widget toolbar pagination pager contentinfo paywall teaser outbrain taboola".split())
#: Words that do so alone or with words of layout, but are also what an article may be about.
PERHAPS = frozenset(
    "promotion banner notice notices alert overlay subscription signup login share sharing social related recommended "
    "recommendations trending header tags search skip disclaimer copyright complementary form dialog".split())
REPLIES = frozenset("comment comments reply replies respond disqus discussion".split())
#: Words of layout.
LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons container content footer group heading holder icon icons inner "
    "item items label link links list main module outer panel posts row section site slot text thread title top unit "
    "user wrap wrapper form post article entry story stories articles count".split())
ARTICLE = frozenset("article post entry story".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL)
_NAMED = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
#: A name that shows an element on some screens which another hides.
_SHOWN = re.compile(r":(?:block|flex|grid|inline|table|contents)")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    aside: bool
    replies: bool
    article: bool
    heading: bool
    mark: int
    share: float = 1.0


@lru_cache(maxsize=20_000)
def _naming(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element's names speak of something beside the article, replies, an article, or hide it."""
    beside = replies = article = hidden = False
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        else:
            for one in value.split():
                words = [w.lower() for w in _WORDS.findall(one)]
                if words and words[0] in ("has", "with", "no", "is", "js"):
                    continue
                found = set(words)
                article |= bool(words) and found <= ARTICLE | LAYOUT and bool(found & ARTICLE)
                plain = all(w in LAYOUT or w in BESIDE or w in PERHAPS or w in REPLIES or len(w) < 3 for w in found)
                replies |= plain and bool(found & REPLIES)
                perhaps = (found & PERHAPS) - ({"header"} if found & ARTICLE else set())
                beside |= bool(found & BESIDE) or plain and bool(perhaps) or one == "hidden" and not _SHOWN.search(value)
    return beside, replies, article, hidden


class _Walk:
    """Text blocks of one page, gathered while its tags are read in order."""

    def __init__(self):
        # an open element: name, and (aside, replies, article, heading, mark, link) from there inwards
        self.open: list[tuple[str, tuple]] = [("", (False, False, False, False, -1, False))]
        self.parts: list[tuple[str, bool]] = []
        self.state = self.open[0][1][:5]
        self.blocks: list[Block] = []
        # marked elements: the one around it, and blocks and elements of a frame before and up to its end
        self.marks: list[tuple[int, int, int]] = []
        self.ends: dict[int, tuple[int, int]] = {}
        self.frames = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(t for t, _ in self.parts).split())
            if text:
                linked = sum(len(t.split()) for t, link in self.parts if link)
                words = text.count(" ") + 1
                self.blocks.append(Block(text, words, min(linked, words), *self.state))
            self.parts = []

    def text(self, raw: str) -> None:
        if not raw:
            return
        flags = self.open[-1][1]
        if not self.parts:
            if raw.isspace():
                return
            self.state = flags[:5]
        self.parts.append((markup.unescape(raw), flags[5]))

    def _leave(self, at: int) -> None:
        """Close the open elements from ``at`` on."""
        outer, mark = self.open[at - 1][1][4], self.open[-1][1][4]
        while mark != outer:
            self.ends[mark] = len(self.blocks), self.frames
            mark = self.marks[mark][0]
        del self.open[at:]

    def close(self, name: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == name:
                self._leave(at)
                return
            if name in INLINE and self.open[at][0] not in INLINE:
                return

    def _implied(self, name: str) -> None:
        """Close what the start of an element closes: a paragraph, or the list item, cell or row before."""
        ends, within = CLOSES.get(name, ("", ()))
        ends = set(ends.split())
        for at in range(len(self.open) - 1, 0, -1):
            own = self.open[at][0]
            if own in within:
                return
            if own in ends or own == "p":
                self._leave(at)
                if own in ends and name != "tr":
                    return
            elif own not in INLINE and not ends:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in INLINE:
            flags = self.open[-1][1]
            if name == "a":
                self.close("a")
                flags = (*self.open[-1][1][:5], True)
            self.open.append((name, flags))
            return
        self._implied(name)
        aside, replies, article, heading, mark, link = self.open[-1][1]
        if name not in ("html", "body"):
            beside, names_replies, names_article, hidden = _naming(attributes) if attributes.strip() else (False,) * 4
            aside |= name in ASIDE or hidden or name == "header" and not article
            replies |= names_replies
            if name in ("main", "article"):
                beside, article = beside and name == "article", not replies
            if beside or name == "form":
                self.marks.append((mark, len(self.blocks), self.frames + (name == "article")))
                mark = len(self.marks) - 1
            self.frames += not replies and (name in FRAME or names_article and not beside)
        heading |= name in ("h1", "h2", "h3", "h4", "h5", "h6")
        self.open.append((name, (aside, replies, article, heading, mark, False)))

    def weigh(self) -> None:
        """Give every block the share of the page's text in the smallest marked element around it, 0 if one holds no frame."""
        plain = np.array([0] + [0 if b.aside or b.replies else b.words - b.linked for b in self.blocks]).cumsum()
        known = [1.0]  # without a mark; a mark comes after the one around it
        for at, (outer, start, frames) in enumerate(self.marks):
            end, last = self.ends.get(at, (len(self.blocks), self.frames))
            share = (plain[end] - plain[start]) / max(1, plain[-1]) if last > frames else 0.0
            known.append(min(known[outer + 1], share))
        for b in self.blocks:
            b.share = known[b.mark + 1]


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    page, at, walk = page or "", 0, _Walk()
    while m := _TAG.search(page, at):
        if m.start() > at:
            walk.text(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name == "br":
            walk.text(" ")
            continue
        if name not in INLINE:
            walk.flush()
        if m[1]:
            walk.close(name)
        elif name in RAW:
            end = _end_of(name).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID:
            walk.start(name, m[3])
    walk.text(page[at:])
    walk.flush()
    walk.weigh()
    return walk.blocks


def features(found: list[Block]) -> np.ndarray:
    """A row per block: words and link density of it and its neighbours, and where it stands.

    A block has the share of the page's text that is in article elements: above 0 within one, else below.
    """
    n = len(found)
    own = np.zeros((n + 2, 2))
    own[1:-1, 0] = [b.words for b in found]
    own[1:-1, 1] = [b.linked / b.words for b in found]
    plain = np.array([0 if b.aside or b.replies or not b.share else b.words - b.linked for b in found], float)
    article = np.array([b.article for b in found], bool)
    taken = plain[article].sum() / max(1.0, plain.sum())
    place = np.array([(b.aside or b.replies, taken if b.article else -taken, b.heading, b.share) for b in found], float).reshape(n, 4)
    return np.hstack([own[1:-1], own[:-2], own[2:], place])


@dataclass
class Tree:
    """Decision tree as arrays: a node asks whether ``feature <= limit``; below 0, it answers."""
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    answer: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.answer[at]
            rows = np.flatnonzero(inner)
            node = at[rows]
            goes_left = x[rows, self.feature[node]] <= self.limit[node]
            at[rows] = np.where(goes_left, self.left[node], self.right[node])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> Tree:
    """A tree that splits where the labels mix least (Gini)."""
    nodes: list[list] = []

    def mix(labels: np.ndarray) -> float:
        share = labels.mean() if len(labels) else 0.0
        return 2 * share * (1 - share) * len(labels)

    def add(rows: np.ndarray, left_depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, bool(y[rows].mean() >= 0.5)])
        best = (mix(y[rows]) - 1e-9, None, None)
        if left_depth and 0 < y[rows].mean() < 1:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for limit in (values[:-1] + values[1:]) / 2:
                    low = x[rows, f] <= limit
                    if min(low.sum(), (~low).sum()) >= least:
                        cost = mix(y[rows[low]]) + mix(y[rows[~low]])
                        if cost < best[0] - 1e-12:
                            best = (cost, f, limit)
        if best[1] is not None:
            low = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = add(rows[low], left_depth - 1)
            nodes[me][3] = add(rows[~low], left_depth - 1)
        return me

    add(np.arange(len(y)), depth)
    f, limit, left, right, answer = zip(*nodes)
    return Tree(np.array(f), np.array(limit), np.array(left), np.array(right), np.array(answer, bool))


def trained(pages: list[str] = PAGES) -> Tree:
    """The tree of labelled pages, whose blocks start with + or -."""
    xs, ys = [], []
    for page in pages:
        found = blocks(page)
        xs.append(features(found))
        ys += [b.text[0] == "+" for b in found]
    return grow(np.vstack(xs), np.array(ys, float))


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The article blocks of each page, one to a line."""
    found = [blocks(p) for p in pages]
    sizes = np.array([len(f) for f in found])
    if not sizes.sum():
        return [""] * len(pages)
    keep = tree.predict(np.vstack([features(f) for f in found if f])).tolist()
    out, at = [], 0
    for f in found:
        out.append("\n".join(b.text for b, k in zip(f, keep[at:at + len(f)]) if k))
        at += len(f)
    return out


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(tree or trained())

    def run(batches):
        for b in batches:
            texts = main_texts(b.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")

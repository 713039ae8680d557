"""Main text of web pages: flat text blocks with word count and link density of their neighbours, and a decision tree.

A page becomes a list of blocks. A block's features are its words and link density, those of the blocks before and
after it, and what encloses it. A CART tree, trained here on labelled pages and pruned on others, says which blocks are
article text. One map over the table, without a shuffle; the work is linear in a page.

Tags and words in class, id or role mark boilerplate. A mark on an element that holds the article itself does not count:
one that encloses an ``article`` or ``main`` element or most of the page's words outside links.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.words import portions

#: Tags that end a block, tags whose content is never text, tags that are boilerplate by themselves, words
#: in class, id or role that mark boilerplate, those that mark readers' comments, and words that begin the name of a
#: state of the page ("has-sidebar") rather than of a box.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template title textarea select button iframe svg head canvas audio video datalist".split())
TRACKED = frozenset("article aside dialog div fieldset figure footer form header li main menu nav ol p section span table td tr ul".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_WORDS = frozenset("ad ads adv advert advertisement advertising adbox adslot sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer copyright related recommended share sharing social subscribe newsletter signup login search toolbar widget pagination pager skip contentinfo complementary".split())
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
STATE_WORDS = frozenset("has no not with without is".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "boiler", "article", "has_article")
#: The labelled table: words and link density in percent, from and to, of the kinds of blocks; of the parts of a page,
#: whether they are article text and the kinds that follow each other in them, with how many there are, from and to.
KINDS = {
    "menu": (1, 3, 90, 100), "label": (1, 5, 0, 0), "teaser": (4, 30, 55, 100), "notice": (3, 28, 0, 45), "headline": (1, 14, 0, 0), "paragraph": (16, 160, 0, 22),
    "short": (1, 15, 0, 12), "item": (1, 20, 0, 40), "reference": (4, 24, 45, 100), "remark": (4, 60, 0, 8),
}
PARTS = {
    "top": (0, [("label", 0, 2), ("menu", 3, 9), ("notice", 0, 2)]),
    "text": (1, [("headline", 1, 1), ("short", 0, 2), ("paragraph", 1, 4)]),
    "section": (1, [("headline", 0, 1), ("paragraph", 1, 5), ("item", 0, 5), ("paragraph", 0, 2), ("short", 0, 1)]),
    "note": (1, [("short", 1, 3)]),
    "references": (1, [("headline", 1, 1), ("reference", 2, 5)]),
    "box": (0, [("label", 1, 1), ("teaser", 2, 7), ("menu", 0, 4)]),
    "remarks": (0, [("label", 1, 1), ("label", 1, 1), ("remark", 1, 2), ("menu", 1, 2), ("label", 1, 1), ("remark", 1, 2), ("menu", 1, 2)]),
    "bottom": (0, [("menu", 1, 8), ("notice", 1, 3)]),
}
ORDERS = ("top text section box bottom", "top text section section box remarks bottom", "text section bottom", "top box text section bottom", "top text section references bottom", "top text bottom", "top text section remarks box bottom", "text", "section", "note", "top note bottom", "box note", "note remarks")


def labelled_blocks(seed: int, pages: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Rows of FEATURES and labels (1: article text) of the blocks of pages that are drawn from the labelled table.

    Half of the pages have an article element; of half of the others' boxes and of most of these pages' boxes it can be
    told by their marks that they are none. What only marks or an article element tell apart does not stand without them.
    """
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        has_article, found = rng.random() < 0.5, []
        marked = rng.random() < (0.8 if has_article else 0.5)
        for part in rng.choice(ORDERS).split():
            label, kinds = PARTS[part]
            if part in ("references", "note") and not has_article or part == "remarks" and not marked:
                continue
            inside = has_article and (label or part == "remarks")
            for kind, least, most in kinds:
                low, high, thin, dense = KINDS[kind]
                for _ in range(rng.randint(least, most)):
                    words = round(low * (high / low) ** rng.random())
                    share = thin if not thin and rng.random() < 0.6 else rng.uniform(thin, dense)  # most text has no links
                    found.append((words, 100.0 * round(words * share / 100) / words, marked and not label, inside, label))
        for i, (words, links, boiler, article, label) in enumerate(found):
            near = [x for k in (i - 1, i + 1) for x in (found[k][:2] if 0 <= k < len(found) else (0, 0.0))]
            rows.append([words, links, *near, boiler, article, has_article])
            labels.append(label)
    return np.array(rows, float), np.array(labels)


def train(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 4) -> tuple:
    """A CART tree by Gini impurity: (label, feature, threshold, left, right), or (label,) for a leaf; x <= threshold goes left."""
    n, ones = len(labels), int(labels.sum())
    majority = int(2 * ones >= n)
    if depth == 0 or ones in (0, n) or n < 2 * least:
        return (majority,)
    best = (2 * ones * (n - ones) / n - 1e-9, None, None)
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x, k, m = rows[order, f], np.cumsum(labels[order])[:-1], np.arange(1, n)
        impurity = 2 * k * (m - k) / m + 2 * (ones - k) * ((n - m) - (ones - k)) / (n - m)
        impurity[(x[1:] == x[:-1]) | (m < least) | (n - m < least)] = np.inf
        at = int(np.argmin(impurity))
        if impurity[at] < best[0]:
            best = (impurity[at], f, (x[at] + x[at + 1]) / 2)
    _, f, cut = best
    if f is None:
        return (majority,)
    left = rows[:, f] <= cut
    return (majority, f, float(cut), train(rows[left], labels[left], depth - 1, least), train(rows[~left], labels[~left], depth - 1, least))


def prune(node: tuple, rows: np.ndarray, labels: np.ndarray) -> tuple:
    """Without the branches that are not better on these rows, which the tree was not trained on, than a leaf in their place."""
    if len(node) == 1:
        return node
    left = rows[:, node[1]] <= node[2]
    node = (*node[:3], prune(node[3], rows[left], labels[left]), prune(node[4], rows[~left], labels[~left]))
    wrong = sum(classify(node, r) != y for r, y in zip(rows, labels))
    return (node[0],) if int((labels != node[0]).sum()) <= wrong else node


@cache
def tree() -> tuple:
    return prune(train(*labelled_blocks(1)), *labelled_blocks(2, 100))


def classify(node: tuple, row: list[float]) -> int:
    while len(node) > 1:
        node = node[3] if row[node[1]] <= node[2] else node[4]
    return node[0]


_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_STRICT_END = re.compile(r"(?>[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_MARKS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=>/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_LINK = re.compile(r"\bhref\b", re.I)
#: Of unlinked words, the share and the least number that a marked element must hold for its mark not to count.
MOST, MOST_WORDS = 0.5, 60
#: The share of unlinked words that article elements must hold for a page to count as one that has them.
SOME = 0.2


def _marked(attributes: str) -> str:
    """How attributes mark an element: "hidden", "comments", "box" or not ("")."""
    if "=" not in attributes and "hidden" not in attributes:
        return ""
    words = set()
    for m in _MARKS.finditer(attributes):
        for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[1] or m[2] or m[3] or "").lower().split():
            parts = re.split(r"[^a-z]+", name)
            if parts[0] not in STATE_WORDS:
                words.update(parts)
    if _HIDDEN.search(attributes):
        return "hidden"
    return "comments" if words & COMMENT_WORDS else "box" if words & BOILER_WORDS else ""


class _Element(NamedTuple):
    tag: str
    marks: tuple[int, ...]  # of it and around it
    article: bool  # it is one or within one


class Block(NamedTuple):
    text: str
    words: int
    links: int  # words in links
    marks: tuple[int, ...]
    article: bool


def _flat(page: str) -> tuple[list[Block], list[list]]:
    """The blocks that have text, in page order, and the marked elements: [tag, mark, encloses an article]."""
    found: list[Block] = []
    marks: list[list] = []
    stack: list[_Element] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    outside = _Element("", (), False)
    links, at, n, loose = False, 0, len(page), False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1] if stack else outside
                words = text.count(" ") + 1
                found.append(Block(text, words, min(words, len(html.unescape(" ".join(linked)).split())), top.marks, top.article))
        parts.clear()
        linked.clear()

    def add(chunk: str) -> None:
        parts.append(chunk)
        if links:
            linked.append(chunk)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _NAME.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = lt + 1
            continue
        gt = None if loose else _STRICT_END.match(page, m.end())
        if gt:
            end = gt.end()
        else:
            loose = True  # a quote never closes: from here on a tag ends at the next >
            end = page.find(">", m.end()) + 1 or n
        tag, closing, attributes = m[1].lower(), page[lt + 1] == "/", page[m.end() : end]
        at = end
        if tag in RAW and not closing and not attributes.endswith("/>"):
            if tag == "head":
                continue
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = page.find(">", close.start()) if close else -1
            at = n if not close or stop < 0 else stop + 1
            continue
        if tag in BLOCK:
            flush()
        elif tag in ("br", "wbr", "img"):
            add(" " if tag == "br" else "")
        if tag == "a":
            links = not closing and bool(_LINK.search(attributes))
        if tag not in TRACKED or attributes.endswith("/>") or tag in VOID:
            continue
        if closing:
            if not opened[tag]:
                continue
            if tag == "span" and stack[-1].tag == "span" and stack[-1].marks != (stack[-2] if len(stack) > 1 else outside).marks:
                flush()
            while True:
                gone = stack.pop()
                opened[gone.tag] -= 1
                if gone.tag == tag:
                    break
            continue
        if tag == "p" and stack and stack[-1].tag == "p":
            stack.pop()
            opened["p"] -= 1
        top = stack[-1] if stack else outside
        own = tag in ("article", "main")
        if own and not top.article:
            for k in top.marks:
                marks[k][2] = True
        mark = _marked(attributes) or ("tag" if tag in BOILER_TAGS or tag == "header" and not top.article else "")
        if mark:
            if tag == "span":
                flush()
            marks.append([tag, mark, False])
        stack.append(_Element(tag, (*top.marks, len(marks) - 1) if mark and len(top.marks) < 8 else top.marks, top.article or own))
        opened[tag] += 1
    flush()
    return found, marks


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, link words, in boilerplate, in an article) of each block that has text, in page order."""
    found, marks = _flat(page)
    plain = sum(b.words - b.links for b in found)
    within: Counter[int] = Counter()
    for b in found:
        for k in b.marks:
            within[k] += b.words - b.links
    large = lambda k: within[k] >= MOST_WORDS and within[k] >= MOST * plain
    counts = [mark in ("hidden", "comments") or not (article or large(k) and tag not in BOILER_TAGS) for k, (tag, mark, article) in enumerate(marks)]
    return [(b.text, b.words, b.links, any(counts[k] for k in b.marks), b.article) for b in found]


def main_text(page: str | None) -> str:
    """The article blocks of a page, joined by line feeds; null and empty pages give an empty text."""
    found = blocks(page or "")
    density = [100.0 * link / words for _, words, link, _, _ in found]
    plain = [words - link for _, words, link, _, _ in found]
    has_article = sum(p for p, b in zip(plain, found) if b[4] and not b[3]) > SOME * sum(plain)
    near = lambda i: (float(found[i][1]), density[i]) if 0 <= i < len(found) else (0.0, 0.0)
    rows = [[*near(i), *near(i - 1), *near(i + 1), float(b[3]), float(b[4]), float(has_article)] for i, b in enumerate(found)]
    return "\n".join(b[0] for b, row in zip(found, rows) if classify(tree(), row))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "html"):
        texts = pa.array([main_text(x.as_py()) for x in batch.column("html")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each input row; n_chars counts code points.

    Null or empty html gives an empty text; null ids and urls stay null; repeated rows each give a row; other columns
    are ignored. Pages are read whole, unclosed tags, quotes and comments included.
    """
    pages = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    texts = pages.mapInArrow(_batches, "page_id bigint, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))

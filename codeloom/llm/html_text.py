"""HTML extraction (operator 9): flat text blocks judged by a small decision tree.

A page is cut into flat blocks at block-level tags.  Each block has its word
count and link density, those of its neighbours and of the three together, and
where it stands: inside an article or main element, inside an element for
something else (nav, aside, footer, form ...), inside one named after what the
contract leaves out (advert, comments, cookie notice ...).  A decision tree,
grown from the labelled pages of ``html_pages``, tells main text from the rest.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.html_pages import PAGES, expand

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = _BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr".split())
#: Elements whose text is never shown as prose.
_RAW = "script style noscript template iframe svg textarea select object title noframes noembed video audio canvas datalist".split()
_BOILER_TAGS = frozenset("nav aside footer form dialog menu fieldset header head".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Names of menus, headers, footers, sidebars, notices, adverts, forms and reader comments; nothing else is left out by name.
_BOILER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense advertorial sponsor sponsored sponsors promo promos promotion banner banners
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar header masthead footer foot colophon
    sidebar sidebars rail widget widgets comment comments commentlist disqus reply replies respond cookie cookies consent gdpr ccpa
    notice notices alert alerts popup modal overlay newsletter subscribe signup signin login register form search searchbox""".split()
)
#: ``has-sidebar`` and the like say what else is on the page.
_BESIDE = frozenset("has with without no".split())
_COMMENTS = frozenset("comment comments reply replies".split())
_MAIN_WORDS = frozenset("article main content post entry story articlebody maincontent maintext bodytext".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(_RAW) + r")\b[^>]*+>(?:.*?</(?P=raw)\s*+>|.*+\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CAMEL = re.compile(r"[A-Za-z][a-z]*|\d+")


def _place(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Does this element mark main text; is it one for something else; is it named after something else."""
    main, aside, named = tag in ("article", "main"), tag in _BOILER_TAGS, False
    if attrs and tag not in ("html", "body"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                aside = True
            elif name == "role":
                main |= value.lower() in ("main", "article")
                aside |= value.lower() in _BOILER_ROLES
            elif name in ("class", "id"):
                for token in value.split():
                    words = {w.lower() for w in _CAMEL.findall(token)}
                    if words & _BOILER_WORDS and not words & _BESIDE and (not main or words & _COMMENTS):
                        named = True
                    elif words & _MAIN_WORDS:
                        main = True
    return main and not named, aside, named


class TextBlock:
    __slots__ = ("text", "words", "links", "main", "aside", "named", "heading")

    def __init__(self, text, words, links, main, aside, named, heading):
        self.text, self.words, self.links, self.main, self.aside, self.named, self.heading = text, words, links, main, aside, named, heading


def text_blocks(page: str) -> list[TextBlock]:
    """The page's blocks in order; tags left open or closed twice do no harm."""
    out: list[TextBlock] = []
    stack: list[tuple] = []
    main = aside = named = heading = link = False
    pieces: list[tuple[str, bool]] = []

    def flush():
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in pieces))).strip(" ")
            if text:
                links = sum(len(_WORD.findall(p)) for p, a in pieces if a)
                words = text.count(" ") + 1
                out.append(TextBlock(text, words, min(links, words), main, aside, named, heading))
            pieces.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append((page[at : m.start()], link))
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m.group("end"))
        if tag == "a":
            link = not closing
        elif tag == "br":
            pieces.append((" ", link))
        elif tag in _BLOCK:
            flush()
            if tag in _CONTAINER:
                if not closing:
                    if not m.group("attrs").endswith("/"):
                        if tag == "li" and stack and stack[-1][0] == "li":
                            _, main, aside, named = stack.pop()
                        stack.append((tag, main, aside, named))
                        here, other, name = _place(tag, m.group("attrs"))
                        other &= not (tag == "header" and main)  # an article's own header holds its title
                        main, aside, named = main or here, aside or other, named or name
                elif any(t == tag for t, *_ in stack):
                    while True:
                        t, main, aside, named = stack.pop()
                        if t == tag:
                            break
                    link = False
            elif tag[0] == "h" and tag != "hr":
                heading = not closing
    if at < len(page):
        pieces.append((page[at:], link))
    flush()
    return out


FEATURES = ("words_before", "words", "words_after", "links_before", "links", "links_after", "links_around", "main", "aside", "named", "page_has_main", "heading")


def features(blocks: list[TextBlock]) -> np.ndarray:
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)))
    if n:
        words = np.array([b.words for b in blocks], float)
        links = np.array([b.links for b in blocks], float)
        dens = links / words
        x[:, 1], x[:, 4] = words, dens
        x[1:, 0], x[:-1, 2], x[1:, 3], x[:-1, 5] = words[:-1], words[1:], dens[:-1], dens[1:]
        around = [np.convolve(v, np.ones(3))[1:-1] for v in (links, words)]
        x[:, 6] = around[0] / around[1]
        for k, name in enumerate(("main", "aside", "named")):
            x[:, 7 + k] = [getattr(b, name) for b in blocks]
        x[:, 10] = any(b.main and not b.aside and not b.named for b in blocks)
        x[:, 11] = [b.heading for b in blocks]
    return x


def labelled_table(pages: tuple[str, ...] = tuple(PAGES)) -> np.ndarray:
    """A row of features and label (main text or not) for each block of labelled pages."""
    rows = []
    for page in pages:
        blocks = text_blocks(expand(page))
        rows.append(np.column_stack([features(blocks), [b.text.startswith("\u00b6") for b in blocks]]))
    return np.concatenate(rows)


def grow(table: np.ndarray, depth: int = 7, least: int = 2):
    """A decision tree by Gini impurity: ``(feature, threshold, below_or_equal, above)`` or a label."""
    y = table[:, -1]
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(table.shape[1] - 1):
        values = np.unique(table[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = table[:, f] <= t
            if min(left.sum(), (~left).sum()) < least:
                continue
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[left], y[~left]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), left)
    if best is None:
        return int(share >= 0.5)
    _, f, t, left = best
    return f, t, grow(table[left], depth - 1, least), grow(table[~left], depth - 1, least)


@lru_cache(maxsize=1)
def tree():
    return grow(labelled_table())


def classify(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), bool(node))
    f, t, low, high = node
    below = x[:, f] <= t
    out = np.empty(len(x), bool)
    out[below], out[~below] = classify(low, x[below]), classify(high, x[~below])
    return out


def main_text(page: str | None) -> str:
    """Blocks of main text in page order, joined by an empty line."""
    blocks = text_blocks(page or "")
    if not blocks:
        return ""
    keep = classify(tree(), features(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep.tolist()) if k)


_SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (``page_id, url, html``): ``page_id, url, text, n_chars`` (code points).

    The whole html is read; null or empty html gives an empty text.  Character
    references are decoded, then white space ``[\\x20\\x09-\\x0D]`` inside a block
    becomes one space.  Rows are independent: repeated rows and null ids stay,
    an empty table gives an empty result, other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, _SCHEMA)

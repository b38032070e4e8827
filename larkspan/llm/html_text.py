"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags.  Each block is described by
its own word count and link density, those of the blocks before and after it,
and the region that its open elements name (page furniture, none, article).  A
decision tree, grown on the small labelled table below, keeps or drops it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import lean, ship

# Elements whose content is no text of the page.
_RAW = frozenset("script style template svg math textarea object canvas audio video noscript iframe title".split())
# Elements that stand inside a line of text.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Elements without an end tag, and elements whose end tag may be left out.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LOOSE = frozenset("p li dt dd td th tr thead tbody tfoot option optgroup colgroup caption html body h1 h2 h3 h4 h5 h6 blockquote pre".split())
# Elements and roles of page furniture, and those that hold the article.
_FURNITURE = frozenset("nav aside footer form button select fieldset dialog menu head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# Words in class and id attributes.
_AWAY = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion "
    "disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion "
    "related recommended replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
_TOWARDS = frozenset("article content entry main post story text body".split())
_LASTING = frozenset("aside comment comments discussion disqus replies reply respond related recommended sidebar".split())

# Labelled table: region (-1 page furniture, 0 none, 1 article), words, link share,
# words and link share of the block before, the same of the block after, main text (1) or not (0).
LABELLED = (
    (-1, 1, 1.0, 0, 0.0, 1, 1.0, 0), (-1, 2, 1.0, 1, 1.0, 3, 1.0, 0), (-1, 3, 1.0, 2, 1.0, 1, 1.0, 0), (-1, 1, 1.0, 1, 1.0, 12, 0.0, 0),
    (-1, 12, 0.0, 1, 1.0, 8, 0.0, 0), (-1, 9, 0.0, 1, 1.0, 120, 0.0, 0), (-1, 14, 0.1, 60, 0.0, 0, 0.0, 0), (-1, 30, 0.0, 90, 0.0, 4, 0.0, 0),
    (-1, 45, 0.0, 70, 0.0, 0, 0.0, 0), (-1, 80, 0.0, 3, 0.0, 2, 1.0, 0), (-1, 150, 0.0, 6, 0.0, 7, 0.0, 0), (-1, 6, 0.0, 200, 0.0, 55, 0.0, 0),
    (-1, 55, 0.0, 6, 0.0, 5, 0.0, 0), (-1, 20, 0.5, 10, 1.0, 0, 0.0, 0), (-1, 4, 0.0, 0, 0.0, 3, 0.0, 0), (-1, 0, 0.0, 4, 0.0, 90, 0.0, 0),
    (1, 1, 0.0, 9, 0.0, 40, 0.0, 1), (1, 7, 0.0, 10, 0.0, 80, 0.0, 1), (1, 9, 0.0, 1, 1.0, 3, 0.0, 1), (1, 3, 0.0, 9, 0.0, 60, 0.0, 1),
    (1, 60, 0.0, 9, 0.0, 110, 0.0, 1), (1, 110, 0.05, 60, 0.0, 75, 0.0, 1), (1, 75, 0.0, 110, 0.05, 14, 0.1, 1), (1, 300, 0.0, 8, 0.0, 0, 0.0, 1),
    (1, 25, 0.3, 60, 0.0, 70, 0.0, 1), (1, 12, 0.6, 80, 0.0, 40, 0.0, 1), (1, 5, 1.0, 90, 0.0, 60, 0.0, 1), (1, 2, 0.0, 70, 0.0, 2, 0.0, 1),
    (1, 4, 0.0, 4, 0.0, 4, 0.0, 1), (1, 1, 0.0, 1, 0.0, 1, 0.0, 1), (1, 8, 0.0, 0, 0.0, 0, 0.0, 1), (1, 2, 1.0, 60, 0.0, 30, 0.0, 1),
    (0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (0, 2, 1.0, 1, 1.0, 2, 1.0, 0), (0, 3, 1.0, 2, 1.0, 40, 0.0, 0), (0, 6, 0.8, 60, 0.0, 2, 1.0, 0),
    (0, 10, 0.9, 3, 1.0, 4, 1.0, 0), (0, 15, 0.7, 8, 0.9, 2, 1.0, 0), (0, 4, 0.0, 2, 1.0, 3, 1.0, 0), (0, 3, 0.0, 5, 0.0, 1, 1.0, 0),
    (0, 5, 0.0, 4, 0.6, 0, 0.0, 0), (0, 8, 0.0, 6, 0.5, 0, 0.0, 0), (0, 2, 0.0, 1, 1.0, 2, 1.0, 0), (0, 7, 0.2, 3, 1.0, 5, 0.8, 0),
    (0, 70, 0.0, 6, 0.0, 90, 0.0, 1), (0, 90, 0.05, 70, 0.0, 60, 0.0, 1), (0, 60, 0.0, 90, 0.0, 8, 0.4, 1), (0, 40, 0.1, 3, 1.0, 55, 0.0, 1),
    (0, 9, 0.0, 70, 0.0, 80, 0.0, 1), (0, 4, 0.0, 60, 0.0, 90, 0.0, 1), (0, 14, 0.0, 50, 0.0, 45, 0.0, 1), (0, 25, 0.0, 30, 0.0, 28, 0.0, 1),
    (0, 30, 0.0, 8, 0.0, 2, 1.0, 1), (0, 22, 0.0, 3, 0.0, 40, 0.0, 1), (0, 8, 0.0, 2, 1.0, 70, 0.0, 1), (0, 6, 0.0, 1, 1.0, 90, 0.0, 1),
    (0, 18, 0.2, 60, 0.0, 50, 0.1, 1), (0, 200, 0.0, 0, 0.0, 0, 0.0, 1), (0, 45, 0.0, 0, 0.0, 6, 0.5, 1), (0, 35, 0.9, 4, 1.0, 5, 1.0, 0),
    (0, 2, 1.0, 0, 0.0, 40, 0.0, 0), (0, 3, 0.9, 60, 0.0, 0, 0.0, 0), (0, 30, 0.8, 40, 0.0, 60, 0.0, 0), (0, 1, 1.0, 8, 0.0, 90, 0.0, 0),
    (-1, 250, 0.0, 8, 0.0, 0, 0.0, 0), (-1, 180, 0.0, 70, 0.0, 3, 0.0, 0), (-1, 40, 0.0, 0, 0.0, 90, 0.0, 0), (-1, 28, 0.0, 120, 0.0, 0, 0.0, 0),
    (-1, 300, 0.02, 0, 0.0, 200, 0.0, 0), (-1, 60, 0.0, 40, 0.0, 50, 0.0, 0), (-1, 35, 0.0, 2, 1.0, 4, 0.0, 0), (-1, 90, 0.0, 150, 0.0, 60, 0.0, 0),
    (0, 5, 0.0, 60, 0.0, 0, 0.0, 0), (0, 6, 0.2, 90, 0.0, 0, 0.0, 0), (0, 4, 0.5, 45, 0.0, 30, 0.0, 0), (0, 12, 0.7, 70, 0.0, 80, 0.0, 0),
)


class Tree:
    """Binary decision tree by Gini gain; ties go to the first feature, then the lowest cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, least: int = 1):
        self.feature, self.value = -1, float(y.mean() >= 0.5)
        if y.min() == y.max() or len(y) < 2 * least:
            return
        best = 1e-12
        whole = self._impurity(y)
        for f in range(x.shape[1]):
            at = np.unique(x[:, f])
            for cut in (at[:-1] + at[1:]) / 2:
                low = x[:, f] <= cut
                if min(low.sum(), (~low).sum()) >= least and (gain := whole - self._impurity(y[low]) - self._impurity(y[~low])) > best:
                    best, self.feature, self.cut = gain, f, float(cut)
        if self.feature >= 0:
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], least), Tree(x[~low], y[~low], least)

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        return float(len(y) * y.mean() * (1 - y.mean())) if len(y) else 0.0

    def predict(self, row: tuple[float, ...]) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.value > 0.5


def train() -> Tree:
    table = np.array(LABELLED, float)
    return Tree(table[:, :-1], table[:, -1])


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\s++|/|=|\"[^\"]*+\"|'[^']*+'|[^\s\"'>/=]++)*+)(?:>|\Z)", re.DOTALL)
_BROKEN = re.compile(r"(?!x)x()|<(/?)([a-zA-Z][\w:-]*)([^>]*+)>")
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _region(name: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """(-1, 0 or 1 for the element itself, whether a later article leaves it in force)."""
    if name in ("article", "main"):
        region, lasting = 1, False
    elif name in _FURNITURE or (name == "header" and not inside):
        region, lasting = -1, name == "aside"
    else:
        region, lasting = 0, False
    if attributes:
        away, towards = False, False
        for kind, value in _NAMED.findall(attributes):
            kind, value = kind.lower(), value.strip("\"'")
            if kind in ("class", "id"):
                words = {w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if w}
                away |= bool(words & _AWAY) and not words & _TOWARDS or bool(words & _LASTING)
                towards |= bool(words & _TOWARDS) and not words & _AWAY
                lasting |= bool(words & _LASTING)
            elif kind == "role":
                away |= value.lower() in _ROLES
                towards |= value.lower() in ("main", "article")
            elif kind == "style":
                away |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
            else:
                away |= value.lower() != "false"
        if away and name not in ("html", "body", "main") and (name != "article" or lasting):
            region = -1
        elif towards and not region:
            region = 1
    return region, lasting


def blocks(html: str) -> list[tuple[str, int, int, float]]:
    """(text, region, words, link share) of each flat block, in page order; empty ones left out."""
    out: list[tuple[str, int, int, float]] = []
    open_: list[tuple[str, int, bool, int]] = []  # name, own region, lasting, region of what stands inside
    depth: dict[str, int] = {}
    text: list[str] = []
    linked: list[str] = []
    region, in_link, seen = 0, 0, False

    def put(name: str, kind: int, lasting: bool) -> None:
        above = open_[-1][3] if open_ else 0
        open_.append((name, kind, lasting, -1 if -1 in (above, kind) else max(above, kind)))

    def end() -> None:
        if text:
            words = unescape("".join(text)).split()
            if words:
                links = len(unescape(" ".join(linked)).split())
                out.append((" ".join(words), region, len(words), min(1.0, links / len(words))))
            text.clear()
            linked.clear()

    at, n = 0, len(html)
    lower: str | None = None
    while at < n:
        start = html.find("<", at)
        if start < 0:
            start = n
        if start > at:
            text.append(html[at:start])
            if in_link:
                linked.append(html[at:start])
        if start == n:
            break
        m = _TAG.match(html, start) or _BROKEN.match(html, start)
        if not m:  # a lone "<" is text
            text.append("<")
            at = start + 1
            continue
        at = m.end()
        if m[1] is not None:
            text.append(m[1].replace("&", "&amp;"))
        if m[3] is None:
            continue
        name, closing, attributes = m[3].lower(), bool(m[2]), m[4]
        if name in _RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                lower = html.lower() if lower is None or len(lower) != n else lower
                stop = lower.find(f"</{name}", at)
                stop = n if stop < 0 else stop
                at = html.find(">", stop) + 1 or n
            if name not in ("svg", "math", "noscript"):
                end()
            continue
        if name == "br":
            text.append(" ")
            if in_link:
                linked.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name in _INLINE:
            continue
        end()
        in_link = 0 if name != "a" else in_link
        if name in _VOID or name in _LOOSE and not attributes:
            continue
        if closing:
            while depth.get(name):
                last = open_.pop()[0]
                depth[last] -= 1
                if last == name:
                    break
        elif not attributes.rstrip().endswith("/"):
            kind, lasting = _region(name, attributes, region == 1)
            if name in ("article", "main") and kind == 1 and not seen:
                seen = True  # furniture that was never closed ends where the first article begins
                if not any(o[2] for o in open_):
                    held, open_[:] = list(open_), []
                    depth.clear()
                    for o in held:
                        if o[1] >= 0:
                            put(*o[:3])
                            depth[o[0]] = depth.get(o[0], 0) + 1
            if name not in _LOOSE or kind:
                put(name, kind, lasting)
                depth[name] = depth.get(name, 0) + 1
        region = open_[-1][3] if open_ else 0
    end()
    return out


def main_text(html: str | None, tree: Tree) -> str:
    found = blocks(html or "")
    kept = []
    for i, (text, region, words, links) in enumerate(found):
        before = found[i - 1][2:] if i else (0, 0.0)
        after = found[i + 1][2:] if i + 1 < len(found) else (0, 0.0)
        if tree.predict((region, words, links, *before, *after)):
            kept.append(text)
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty page gives the empty text; repeated rows give repeated
    results; a page is never cut.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = train()
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ship(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")

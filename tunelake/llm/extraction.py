"""Main text of web pages by gradient-boosted trees over the nodes of the element tree.

The trees see a node's element group and its parent's, text and link density of its subtree,
words of its attributes and of those above it, depth, place among siblings and the siblings'
sizes. They learn from a bounded sample of pages that mark their own article. Each page is
shown as it is, without telling names, so that shape and density count as well, and with its
article named as comments or a side bar, so that names outweigh shape.

Decoding is hierarchical: of all labellings in which a kept node's parents are kept, the one
with the largest sum of log-odds, found from the leaves up. So no text is kept inside a menu,
and a doubtful container is kept for its sure paragraphs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes
from .dom import ARTICLE, CONTENT_WORDS, FEATURES, OTHER_WORDS, Page, features, marked

#: Pages that learning reads at most, and their characters.
SAMPLE_PAGES = 400
SAMPLE_CHARS = 4_000_000
TREES = 30
DEPTH = 4
BINS = 32
RATE = 0.3


class Trees:
    """Gradient boosting for the logistic loss, with histograms; all trees are complete."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.depth = depth
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        self.feature, self.cut, self.leaf = [], [], []
        if not len(y) or y.min() == y.max():
            return
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            f += self._grow(binned, edges, p - y, p * (1 - p))

    def _grow(self, binned, edges, slope, curve):
        node = np.zeros(binned.shape[1], np.int64)
        feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            best, split = np.full(width, 1e-6), np.full((width, 2), -1)
            for j, column in enumerate(binned):
                at = (node - first) * BINS + column
                g = np.bincount(at, slope, width * BINS).reshape(width, BINS)
                h = np.bincount(at, curve, width * BINS).reshape(width, BINS)
                gl, hl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
                gt, ht = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                split[better, 0], split[better, 1] = j, top[better]
            used = np.flatnonzero(split[:, 0] >= 0)
            feature[first + used] = split[used, 0]
            cut[first + used] = [edges[j][b] for j, b in split[used].tolist()]
            chosen, bins = split[node - first].T
            right = (chosen >= 0) & (binned[np.maximum(chosen, 0), np.arange(len(node))] > bins)
            node = 2 * node + 1 + right
        leaf = node - (2**self.depth - 1)
        g, h = (np.bincount(leaf, v, 2**self.depth) for v in (slope, curve))
        value = -RATE * g / (h + 1)
        self.feature.append(feature)
        self.cut.append(cut)
        self.leaf.append(value)
        return value[leaf]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def decode(parent: list[int], log_odds: list[float]) -> list[bool]:
    """The best labelling in which a node is kept only if its parent is."""
    gain = list(log_odds)
    for i in range(len(gain) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    keep = [gain[0] > 0]
    for i in range(1, len(gain)):
        keep.append(keep[parent[i]] and gain[i] > 0)
    return keep


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Trees:
    """Learn from about `sample` pages, chosen by a hash of their id (twice as many at most)."""
    share = int((1 << 31) * min(1.0, sample / max(1, pages.count())))
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).filter(
        (F.pmod(F.xxhash64("page_id"), F.lit(1 << 31)) < share) & (F.length("html") <= chars // 10)
    )
    rows = sorted(chosen.limit(2 * sample).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.html))
    rng = np.random.default_rng(0)
    x, y, read = [np.empty((0, FEATURES))], [np.empty(0, np.int64)], 0
    for row in rows:
        read += len(row.html)
        if read > chars:
            break
        page = Page(row.html)
        labels = marked(page)
        for plain in (False, True):
            x.append(features(page, plain))
            y.append(labels)
        if _disguise(page, rng):
            x.append(features(page))
            y.append(marked(page))
    return Trees(np.concatenate(x), np.concatenate(y))


def _disguise(page: Page, rng) -> bool:
    """Name the article as comments, a side bar or the like, as an example of texts that are none."""
    found = [i for i, t in enumerate(page.tag) if t in ARTICLE or CONTENT_WORDS.intersection(page.words[i])]
    for i in found:
        page.tag[i] = ["div", "section", "aside", "header"][rng.integers(4)]
        page.words[i] = () if page.tag[i] in ("aside", "header") else (sorted(OTHER_WORDS)[rng.integers(len(OTHER_WORDS))],)
    return bool(found)


def main_texts(htmls: list[str], trees: Trees) -> list[str]:
    """Of each page the kept blocks, one per line; a page without elements is kept whole."""
    pages = [Page(h) for h in htmls]
    if not pages:
        return []
    odds = np.clip(trees.log_odds(np.concatenate([features(p) for p in pages])), -6, 6).tolist()
    out, at = [], 0
    for page in pages:
        own, at = odds[at : at + len(page.tag)], at + len(page.tag)
        spaces = [t == "#space" for t in page.tag]
        keep = decode(page.parent, [0.0 if s else o for o, s in zip(own, spaces, strict=True)])
        keep = [k or (s and keep[p]) for k, s, p in zip(keep, spaces, page.parent, strict=True)]
        if all(t[0] == "#" for t in page.tag):
            keep = [True] * len(keep)
        out.append("\n".join(page.blocks(keep)))
    return out


def extract(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html).

    A null html is empty and gives an empty text; null ids and urls stay null; repeated rows
    are given back as often as they come. Other columns are ignored. Without pages to learn
    from nothing is cut but scripts, styles and the like.
    """
    trees = fit(pages, sample)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in by_bytes(batches, "html", 1 << 20):
            texts = main_texts(batch.column("html").to_pylist(), trees)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())],
                schema=schema,
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

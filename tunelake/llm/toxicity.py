"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel of two words counts their common subsequences of three letters, digits or word ends, gaps
allowed: a subsequence that spans s characters weighs DECAY^s, spans beyond SPAN are left out,
and the value is divided by both words' own lengths in that space. Other characters take up
room but are never part of a subsequence, so "i.d-i.o.t" and "idioot" stay close to "idiot";
runs of single characters ("i d i o t") are read as one word.

Labels mark whole texts, of which only a few words offend. Learning alternates between
choosing, in every text, the word that offends most and fitting the machine to these words: a
positive text gives its witness, a negative one its worst word. Words are seen through their
kernel with a bounded set of landmarks (Nyström). The fitted function is linear in the
subsequence space, so it is folded into one weight per subsequence, and each distinct word of
a worker's texts is scored once. How much an offending word says about its text (some occur in
clean ones too) is a second function on the same landmarks, fitted by logistic regression on
the sums over all distinct offending words of a text; a text's score is that logistic function.
"""

import math
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .common import by_bytes, stored, whole_text
from .kneser import held_out

DECAY = 0.7
SPAN = 6
#: Labelled rows that learning reads at most; of equal hashes all or none.
SAMPLE = 5000
LANDMARKS = 400
ROUNDS = 4
#: Weight of the loss against the machine's norm; the words' weights sum to one.
COST = 10000.0
TABLE_WORDS = 300_000
#: Bytes of texts whose words a worker holds at once, and characters of words that it embeds at once;
#: both take up a hundred times as much while they are worked on. A longer one comes alone.
TEXT_BYTES = 2 << 20
PART_CHARS = 1 << 16
#: Share of the positive texts that an offending word is in, at least.
SUPPORT = 0.01
#: Evidence from which on a word is taken as offending at first.
PROOF = 10.0
#: Ordinary words that a round of learning adds: at first drawn at random, then the worst.
HARD = 2500
#: Characters of a part of a run of short words; the whole run is a word at any length.
PART = 16
_SINGLES = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_SHORT = re.compile(r"(?<!\S)(?:\S{1,2}\s+){2,}\S{1,2}(?!\S)")
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _symbols() -> np.ndarray:
    """Symbol of each character below U+0250, 0 for those that are no letter or digit."""
    table = np.zeros(0x250, np.int64)
    for i in range(len(table)):
        c = chr(i).lower()[:1]
        if c.isalnum():
            o = ord(c)
            table[i] = o - 96 if "a" <= c <= "z" else o - 21 if c.isdigit() and c.isascii() else 37 + o % 25
    return table


#: A word's beginning and end are symbols too.
_BEGIN, _END = 62, 63


_SYMBOLS = _symbols()


#: Characters below U+0250 that are no symbols.
_OTHER = re.compile("[" + "".join(re.escape(chr(i)) for i in range(len(_SYMBOLS)) if not _SYMBOLS[i]) + "]+")


def words_of(text: str) -> list[str]:
    """The words of a text; as further words, those with other characters inside without them,
    and runs of short words with their parts of three words or more.
    """
    words = text.split()
    joined = ["".join(m.split()) for m in _SINGLES.findall(text)]
    for match in _SHORT.findall(text):
        run = match.split()
        joined.append("".join(run))
        for i in range(len(run) - 2):
            part = run[i] + run[i + 1]
            for w in run[i + 2 :]:
                part += w
                if len(part) > PART:
                    break
                joined.append(part)
    words += joined
    return words + [w for w in (_OTHER.sub("", w) for w in words if not w.isalnum()) if w]


def embed(words: list[str]):
    """(word number, subsequence, weight) of all words, each subsequence of a word once."""
    codes = np.frombuffer("".join([f"\n{w}\r" for w in words]).encode("utf-32-le"), np.uint32)
    codes = codes.astype(np.int64)
    begins = codes == 10
    number = np.cumsum(begins) - 1
    symbol = np.where(codes < len(_SYMBOLS), _SYMBOLS[np.minimum(codes, len(_SYMBOLS) - 1)], 37 + codes % 25)
    symbol[begins], symbol[codes == 13] = _BEGIN, _END
    keys, weights = [], []
    for a, b in _OFFSETS:
        n = max(0, len(symbol) - b)
        x, y, z = symbol[:n], symbol[a : a + n], symbol[b : b + n]
        at = np.flatnonzero((x > 0) & (y > 0) & (z > 0) & (number[:n] == number[b : b + n]))
        keys.append((number[at] << 18) | (x[at] << 12) | (y[at] << 6) | z[at])
        weights.append(np.full(len(at), DECAY ** (b + 1)))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    total = np.add.reduceat(weights[order], first) if len(first) else weights
    return keys[first] >> 18, keys[first] & ((1 << 18) - 1), total


def _unit(words: list[str]):
    """The embedding, each word scaled to length one."""
    number, code, weight = embed(words)
    norm = np.sqrt(np.bincount(number, weights=weight**2, minlength=len(words)))
    return number, code, weight / norm[number]


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """Kernel values of two lists of words."""
    number, code, weight = _unit(others)
    used, column = np.unique(code, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(others)))
    dense[column, number] = weight
    number, code, weight = _unit(words)
    row = np.minimum(np.searchsorted(used, code), max(len(used) - 1, 0))
    hit = np.flatnonzero(used[row] == code) if len(used) else np.empty(0, np.int64)
    out = np.zeros((len(words), len(others)))
    for i in range(0, len(hit), 1 << 12):
        h = hit[i : i + (1 << 12)]  # in the order of their words
        first = np.flatnonzero(np.concatenate([[True], np.diff(number[h]) > 0]))
        out[number[h[first]]] += np.add.reduceat(weight[h, None] * dense[row[h]], first, axis=0)
    return out


def _svm(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, cost: float = COST, steps: int = 15):
    """Linear machine with squared hinge loss, by Newton steps on the violated margins; (w, bias)."""
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        part = x[active] * (2 * cost * weights[active])[:, None]
        w = np.linalg.solve(ridge + part.T @ x[active], part.T @ labels[active])
        new = labels * (x @ w) < 1
        if (new == active).all():
            break
        active = new
    return w[:-1], w[-1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2e-5, steps: int = 50):
    """Coefficients and intercept by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * len(x) * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _distinct(texts: list[str]) -> list[int]:
    """Numbers of the texts that are no copies of earlier ones: copies would pass for evidence.

    Texts count as copies if they agree in one of three least hashes over their word triples.
    """
    seen, kept = set(), []
    for i, text in enumerate(texts):
        words = text.split()
        triples = zip(words, words[1:], words[2:], strict=False)
        hashes = np.fromiter((zlib.crc32(" ".join(t).encode()) for t in triples), np.uint64)
        marks = [(m, int((hashes * np.uint64(m) % np.uint64(4294967291)).min())) for m in _MULTIPLIERS if len(hashes)]
        if not seen.intersection(marks):
            kept.append(i)
        seen.update(marks)
    return kept


_MULTIPLIERS = (2654435761, 2246822519, 3266489917)


class Detector:
    """Subsequence weights of the machine and of the evidence, and their constants."""

    def __init__(self, texts: list[str], labels: list[int], landmarks: int = LANDMARKS):
        self.weights = self.evidence = np.zeros(1 << 18)
        self.bias, self.base, self.marks, self.root = -1.0, -10.0, [], None
        own = _distinct(texts)
        y = np.array([labels[i] for i in own], np.int64)
        if not len(y) or y.min() == y.max():
            self.base = 10.0 if len(y) and y.max() == 1 else -10.0
            return
        numbers: dict[str, int] = {}
        bags = [
            np.array(sorted({numbers.setdefault(w, len(numbers)) for w in words_of(texts[i].lower())}), np.int64)
            for i in own
        ]
        self._fit(list(numbers), bags, y, landmarks)

    def _fit(self, words, bags, y, landmarks):
        """`bags`: of each text the numbers of its words."""
        count = [np.bincount(np.concatenate([b for b, k in zip(bags, y, strict=True) if k == kind]), minlength=len(words)) for kind in (0, 1)]
        n0, n1 = (y == 0).sum(), (y == 1).sum()
        odds = np.log((count[1] + 0.5) / (n1 + 1)) - np.log((count[0] + 0.5) / (n0 + 1))
        # a word's evidence: how far its share in positive texts exceeds what chance would give
        proof = np.where((odds > 2) & (count[1] >= max(3, n1 * SUPPORT)), odds * np.sqrt(count[1]), 0)
        good = np.flatnonzero(proof > PROOF)
        clean = np.flatnonzero(count[0])
        rng = np.random.default_rng(0)
        common = clean[np.argsort(-count[0][clean], kind="stable")][: HARD // 4]
        bad = dict.fromkeys([*common.tolist(), *rng.permutation(clean)[:HARD].tolist()])
        worst: list[int] = []
        for _ in range(ROUNDS):
            if not len(good):
                return
            bad = {w: None for w in bad if w not in set(good.tolist())}
            shown = np.array([*good.tolist(), *bad])
            size = np.sqrt(np.concatenate([count[1][good], 1 + count[0][list(bad)]]).astype(float))
            size[: len(good)] *= 0.5 / size[: len(good)].sum()
            size[len(good) :] *= 0.5 / size[len(good) :].sum()
            marks = good[np.argsort(-count[1][good], kind="stable")][: landmarks // 2].tolist()
            near = [w for w in worst if w in bad][: (landmarks - len(marks)) * 2 // 3]
            taken = set(near)
            marks += near + [w for w in rng.permutation(list(bad)).tolist() if w not in taken][: landmarks - len(marks) - len(near)]
            kinds = np.where(np.arange(len(shown)) < len(good), 1, -1)
            self._learn([words[i] for i in shown], kinds, size, [words[i] for i in marks])
            margin = self.margins(words)
            # witnesses: words on the offending side that clean texts do not share
            good = np.flatnonzero((margin > 0) & (proof > 0.7 * PROOF))
            worst = clean[np.argsort(-margin[clean], kind="stable")][:HARD].tolist()
            bad |= dict.fromkeys(worst)
        hits = [b[margin[b] > 0] for b in bags]
        distinct = np.unique(np.concatenate(hits))
        if not len(distinct):
            return
        seen = kernel([words[i] for i in distinct], self.marks) @ self.root
        sums = np.array([seen[np.searchsorted(distinct, h)].sum(axis=0) for h in hits])
        fitted = _logistic(sums, y)
        number, code, weight = _unit(self.marks)
        self.evidence = np.bincount(code, weights=weight * (self.root @ fitted[:-1])[number], minlength=1 << 18)
        self.base = float(fitted[-1])

    def _learn(self, words, labels, size, marks):
        near = kernel(marks, marks)
        values, vectors = np.linalg.eigh(near)
        kept = values > 1e-6 * values.max()
        self.marks, self.root = marks, vectors[:, kept] / np.sqrt(values[kept])
        w, self.bias = _svm(kernel(words, marks) @ self.root, labels, size)
        number, code, weight = _unit(marks)
        self.weights = np.bincount(code, weights=weight * (self.root @ w)[number], minlength=1 << 18)

    def _values(self, words: list[str], *weights: np.ndarray):
        """Kernel expansions over the landmarks, given by subsequence weights, of each word."""
        out = np.zeros((len(weights), len(words)))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        start = done = 0
        while start < len(words):
            end = max(start + 1, int(np.searchsorted(ends, done + PART_CHARS, "right")))
            part = words[start:end]
            number, code, weight = embed(part)
            norm = np.maximum(np.sqrt(np.bincount(number, weights=weight**2, minlength=len(part))), 1e-12)
            for row, w in zip(out, weights, strict=True):
                row[start:end] = np.bincount(number, weights=weight * w[code], minlength=len(part)) / norm
            start, done = end, int(ends[end - 1])
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word; offending words are above zero."""
        return self._values(words, self.weights)[0] + self.bias

    def offences(self, words: list[str]) -> list[float]:
        """Evidence of each word; zero for words on the harmless side."""
        margin, evidence = self._values(words, self.weights, self.evidence)
        evidence[margin + self.bias <= 0] = 0
        return evidence.tolist()

    def scores(self, texts: list[str], table: ChunkTable) -> np.ndarray:
        bags = [set(words_of(t.lower())) for t in texts]
        table.learn(chain.from_iterable(bags))
        logits = [self.base + math.fsum(map(table.__getitem__, bag)) for bag in bags]
        return 1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Detector:
    """Learn from the labelled rows that are not held out, `sample` of them at most.

    Rows are chosen by a hash of doc_id; equal rows count once, and where a doc_id has several
    texts a hash of both decides. Labels other than 0 and 1 are not used, neither are doc_ids
    with contradicting labels.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(5))
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    )
    chosen = stored(known.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
        .join(chosen, "doc_id").select("doc_id", "text", "toxic").distinct()
        .orderBy(F.xxhash64("doc_id", "text")).limit(sample).collect()
    )
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    return Detector([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null texts count as empty."""
    model = docs.sparkSession.sparkContext.broadcast(detector)  # two megabytes, whatever the input
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        table = ChunkTable(model.value.offences, TABLE_WORDS)
        for batch in by_bytes(batches, "text", TEXT_BYTES):
            scores = model.value.scores(batch.column("text").to_pylist(), table)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                 pa.array((scores >= 0.5).astype(np.int32))],
                schema=schema,
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5).alias("held_out"), whole_text().alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, detector: Detector) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below one half."""
    model = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches):
        table = ChunkTable(model.value.offences, TABLE_WORDS)
        for batch in by_bytes(batches, "text", TEXT_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(model.value.scores(texts, table) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn and score: doc_id, held_out, score, predicted of every row of `docs`.

    Only texts enter a score. Repeated rows and null ids are scored row by row; without
    labelled rows of both kinds every score is near 0 (or near 1 if all are toxic). Other
    columns are ignored.
    """
    return score(docs, fit(docs, labels, sample))

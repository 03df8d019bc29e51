"""Quality by pairwise ranking: a Bradley-Terry model over statistics of the text.

Every text becomes a vector of counts and shares: kinds of characters and their neighbours,
words, lines and repetitions. The model gives a document the strength w.x; a document is
preferred over another with probability 1 / (1 + exp(w.x' - w.x)), and w is fitted by logistic
loss on the feature differences of pairs of a good and a bad labelled document. All labelled
documents take part: they are dealt into blocks of bounded size, rivals are of the same block,
and every Newton step is a sum over the blocks. The threshold is the exact
quantile of the labelled documents' strengths at the share of bad ones, and a score is
the strength put on a scale from 0 to 1 on which that quantile lies at KEEP.
"""

import string
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stored, whole_text

#: Labelled rows of a block, about, and rows of the rarer label in it, about and at least.
BLOCK = 1024
RARE = 32
#: Ranges that one pass over the strengths tells apart.
BINS = 4096
#: Documents of the other label that every labelled document is compared with.
RIVALS = 12
#: Score at the threshold; documents from there on are kept.
KEEP = 0.7
RIDGE = 1e-3
#: Standard deviations beyond which a feature tells no more.
CLIP = 6.0
#: Characters of a window; words and lines are told apart within one, so memory stays bounded.
WINDOW = 1 << 14

_PUNCTUATION = string.punctuation.encode()
#: Coarse kinds: other control, lower case or beyond ASCII, upper case, digit, punctuation, blank, line end.
_COARSE = 7


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Fine and coarse kind of every byte; each punctuation mark is a fine kind of its own."""
    coarse = np.zeros(256, np.int64)
    coarse[ord("a") : ord("z") + 1] = 1
    coarse[128:] = 1
    coarse[ord("A") : ord("Z") + 1] = 2
    coarse[ord("0") : ord("9") + 1] = 3
    coarse[list(_PUNCTUATION)] = 4
    coarse[[32, 9]] = 5
    coarse[[10, 11, 12, 13]] = 6
    fine = coarse.copy()
    for i, c in enumerate(_PUNCTUATION):
        fine[c] = _COARSE + i
    fine[128:192] = _COARSE + len(_PUNCTUATION)  # bytes inside a character beyond ASCII
    return fine, coarse


_FINE_OF, _COARSE_OF = _kinds()
_FINE = _COARSE + len(_PUNCTUATION) + 1
_WORDS = 10
WIDTH = 2 + _FINE + _COARSE * _COARSE + _WORDS


def _windows(text: str):
    """The text in windows that end at white space where there is some."""
    start = 0
    while len(text) - start > WINDOW:
        end = start + WINDOW
        cut = max(text.rfind(" ", start, end), text.rfind("\n", start, end)) + 1
        cut = cut if cut > start else end
        yield text[start:cut]
        start = cut
    yield text[start:]


def features(text: str) -> np.ndarray:
    """The statistics of a text; an empty one has zeros."""
    fine, pairs = np.zeros(_FINE), np.zeros(_COARSE * _COARSE)
    size = words_n = distinct = same = long = single = bare = capital = marked = lines_n = distinct_lines = top = 0
    for window in _windows(text):
        codes = np.frombuffer(window.encode(), np.uint8)
        fine += np.bincount(_FINE_OF[codes], minlength=_FINE)
        coarse = _COARSE_OF[codes]
        pairs += np.bincount(coarse[:-1] * _COARSE + coarse[1:], minlength=_COARSE * _COARSE)
        words = window.split()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        size += int(lengths.sum())
        words_n += len(words)
        long += int((lengths > 15).sum())
        single += int((lengths == 1).sum())
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        distinct += len(counts)
        top += max(counts.values(), default=0)
        same += sum(map(eq, words, words[1:]))
        for w, n in counts.items():
            if not w[-1].isalnum():
                marked += n
            if w.isupper():
                capital += n
            elif w.upper() == w.lower():
                bare += n
        lines = [x for x in window.split("\n") if x]
        lines_n += len(lines)
        distinct_lines += len(set(lines))
    n_bytes, n_words, n_lines = max(1.0, fine.sum()), max(1, words_n), max(1, lines_n)
    shares = [size / n_words / 10, distinct / n_words, same / n_words, long / n_words, single / n_words,
              bare / n_words, capital / n_words, marked / n_words, distinct_lines / n_lines, top / n_words]
    logs = [np.log1p(fine.sum()), np.log1p(words_n / n_lines)]
    return np.concatenate([logs, np.sqrt(fine / n_bytes), np.sqrt(pairs / n_bytes), shares]).astype(np.float32)


class Ranking:
    """A strength function and its threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rivals: int = RIVALS, seed: int = 0):
        """Learned from the rows of an array, as one block."""
        block = Block(x, y == 1, np.ones(len(x)), rivals, seed)
        _learn(self, int((y == 1).sum()), int((y == 0).sum()), lambda use: use(block), lambda ranks: np.sort(self.strengths(x))[ranks])

    @classmethod
    def empty(cls) -> "Ranking":
        return cls(np.zeros((0, WIDTH)), np.zeros(0))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -CLIP, CLIP)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1, KEEP at the threshold."""
        strength = self.strengths(x) - self.threshold
        return 1 / (1 + np.exp(-np.clip(strength + np.log(KEEP / (1 - KEEP)) + 1e-9, -30, 30)))


class Block:
    """Labelled documents that are each other's rivals, and what they add to a learning step.

    `times` says how many blocks a document is in; it counts as one over all of them.
    """

    def __init__(self, x: np.ndarray, good: np.ndarray, times: np.ndarray, rivals: int = RIVALS, seed: int = 0):
        self.x, self.good, self.times = x, good, times
        self.rivals, self.seed = rivals, seed

    def moments(self, center: np.ndarray) -> np.ndarray:
        """Sums of the features and of their squares, about a center."""
        d = (self.x - center) / self.times[:, None] if len(self.x) else np.zeros((0, len(center)))
        return np.concatenate([d.sum(axis=0), (d * (self.x - center)).sum(axis=0)])

    def _pairs(self):
        """Winners, losers and weights; the pairs of a document weigh one together."""
        good, bad = np.flatnonzero(self.good), np.flatnonzero(~self.good)
        if not len(good) or not len(bad):
            return (np.empty(0, int),) * 2 + (np.empty(0),) * 2
        rng = np.random.default_rng(self.seed)
        # every document meets `rivals` of the other label, dealt out in turn from a shuffled order
        n = self.rivals
        deal = lambda own, other: (np.repeat(own, n), rng.permutation(other)[np.arange(len(own) * n) % len(other)])
        (g1, b1), (b2, g2) = deal(good, bad), deal(bad, good)
        own = np.concatenate([1 / self.times[g1], np.zeros(len(b2))]), np.concatenate([np.zeros(len(g1)), 1 / self.times[b2]])
        return np.concatenate([g1, g2]), np.concatenate([b1, b2]), own[0] / n, own[1] / n

    def step(self, ranking: Ranking, goods: int, bads: int) -> np.ndarray:
        """Slope and curve of the pairs' logistic loss, both labels with half of the weight, however rare one is."""
        z = ranking._scaled(self.x)
        winners, losers, of_good, of_bad = self._pairs()
        weight = 0.5 * of_good / goods + 0.5 * of_bad / bads
        strength = z @ ranking.weights
        p = 1 / (1 + np.exp(np.clip(strength[winners] - strength[losers], -30, 30)))  # probability of the wrong order
        size = len(z)
        pull = np.bincount(winners, weight * p, size) - np.bincount(losers, weight * p, size)
        stiff = weight * p * (1 - p)
        # the sum over the pairs of the outer squares of their differences
        tie = np.bincount(winners, stiff, size) + np.bincount(losers, stiff, size)
        good, bad = np.flatnonzero(self.good), np.flatnonzero(~self.good)
        place = np.zeros(size, int)
        place[good], place[bad] = np.arange(len(good)), np.arange(len(bad))
        links = np.bincount(place[winners] * len(bad) + place[losers], stiff, len(good) * len(bad)).reshape(len(good), len(bad))
        across = z[good].T @ (links @ z[bad])
        return np.concatenate([-(z.T @ pull), ((z * tie[:, None]).T @ z - across - across.T).ravel()])


def _learn(ranking: Ranking, goods: int, bads: int, total, at, steps: int = 30) -> None:
    """Learn a ranking: `total` sums what a function gives of every block, `at` gives strengths by rank.

    The weights are those of the Bradley-Terry model by Newton's method; the pairs' weight sums to one.
    """
    n = goods + bads
    width = WIDTH if not n else len(total(lambda b: b.x[:1].sum(axis=0)))
    ranking.mean, ranking.spread, ranking.weights = np.zeros(width), np.ones(width), np.zeros(width)
    if not goods or not bads:  # nothing to compare: all are kept, unless only bad ones are known
        ranking.threshold = 50.0 if bads else 0.0
        return
    ranking.mean = total(lambda b: b.moments(np.zeros(width)))[:width] / n
    mean = ranking.mean
    spread = np.sqrt(np.maximum(total(lambda b: b.moments(mean))[width:] / n, 0))
    ranking.spread = np.where(spread > 1e-9, spread, np.inf)
    for _ in range(steps):
        found = total(lambda b: b.step(ranking, goods, bads))
        slope = RIDGE * ranking.weights + found[:width]
        move = np.linalg.solve(found[width:].reshape(width, width) + RIDGE * np.eye(width), slope)
        ranking.weights = ranking.weights - move / max(1.0, np.abs(move).max() / 5)
        if np.abs(move).max() < 1e-6:
            break
    ranking.threshold = float(np.mean(at([bads - 1, bads])))


def held_out(parts: int = 4, remainder: int = 2):
    """Whether crc32 of doc_id, as text, leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % parts == remainder, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the features of every row; null texts count as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("features", pa.list_(pa.float32()))])

    def run(batches):
        for batch in by_bytes(batches, "text"):
            flat = np.concatenate([features(t.as_py()) for t in batch.column("text")])
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * WIDTH)
            values = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), values], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, features array<float>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)


def _blocks(labelled: DataFrame, goods: int, bads: int) -> DataFrame:
    """block, features, good, times and own of the labelled rows, stored by blocks.

    A hash deals the rows out. Where one label is too rare for all blocks, its rows are in
    several of them, one of which is its own, so that every row meets rivals and no block is large.
    """
    blocks = -(-(goods + bads) // BLOCK)
    fewer = min(goods, bads)
    times = min(blocks, max(1, -(-blocks * RARE // fewer)))
    rare = F.col("quality") == int(goods <= bads)
    h = F.xxhash64("doc_id", "features")
    first = F.pmod(h, F.lit(blocks))
    place = lambda i: F.struct((i == 0).alias("own"), F.pmod(first + F.floor(i * F.lit(blocks) / times), F.lit(blocks)).alias("block"))
    dealt = labelled.select(
        "features", (F.col("quality") == 1).alias("good"), h.alias("h"), F.when(rare, times).otherwise(1).alias("times"),
        F.inline(F.transform(F.sequence(F.lit(0), F.when(rare, times - 1).otherwise(0)), place)),
    )
    # files are large enough to be few, and too small to be split
    shares = max(1, min(blocks, 4 * labelled.sparkSession.sparkContext.defaultParallelism), blocks // 100)
    return stored(dealt.repartition(shares, "block").sortWithinPartitions("block", "h"), "blocks")


def _each_block(batches):
    """Block objects of rows that come sorted by block."""
    held, current = [], None

    def built():
        rows = pa.Table.from_batches(held).combine_chunks()
        times = rows.column("times").to_numpy().astype(float)
        good = rows.column("good").combine_chunks().to_numpy(zero_copy_only=False)
        return Block(_matrix(rows.column("features").combine_chunks()), good, times, seed=int(current))

    for batch in batches:
        numbers = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for start, end in zip(edges, edges[1:], strict=False):
            if held and numbers[start] != current:
                yield built()
                held = []
            if end > start:
                current = numbers[start]
                held.append(batch.slice(start, end - start))
    if held:
        yield built()


def _total(blocks: DataFrame, use) -> np.ndarray:
    """The sum of use(block) over all blocks: each task adds up its own, then positions are added up.

    The blocks of a partition of the stored rows are whole, as its files are not split.
    """

    def run(batches):
        out = None
        for block in _each_block(batches):
            value = use(block)
            out = value if out is None else out + value
        if out is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(out), dtype=np.int64)), "value": pa.array(out, pa.float64())})

    parts = blocks.mapInArrow(run, "at long, value double")
    # sorted before they are added, so that the sum does not depend on the order of the tasks
    added = F.aggregate(F.array_sort(F.collect_list("value")), F.lit(0.0), lambda a, x: a + x)
    found = parts.groupBy("at").agg(added.alias("value")).toArrow().sort_by("at")
    return found.column("value").to_numpy()


def _strengths_at(blocks: DataFrame, ranking: Ranking, ranks: list[int]) -> np.ndarray:
    """Strengths of the labelled rows by their rank, exactly: ranges with the rank in it are halved further.

    A row that is in several blocks counts in its own.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"s": pa.array(ranking.strengths(_matrix(batch.column("features"))))})

    rows = stored(blocks.filter("own").select("features").mapInArrow(run, "s double"), "strengths")
    out = []
    for rank in ranks:
        low, high = rows.agg(F.min("s"), F.max("s")).first()
        while low < high:
            width = (high - low) / BINS
            bin_of = F.least(F.floor((F.col("s") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
            inside = rows.filter((F.col("s") >= low) & (F.col("s") <= high)).groupBy(bin_of.alias("bin"))
            found = inside.agg(F.count("s").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect()
            before = rows.filter(F.col("s") < low).count()
            for r in found:
                if before + r.n > rank:
                    low, high = r.low, r.high
                    break
                before += r.n
            if len(found) == 1 and low < high:  # the range cannot be parted further
                break
        out.append(low)
    return np.array(out)


def fit(rows: DataFrame, labels: DataFrame, sample: int | None = None) -> Ranking:
    """Learn from all labelled ones among measured rows.

    Equal rows count once. Held-out rows, labels other than 0 and 1 and doc_ids with
    contradicting labels are not used. `sample` is taken no more.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    )
    labelled = stored(rows.filter(~F.col("held_out")).join(known.select("doc_id", "quality"), "doc_id").distinct(), "labelled")
    goods, bads = labelled.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
    ranking = Ranking.empty()
    if not goods or not bads:
        _learn(ranking, goods, bads, lambda use: np.zeros(WIDTH), None)
        return ranking
    blocks = _blocks(labelled, goods, bads)
    _learn(ranking, goods, bads, lambda use: _total(blocks, use), lambda ranks: _strengths_at(blocks, ranking, ranks))
    return ranking


def score(rows: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id, held_out, score, predicted of measured rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            scores = ranking.scores(_matrix(batch.column("features")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= KEEP).astype(np.int32))],
                schema=schema,
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn and score: doc_id, held_out, score, predicted of every row of `docs`.

    Only texts enter a score. Repeated rows and null ids are scored row by row, null texts as
    empty ones; the whole of a long text is measured, in windows. Without labelled rows of
    both kinds nothing can be compared: all scores are 0.7, or near 0 if only bad rows are
    labelled. An empty table gives no rows. Other columns are ignored.
    """
    rows = stored(measured(docs), "measured")
    return score(rows, fit(rows, labels))

"""Hard-negative mining by threshold joins over an inverted index with L2 bounds.

Vectors are of integers, and a search asks, for some anchors, for the best rows whose inner
product is at least a threshold. Rows lie in blocks of bounded size; a block's inverted index
has posting lists by strips of dimensions, taken in one order for all (the strongest first).
A row is left out of the lists of all strips in which its remaining norm, times the longest
anchor's, stays below the lowest threshold: it could not reach it with these alone. A search
adds up partial products strip by strip, and drops a row as soon as for every anchor the
partial sum and the product of the remaining norms stay below the threshold. What is left is
scored exactly.

Searches start at a high threshold and lower it for the anchors that have not found enough,
until their windows are full or the threshold has reached the window's end. Anchors meet rows
block by block; only the best rows of every window leave a pair of blocks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Components of the rows of a block of the index, and of the anchors that are sent to it together.
BLOCK = 1 << 20
ANCHOR_BLOCK = 1 << 16
#: Anchors whose partial sums a task holds at once.
GROUP = 64
#: Dimensions of a strip.
STRIP = 8
#: Thresholds of the search for positives, as shares of the largest product that lengths allow; then none.
LEVELS = (0.7, 0.4, 0.15, 0.0)
#: Threshold of the first search for negatives, as percentage of the positive's score.
FIRST_LOW = 95

_LEAST, _MOST = -(1 << 62), 1 << 62
_WINDOW = "array<struct<key: long, low: long, high: long>>"


def integer_rows(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, label and the vector of floor(256 x) of the rows that take part, one for each vec_id.

    Left out are rows with a null id, label or vector or a null or non-finite component. Where
    rows repeat a vec_id, the one of the least label, then least vector, counts.
    """
    label, vec_id = F.col(label_column).cast("long"), F.col(id_column).cast("long")
    changed = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.select(vec_id.alias("vec_id"), changed.alias("label"), F.col(column).alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return (
        rows.groupBy("vec_id").agg(F.min(F.struct("label", whole.alias("vector"))).alias("row"))
        .select("vec_id", "row.label", "row.vector")
    )


def _matrix(column, width: int) -> np.ndarray:
    """Integer rows of an Arrow list column; missing components are zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _rest_norms(x: np.ndarray) -> np.ndarray:
    """Of every row, the norms of what follows strip 0, 1, ...; the whole row first."""
    squares = (x.astype(np.float64) ** 2).sum(axis=1, keepdims=True)
    edges = range(0, x.shape[1], STRIP)
    strips = np.stack([(x[:, i : i + STRIP].astype(np.float64) ** 2).sum(axis=1) for i in edges], axis=1) if x.shape[1] else np.zeros((len(x), 0))
    rest = np.concatenate([squares, squares - np.cumsum(strips, axis=1)], axis=1)
    return np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + 1e-3


class BlockIndex:
    """Posting lists of a block of rows for thresholds from `low` on and anchors up to `longest`."""

    def __init__(self, x: np.ndarray, low: float, longest: float):
        self.x, self.rest = x, _rest_norms(x)
        self.within = self.rest[:, 0] * longest >= low
        #: Strips in which each row is listed; its sums end there.
        self.listed = np.zeros(len(x), np.int64)
        self.lists = []
        for strip, at in enumerate(range(0, x.shape[1], STRIP)):
            rows = np.flatnonzero(self.rest[:, strip] * longest >= low)
            if not len(rows):
                break
            self.lists.append((rows, x[rows, at : at + STRIP].astype(np.float64)))
            self.listed[rows] = strip + 1

    def search(self, q: np.ndarray, low: np.ndarray):
        """(anchor number, row number, score) of all pairs whose score reaches the anchor's `low`."""
        rest = _rest_norms(q)
        sums = np.zeros((len(self.x), len(q)))
        alive = self.within.copy()
        for strip, (rows, values) in enumerate(self.lists):
            kept = alive[rows]
            rows, values = (rows, values) if kept.all() else (rows[kept], values[kept])
            part = sums[rows] + values @ q[:, strip * STRIP : (strip + 1) * STRIP].T.astype(np.float64)
            sums[rows] = part
            alive[rows] = (part + self.rest[rows, strip + 1, None] * rest[:, strip + 1] >= low).any(axis=1)
        rows = np.flatnonzero(alive)
        bound = sums[rows] + self.rest[rows, self.listed[rows], None] * rest[:, self.listed[rows]].T
        at, anchor = np.nonzero(bound >= low)
        score = np.concatenate(
            [(self.x[rows[at[i : i + 65536]]] * q[anchor[i : i + 65536]]).sum(axis=1) for i in range(0, len(at), 65536)] or [np.empty(0, np.int64)]
        )
        found = score >= low[anchor]
        return anchor[found], rows[at[found]], score[found]


def _best(k: int, key: str) -> Window:
    return Window.partitionBy("anchor_id", key).orderBy(F.desc("score"), "vec_id")


class Index:
    """The rows in blocks, written once to the shared folder."""

    def __init__(self, rows: DataFrame, block: int = BLOCK):
        energy = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("double") ** 2).alias("e"))
        #: Dimensions by falling energy; one number per dimension.
        self.order = np.array([r["at"] for r in energy.orderBy(F.desc("e"), "at").collect()], np.int64)
        square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        total, longest = rows.agg(F.count(F.lit(1)), F.max(square)).first()
        self.longest = float(longest or 0) ** 0.5
        self.blocks_n = max(1, -(-total * len(self.order) // block))
        self.blocks = stored(
            rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(self.blocks_n)).cast("int").alias("block"))
            .agg(F.collect_list(F.struct("vec_id", "label", "vector")).alias("rows")),
            "blocks",
        )

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor_id, key, vec_id, score: the best k rows of every window of every anchor.

        `asked` has anchor_id, label, vector and windows, an array of (key, low, high); rows of
        a window have scores from low to high, and the anchor's label or, where `same` is
        false, another one. Ties go to the smaller vec_id; the anchor itself is no row.
        """
        groups_n = max(1, -(-asked.count() * len(self.order) // ANCHOR_BLOCK))
        groups = asked.groupBy(F.pmod(F.xxhash64("anchor_id"), F.lit(groups_n)).alias("group")).agg(
            F.collect_list(F.struct("anchor_id", "label", "vector", "windows")).alias("anchors")
        )
        # the asked rows go to every block: a stated query set against all rows
        everywhere = groups.select("anchors", F.explode(F.sequence(F.lit(0), F.lit(self.blocks_n - 1))).alias("block"))
        pairs = everywhere.join(self.blocks, "block").select("rows", "anchors")
        order, width = self.order, len(self.order)
        schema = pa.schema([("anchor_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

        def run(batches):
            for batch in batches:
                for i in range(len(batch)):
                    rows, asks = batch.column("rows")[i].values, batch.column("anchors")[i].values
                    yield from _pair(rows, asks, order, width, k, same, schema)

        found = pairs.mapInArrow(run, "anchor_id long, key long, vec_id long, score long")
        best = _best(k, "key")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _pair(rows, asks, order: np.ndarray, width: int, k: int, same: bool, schema: pa.Schema):
    """The best rows of one block for one group of anchors."""
    ids, labels = rows.field("vec_id").to_numpy(), rows.field("label").to_numpy()
    x = _matrix(rows.field("vector"), width)[:, order]
    anchor_ids, anchor_labels = asks.field("anchor_id").to_numpy(), asks.field("label").to_numpy()
    q = _matrix(asks.field("vector"), width)[:, order]
    windows = asks.field("windows").to_pylist()
    lows = np.array([min(w["low"] for w in ws) for ws in windows], np.float64)
    index = BlockIndex(x, float(lows.min()), float(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)).max()) * (1 + 1e-9))
    for start in range(0, len(q), GROUP):
        part = slice(start, start + GROUP)
        anchor, row, score = index.search(q[part], lows[part])
        anchor = anchor + start
        fits = (labels[row] == anchor_labels[anchor]) == same
        fits &= ids[row] != anchor_ids[anchor]
        anchor, row, score = anchor[fits], row[fits], score[fits]
        ordered = np.lexsort((ids[row], -score, anchor))
        anchor, row, score = anchor[ordered], row[ordered], score[ordered]
        begins = np.searchsorted(anchor, np.arange(start, start + GROUP + 1))
        out = []
        for j in range(len(q[part])):
            own = slice(begins[j], begins[j + 1])
            down = -score[own]  # rising
            for w in windows[start + j]:
                first = own.start + int(np.searchsorted(down, -w["high"], "left"))
                last = min(first + k, own.start + int(np.searchsorted(down, -w["low"], "right")))
                if last > first:
                    out.append((anchor_ids[start + j], w["key"], row[first:last], score[first:last]))
        if out:
            counts = [len(o[2]) for o in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([o[0] for o in out], counts)), pa.array(np.repeat([o[1] for o in out], counts)),
                 pa.array(ids[np.concatenate([o[2] for o in out])]), pa.array(np.concatenate([o[3] for o in out]))],
                schema=schema,
            )


def _window(key: Column, low: Column, high: Column) -> Column:
    return F.array(F.struct(key.cast("long").alias("key"), low.cast("long").alias("low"), high.cast("long").alias("high"))).cast(_WINDOW)


def positives(index: Index, anchors: DataFrame, k: int) -> DataFrame:
    """anchor_id, vec_id, score: the first k other rows of the anchor's label.

    Thresholds fall level by level for the anchors that have not found k; without a threshold
    all rows are candidates, so the search ends there.
    """
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    reach = F.sqrt(square) * index.longest
    open_, done = anchors, []
    for low in [F.floor(reach * level) for level in LEVELS] + [F.lit(_LEAST)]:
        asked = open_.select("anchor_id", "label", "vector", _window(F.lit(0), low, F.lit(_MOST)).alias("windows"))
        found = stored(index.search(asked, k, True).select("anchor_id", "vec_id", "score"), "positives")
        full = found.groupBy("anchor_id").count().filter(F.col("count") == k).select("anchor_id")
        done.append((found, full))
        open_ = stored(open_.join(full, "anchor_id", "left_anti"), "anchors")
        if open_.isEmpty():
            break
    # of an anchor that the last level reached, all that it found; of the others what filled them
    rows = [found.join(full, "anchor_id", "left_semi") for found, full in done]
    rows.append(done[-1][0].join(open_.select("anchor_id"), "anchor_id", "left_semi"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return stored(out, "positives")


def mine(
    vectors: DataFrame, anchors: Column | None = None, n_positives: int = 5, n_negatives: int = 5, share: int = 80,
    id_column: str = "vec_id", column: str = "embedding", label_column: str = "label", block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which the condition on vec_id holds (by default: divisible by
    100). Positives are an anchor's first rows of its label, negatives of a positive the first
    rows of other labels that score between `share` percent of the positive's score and all of
    it; higher scores come first, ties by smaller vec_id. A positive of a negative score has
    an empty window, so no negatives.

    Rows are those of `integer_rows`; missing components of shorter vectors count as zero.
    Products must fit a long and 53 bits when summed, which holds for components up to 2^17
    and a thousand dimensions. An empty table gives no rows; other columns are ignored.
    """
    rows = stored(integer_rows(vectors, id_column, column, label_column), "rows")
    index = Index(rows, block)
    chosen = F.col("vec_id") % 100 == 0 if anchors is None else anchors
    asked = stored(rows.filter(chosen).withColumnRenamed("vec_id", "anchor_id"), "anchors")
    found = positives(index, asked, n_positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    floor_ = F.expr(f"(positive_score * {share} + 99) div 100")  # the least whole number not below the share
    open_ = found.filter("positive_score >= 0").withColumn("floor", floor_)
    first = F.greatest("floor", F.expr(f"(positive_score * {FIRST_LOW} + 99) div 100"))
    done = None
    for low in (first, F.col("floor")):
        open_ = open_.withColumn("low", low)
        windows = open_.groupBy("anchor_id").agg(
            F.collect_list(F.struct(F.col("positive_id").alias("key"), "low", F.col("positive_score").alias("high"))).alias("windows")
        )
        negatives = stored(
            index.search(asked.join(windows, "anchor_id"), n_negatives, False).select(
                "anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
            ),
            "negatives",
        )
        full = negatives.groupBy("anchor_id", "positive_id").count().filter(F.col("count") == n_negatives)
        closed = open_.join(full, ["anchor_id", "positive_id"], "left").withColumn("open", F.col("count").isNull() & (F.col("low") > F.col("floor")))
        closed = stored(closed.drop("count"), "windows")
        kept = negatives.join(closed.filter("NOT open").select("anchor_id", "positive_id", "positive_score"), ["anchor_id", "positive_id"])
        done = kept if done is None else done.union(kept)
        open_ = closed.filter("open").drop("open", "low")
    return done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(x::DOUBLE * 256) for x in embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

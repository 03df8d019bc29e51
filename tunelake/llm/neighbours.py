"""Approximate nearest neighbours by balanced posting lists.

Inner products become distances by one more coordinate that gives every vector the same
length. Centroids are fitted on a bounded sample, with a penalty on large clusters; each vector
goes to its nearest centroid's list and, near a border, to further ones (a centroid that lies
closer to a chosen one than to the vector adds nothing and is left out). Centroids sit in a
nearest-neighbour graph in memory; a query walks it and takes all lists whose distance is at
most a ratio times the nearest one. The ratio is fitted to a target recall, for a sample of the
queries that are asked. Samples are chosen and ordered by hash, so rows may come in any order.

Lists are cut into blocks of bounded rows, queries of a list likewise; a join by list pairs
blocks, and each pair gives the best ids of each of its queries. A query's nearest list is
searched first; from the others come only rows that are no worse than its k-th best there. So a list or a query that
many rows share is spread over tasks. Rows that repeat an id and its vector are merged before.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors that the index is fitted on, about.
SAMPLE = 16_000
#: Vectors of a list, on average, while the sample has eight vectors for each centroid.
LIST = 2000
#: Rows of a block: of a list, and of its queries.
BLOCK = 8192
QUERY_BLOCK = 256
TARGET = 0.975
BORDER = 1.10
COPIES = 3
NEIGHBOURS = 16
#: Lists that a walk over the graph keeps in view, at least, and queries that the ratio is fitted on, about.
WIDTH = 48
FITTED = 400


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part.

    Left out are null ids, vectors that are null, zero or have null or non-finite components,
    and those whose length is not the most common one (the smallest of several).
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("vector")).filter(
        F.col("vec_id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("vector") == (sizes["size"] if sizes else 0))


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column as double-precision rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Index:
    """Centroids, their graph and the pruning ratio; small, and sent to every task."""

    def __init__(
        self, sample: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, longest: float, lists: int,
        k: int, target: float = TARGET, seed: int = 0,
    ):
        """`asked` are queries like those to come; their own ids are none of their neighbours."""
        self.longest = longest
        points = self.stored_form(sample)
        self.centroids = self._cluster(points, lists, np.random.default_rng(seed))
        near = _distances(self.centroids, self.centroids)
        ranked = np.argsort(near, axis=1, kind="stable")[:, 1 : NEIGHBOURS + 1]
        ring = (np.arange(lists) + 1) % lists
        self.graph = [np.unique(np.append(r, n)) for r, n in zip(ranked, ring, strict=True)]
        self.between = near
        self.entries = self._spread(near)
        self.ratio = self._fit_ratio(sample, ids, points, asked, asked_ids, k, target)

    @staticmethod
    def _spread(near: np.ndarray) -> np.ndarray:
        """Entry points of a walk: about the root of the number of lists, each far from those before."""
        chosen = [int(near.sum(axis=1).argmin())]
        least = near[chosen[0]].copy()
        while len(chosen) < np.sqrt(len(near)):
            chosen.append(int(least.argmax()))
            least = np.minimum(least, near[chosen[-1]])
        return np.unique(chosen)

    def stored_form(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    @staticmethod
    def query_form(x: np.ndarray, longest: float) -> np.ndarray:
        """The query at the stored vectors' length, so that distance ratios mean the same for all."""
        scaled = x * (longest / np.sqrt((x * x).sum(1)))[:, None]
        return np.concatenate([scaled, np.zeros((len(x), 1))], axis=1)

    @staticmethod
    def _cluster(points: np.ndarray, lists: int, rng, rounds: int = 10) -> np.ndarray:
        centroids = points[rng.choice(len(points), lists, replace=False)].copy()
        penalty = np.zeros(lists)
        for _ in range(rounds):
            owner, least = np.empty(len(points), np.int64), np.empty(len(points))
            for i in range(0, len(points), 4096):
                cost = _distances(points[i : i + 4096], centroids) ** 2
                owner[i : i + 4096] = (cost + penalty).argmin(1)
                least[i : i + 4096] = cost.min(1)
            size = np.bincount(owner, minlength=lists)
            penalty += 0.1 * least.mean() * np.clip(size * lists / len(points) - 1, -1, 1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, owner, points)
            full = size > 0
            centroids[full] = sums[full] / size[full, None]
        return centroids

    def lists_of(self, points: np.ndarray) -> list[list[int]]:
        """The lists that store each vector, nearest first."""
        out = []
        distance = _distances(points, self.centroids)
        near = np.argsort(distance, axis=1, kind="stable")[:, : COPIES * 4]
        for row, order in zip(distance, near, strict=True):
            chosen: list[int] = []
            for c in order.tolist():
                if row[c] > BORDER * row[order[0]] or len(chosen) == COPIES:
                    break
                if all(self.between[c, other] >= row[c] for other in chosen):
                    chosen.append(c)
            out.append(chosen or [int(order[0])])
        return out

    def walk(self, query: np.ndarray, ratio: float):
        """(distance, list) of the lists within the ratio, nearest first, by a walk over the graph."""
        far = lambda nodes: np.sqrt(((self.centroids[nodes] - query) ** 2).sum(1))
        seen = np.zeros(len(self.centroids), bool)
        seen[self.entries] = True
        waiting = list(zip(far(self.entries).tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(waiting)
        found, best = [], waiting[0][0]
        view: list[float] = []  # distances, negated, of the WIDTH nearest so far: the farthest on top
        while waiting and (len(view) < WIDTH or waiting[0][0] <= max(-view[0], ratio * best * 1.05)):
            distance, node = heapq.heappop(waiting)
            found.append((distance, node))
            (heapq.heappush if len(view) < WIDTH else heapq.heappushpop)(view, -distance)
            fresh = self.graph[node][~seen[self.graph[node]]]
            seen[fresh] = True
            for d, n in zip(far(fresh).tolist(), fresh.tolist(), strict=True):
                heapq.heappush(waiting, (d, n))
                best = min(best, d)
        return sorted(x for x in found if x[0] <= ratio * best)

    def choose(self, query: np.ndarray, sizes: np.ndarray, k: int) -> list[int]:
        """Lists to search: those within the ratio, and more, in order, until they hold over k ids."""
        chosen = [n for _, n in self.walk(query, self.ratio)]
        if sizes[chosen].sum() <= k:
            chosen = np.argsort(((self.centroids - query) ** 2).sum(1), kind="stable").tolist()
            chosen = chosen[: int(np.searchsorted(np.cumsum(sizes[chosen]), k, "right")) + 1]
        return chosen

    def _fit_ratio(self, sample, ids, points, queries, query_ids, k, target):
        if not len(queries):
            return 1.0
        scores = queries @ sample.T
        scores[query_ids[:, None] == ids[None, :]] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        if not top.size:
            return 1.0
        distance = _distances(self.query_form(queries, self.longest), self.centroids)
        distance /= np.maximum(distance.min(1), 1e-12)[:, None]
        lists = dict(zip(np.unique(top).tolist(), self.lists_of(points[np.unique(top)]), strict=True))
        needed = [min(row[lists[n]]) for row, near in zip(distance, top.tolist(), strict=True) for n in near]
        return float(np.quantile(needed, target))


def _blocks(rows: DataFrame, size: int, name: str, *more: str) -> DataFrame:
    """Rows of (list, id, vector and more) as blocks of about `size` rows of one list."""
    counts = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / size)
    return (
        rows.join(counts, "list")
        .withColumn("block", F.pmod(F.xxhash64("id", "vector"), parts))
        .groupBy("list", "block")
        .agg(F.collect_list(F.struct("id", "vector", *more)).alias(name))
        .drop("block")
    )


def _sampled(rows: DataFrame, size: int, total: int):
    """vec_id and vector of about `size` of `total` rows, chosen and ordered by hash; one row at least if there is any."""
    h = F.xxhash64("vec_id", "vector")
    share = int((1 << 31) * min(1.0, size / max(1, total)))
    held = rows.select("vec_id", "vector", h.alias("h"))
    picked = held.filter(F.pmod("h", F.lit(1 << 31)) < share).toArrow()
    picked = (picked if len(picked) else held.orderBy("h").limit(1).toArrow()).combine_chunks().sort_by("h")
    if not len(picked):
        return np.empty(0, np.int64), np.empty((0, 0))
    return picked.column("vec_id").to_numpy(), _matrix(picked.column("vector").combine_chunks())


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", column: str = "embedding",
    list_size: int = LIST, sample: int = SAMPLE, target: float = TARGET,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k largest inner products found.

    `queries` has the columns of `vectors`; a query's own id is no candidate. Scores are inner
    products of the original vectors in double precision, ties go to the smaller vec_id. Rows
    that `usable` leaves out take no part on either side. Repeated vec_ids count as one
    candidate (the best of its rows), and as one query. Every row is indexed; the fit uses
    about `sample` rows, chosen by a hash of id and vector. An empty table of vectors or of
    queries gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    base = stored(usable(vectors, id_column, column).distinct(), "vectors")
    asked = usable(queries, id_column, column).distinct()
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, longest = base.agg(F.count(F.lit(1)), F.max(norm)).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    ids, points = _sampled(base, sample, total)
    lists = int(np.clip(round(total / list_size), 1, max(1, len(points) // 8)))
    index = Index(points, ids, *_sampled(asked, FITTED, asked.count())[::-1], float(np.sqrt(longest)), lists, k, target)

    placed_schema = pa.schema([("list", pa.int32()), ("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("own", pa.bool_())])

    def rows_of(batch, chosen, keep=slice(None)):
        counts = [len(c) for c in chosen]
        at = pa.array(np.repeat(np.arange(len(chosen)), counts))
        vectors_ = batch.column("vector").cast(pa.list_(pa.float64())).take(at)
        flat = np.array([c for cs in chosen for c in cs], np.int32)
        own = np.array([j == 0 for n in counts for j in range(n)], bool)
        return pa.RecordBatch.from_arrays(
            [pa.array(flat), batch.column("vec_id").take(at), vectors_, pa.array(own)], schema=placed_schema
        )

    def place(batches):
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                yield rows_of(part, index.lists_of(index.stored_form(_matrix(part.column("vector")))))

    placed = base.mapInArrow(place, "list int, id long, vector array<double>, own boolean")
    # an id whose vectors lie in several lists counts in one of them
    owners = placed.filter("own").groupBy("id").agg(F.min("list").alias("list"))
    own = {r["list"]: r.n for r in owners.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([own.get(i, 0) for i in range(lists)])  # one number per list

    def ask(batches):
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                points_ = index.query_form(_matrix(part.column("vector")), index.longest)
                yield rows_of(part, [index.choose(q, sizes, k) for q in points_])

    probes = asked.mapInArrow(ask, "list int, id long, vector array<double>, own boolean")
    stored_blocks = _blocks(placed.drop("own"), BLOCK, "stored")
    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def score(batches):
        for batch in batches:
            for i in range(len(batch)):
                base_ids, base_vectors = _block(batch.column("stored")[i].values)
                ask_ids, ask_vectors = _block(batch.column("asked")[i].values)
                bounds = np.nan_to_num(batch.column("asked")[i].values.field("bound").to_numpy(zero_copy_only=False), nan=-np.inf)
                order = np.argsort(base_ids, kind="stable")
                base_ids, base_vectors = base_ids[order], base_vectors[order]
                firsts = np.flatnonzero(np.concatenate([[True], base_ids[1:] != base_ids[:-1]]))
                rough = ask_vectors @ base_vectors.T
                out = []
                for query, row in enumerate(rough):
                    row[base_ids == ask_ids[query]] = -np.inf
                    per_id = np.maximum.reduceat(row, firsts)
                    kth = np.partition(per_id, -k)[-k] if len(per_id) > k else -np.inf
                    kth = max(kth, bounds[query])
                    slack = 1e-9 * (1 + abs(kth)) if np.isfinite(kth) else 0
                    near = np.flatnonzero((row >= kth - slack) & (row > -np.inf))
                    exact = (base_vectors[near] * ask_vectors[query]).sum(axis=1)
                    best = np.lexsort((base_ids[near], -exact))
                    best = best[np.sort(np.unique(base_ids[near][best], return_index=True)[1])[:k]]
                    out.append((np.full(len(best), ask_ids[query]), base_ids[near][best], exact[best]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=found_schema
                )

    def scored(rows):
        pairs = stored_blocks.join(_blocks(rows, QUERY_BLOCK, "asked", "bound"), "list").select("stored", "asked")
        return pairs.mapInArrow(score, "query_id long, vec_id long, score double")

    merged = lambda rows: rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    first = stored(scored(probes.filter("own").withColumn("bound", F.lit(None).cast("double"))), "first-lists")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = merged(first).withColumn("place", F.row_number().over(place)).filter(F.col("place") == k)
    bounds = kth.select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    found = merged(first.union(scored(probes.filter("NOT own").join(bounds, "id", "left"))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _block(structs):
    return structs.field("id").to_numpy(), _matrix(structs.field("vector"))

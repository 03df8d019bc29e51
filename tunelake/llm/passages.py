"""Removal of repeated passages by suffix order and longest-previous-factor arrays.

A byte is removed if it lies in a string of `length` bytes that also starts elsewhere (or, to
keep the first copy, that starts earlier). Sorting every suffix of a large corpus is not
needed: each window of `length` bytes is named by the least hash of the shorter grams in it,
its anchor, which depends on the window's bytes alone, so equal windows have equal anchors.
Consecutive windows of a document with one anchor make a run, about one per hundred bytes.

1. Runs are counted by anchor and content. A run whose content occurs again is a repeat as a
   whole. What is left open are anchors with several different contents.
2. One copy of each such content goes to the task that owns its anchor. There the windows'
   suffix array is built; with previous and next smaller text positions in suffix order, the
   longest-previous-factor test tells which windows have an earlier match (and, with the
   positions reversed, a later one).
3. An anchor with more contents than a task should hold has its windows counted by hash
   instead, in one aggregation.

Documents meet their windows again in a join by row, and the covered bytes go.

Texts are dealt by row once, and both steps that need them (2 and the last) read that exchange:
they are one query, with nothing stored in between. Runs are combined in their tasks and dealt by
anchor once, which counts them and the contents of their anchor; only contents that are copied
or share their anchor are stored. Disk is bounded so also while Spark, which removes exchanges
only after a garbage collection of the driver, has not yet removed those of earlier steps.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import by_bytes, keyed, stored

LENGTH = 400
#: Contents of one anchor that a task sorts; more are counted by hash.
CONTENTS = 2000
#: Bytes whose suffixes are sorted together, besides a group that is larger.
BLOCK_BYTES = 512 << 10
#: Runs that a task combines by content at once, before they are dealt by anchor.
COMBINED_RUNS = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            size = max(n, 2 * len(self.up))
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, inverse, np.uint64))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every gram of `size` bytes, from prefix sums."""
    up, down = _powers.get(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    h = (total[size:] - total[:-size]) * down[: len(data) - size + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of `width` values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def window_runs(data: bytes, length: int):
    """(starts, stops, anchors, contents) of the runs of windows of a text, as arrays.

    A run is the windows that start in [start, stop); its content, the bytes that they cover,
    is given by a 64-bit hash.
    """
    n = len(data) - length + 1
    if n < 1:
        return None
    gram = max(1, length // 3)
    hashes = gram_hashes(np.frombuffer(data, np.uint8), gram)
    least = sliding_min(hashes, length - gram + 1)
    new = np.empty(n, bool)
    new[0] = True
    # the anchor changes with its value, or where the window leaves its first gram of that value
    new[1:] = (least[1:] != least[:-1]) | (hashes[: n - 1] == least[:-1])
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], n)
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    spans = zip(starts.tolist(), (stops + (length - 1)).tolist(), strict=True)
    contents = np.fromiter((digest(view[a:b]) for a, b in spans), np.uint64, len(starts))
    return starts, stops, least[starts].view(np.int64), contents.view(np.int64)


def _runs(docs: DataFrame, length: int) -> DataFrame:
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "row_key")] + [(c, pa.int32()) for c in ("start", "stop")]
        + [(c, pa.int64()) for c in ("anchor", "content")]
    )

    def run(batches):
        for batch in by_bytes(batches, "text"):
            at, parts = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = window_runs(text.encode(), length)
                if found:
                    at.append(np.full(len(found[0]), i))
                    parts.append(found)
            if parts:
                rows = pa.array(np.concatenate(at))
                starts, stops, anchors, contents = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows), batch.column("row_key").take(rows),
                        pa.array(starts.astype(np.int32)), pa.array(stops.astype(np.int32)),
                        pa.array(anchors), pa.array(contents),
                    ],
                    schema=schema,
                )

    return docs.select("doc_id", "row_key", "text").mapInArrow(
        run, "doc_id long, row_key long, start int, stop int, anchor long, content long"
    )


def _counted(runs: DataFrame) -> DataFrame:
    """anchor, content, n, first (the least place) and variety, the contents of the anchor."""
    part = runs.mapInArrow(
        _combined, "anchor long, content long, n long, doc_id long, row_key long, start int, stop int"
    )
    place = F.struct("doc_id", "row_key", "start", "stop")
    # dealt by anchor, so that neither counting needs a further shuffle
    counted = part.repartition("anchor").groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.min(place).alias("first"))
    return counted.withColumn("variety", F.count(F.lit(1)).over(Window.partitionBy("anchor")))


def _combined(batches):
    """Each content among some of the runs once, with its number and its least place."""

    def combine(held):
        table = pa.Table.from_batches(held)
        anchor, content, key, start = (table[c].to_numpy() for c in ("anchor", "content", "row_key", "start"))
        known = table["doc_id"].is_valid().to_numpy()
        order = np.lexsort((start, key, table["doc_id"].fill_null(0).to_numpy(), known, content, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(content[order]) != 0)
        at = np.flatnonzero(new)
        least = table.take(pa.array(order[at])).add_column(0, "n", pa.array(np.diff(np.append(at, len(order)))))
        return least.select(["anchor", "content", "n", "doc_id", "row_key", "start", "stop"]).to_batches()

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= COMBINED_RUNS:
            yield from combine(held)
            held, rows = [], 0
    if rows:
        yield from combine(held)


def smaller_neighbours(position: np.ndarray):
    """For each index, the nearest index before and after it with a smaller value (-1, n if none).

    Pointers jump over indices that are known to be larger, all of them at once.
    """

    def before(values):
        link = np.arange(-1, len(values) - 1)
        open_ = 1 + np.flatnonzero(values[:-1] > values[1:])
        while len(open_):  # an index that is settled is not looked at again
            further = link[link[open_]]
            link[open_] = further
            open_ = open_[(further >= 0) & (values[further] > values[open_])]
        return link

    n = len(position)
    return before(position), n - 1 - before(position[::-1])[::-1]


def window_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes, compared by their first `length` bytes; equal windows have equal ranks.

    Ranks by 8 bytes are doubled until the next step would be too long; two overlapping
    windows then make up the length. Only integers are sorted, a few per byte.
    """

    def ranked(keys):
        return np.unique(keys, return_inverse=True)[1].astype(np.int64)

    def paired(rank, shift):
        behind = np.zeros(len(rank), np.int64)
        behind[: max(0, len(rank) - shift)] = rank[shift:] + 1
        return ranked(rank * (int(rank.max(initial=0)) + 2) + behind)

    step = 1
    rank = data.astype(np.int64)
    if length >= 8:
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        keys = np.zeros(len(data), np.uint64)
        for i in range(8):
            keys = (keys << np.uint64(8)) | padded[i : i + len(data)]
        rank, step = ranked(keys), 8
    while 2 * step <= length:
        rank, step = paired(rank, step), 2 * step
    return paired(rank, length - step) if step < length else rank


def matches(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int):
    """Which of the windows that begin at `starts` occur at a smaller, and at a larger position.

    `position` orders the windows in the text (all different). The windows are in suffix
    order, as in a suffix array cut at `length`; a window's longest previous factor is its
    match with the previous or the next smaller position in that order, and reaches `length`
    where one of the two is an equal window.
    """
    rank = window_ranks(data, length)[starts]
    order = np.argsort(rank, kind="stable")
    group = rank[order]
    outside = np.append(group, -1)  # index -1 and n: no neighbour

    def reaches(ranks):
        previous, following = smaller_neighbours(ranks)
        return (outside[previous] == group) | (outside[following] == group)

    earlier, later = np.empty(len(starts), bool), np.empty(len(starts), bool)
    earlier[order] = reaches(position[order])
    later[order] = reaches(-position[order])
    return earlier, later


def _intervals(flag: np.ndarray):
    """[from, to) of each stretch of true values."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_PLACES = "doc_id long, row_key long, a int, b int"
_PLACES_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _sorted_blocks(length: int, first: bool):
    """Repeated windows among the contents of anchors, whose rows come together."""

    def block(rows):
        """rows: doc_id, row_key, start, n, bytes."""
        doc_ids, keys, begin, n, parts = zip(*rows, strict=True)
        sizes = np.array([len(p) for p in parts])
        counts = sizes - (length - 1)
        owner = np.repeat(np.arange(len(parts)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(np.cumsum(sizes) - sizes, counts) + inside
        offset = np.array(begin)[owner] + inside
        known = np.array([d is not None for d in doc_ids])
        ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
        position = np.empty(len(starts), np.int64)
        position[np.lexsort((offset, np.array(keys)[owner], ids[owner], known[owner]))] = np.arange(len(starts))
        earlier, later = matches(np.frombuffer(b"".join(parts), np.uint8), starts, position, length)
        flag = earlier if first else (earlier | later) & (np.array(n) == 1)[owner]
        out, at = [], 0
        for i, count in enumerate(counts.tolist()):
            for a, b in zip(*_intervals(flag[at : at + count]), strict=True):
                out.append((doc_ids[i], keys[i], begin[i] + int(a), begin[i] + int(b)))
            at += count
        return out

    def run(batches):
        held, size, last = [], 0, None
        for batch in by_bytes(batches, "bytes"):
            for anchor, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last and size > BLOCK_BYTES:
                    yield _places(block(held))
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
                last = anchor
        if held:
            yield _places(block(held))

    return run


def _places(rows):
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _PLACES_ARROW, strict=True)], schema=_PLACES_ARROW
    )


def _cut_contents(length: int):
    """The bytes of the contents that a document stands for."""
    schema = pa.schema(
        [("anchor", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()),
         ("n", pa.int64()), ("bytes", pa.binary())]
    )

    def run(batches):
        for batch in by_bytes(batches, "text"):
            out = []
            used = (batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text", "runs"))
            for doc_id, key, text, wanted in zip(*used, strict=True):
                data = text.encode()
                out += [
                    (w["anchor"], doc_id, key, w["start"], w["n"], data[w["start"] : w["stop"] + length - 1])
                    for w in wanted
                    if w["doc_id"] == doc_id
                ]
            if not out:
                continue
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return run


def _window_hashes(length: int):
    schema = pa.schema([("anchor", pa.int64()), ("hash", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()),
                        ("at", pa.int32()), ("n", pa.int64())])

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in by_bytes(batches, "bytes", 128 << 10):
            out = [
                (anchor, digest(data[i : i + length]) - (1 << 63), doc_id, key, start + i, n)
                for anchor, doc_id, key, start, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for i in range(len(data) - length + 1)
            ]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, first: bool = False, contents: int = CONTENTS) -> DataFrame:
    """doc_id, row_key, a, b: windows of the documents that start in [a, b) occur elsewhere, or
    earlier if `first`. `docs` has doc_id, text and row_key; further columns are ignored.
    Stretches may touch.
    """
    runs = stored(_runs(docs, length), "passage-runs")
    place = F.struct("doc_id", "row_key", "start", "stop")
    counted = stored(_counted(runs).filter("n > 1 OR variety > 1"), "passage-contents")
    copied = counted.filter("n > 1").select("anchor", "content", "first")
    again = runs.join(copied, ["anchor", "content"])
    if first:
        again = again.filter(~F.col("first").eqNullSafe(place))
    whole = again.select("doc_id", "row_key", F.col("start").alias("a"), F.col("stop").alias("b"))

    def cut(crowded):
        """The bytes of the contents of anchors that are crowded, or are not."""
        wanted = (
            counted.filter(F.col("variety") > contents if crowded else F.col("variety").between(2, contents))
            .select("first.row_key", F.struct("first.doc_id", "anchor", "first.start", "first.stop", "n").alias("run"))
            .groupBy("row_key").agg(F.collect_list("run").alias("runs"))
        )
        # rows meet by row_key alone, so that one of equal rows is taken without another shuffle;
        # ids are compared in the worker
        copies = Window.partitionBy("row_key", "doc_id").orderBy(F.lit(0))
        return (
            docs.join(wanted, "row_key").select(docs["*"], wanted.runs)
            .withColumn("copy", F.row_number().over(copies)).filter("copy = 1").drop("copy")
            .mapInArrow(_cut_contents(length), "anchor long, doc_id long, row_key long, start int, n long, bytes binary")
        )

    near = (
        cut(crowded=False).repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(_sorted_blocks(length, first), _PLACES)
    )
    if counted.filter(F.col("variety") > contents).isEmpty():
        return whole.union(near)
    hashed = cut(crowded=True).mapInArrow(
        _window_hashes(length), "anchor long, hash long, doc_id long, row_key long, at int, n long"
    )
    spot = F.struct("doc_id", "row_key", "at")
    shared = hashed.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("times"), F.min(spot).alias("first"))
    crowd = hashed.join(shared.filter("times > 1"), ["anchor", "hash"])
    crowd = crowd.filter(~F.col("first").eqNullSafe(spot)) if first else crowd.filter("n = 1")
    places = crowd.select("doc_id", "row_key", F.col("at").alias("a"), (F.col("at") + 1).alias("b"))
    return whole.union(near).union(places)


def remove_passages(
    docs: DataFrame, length: int = LENGTH, first: bool = False, contents: int = CONTENTS,
    as_text: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept and the columns `carry` for every row of `docs`.

    Removed are the bytes in strings of `length` bytes that start more than once in the
    documents' UTF-8 bytes, as they came in; with `first`, only those that start earlier too,
    in the order of doc_id, row and offset (a null doc_id comes before others), so the first
    copy stays. Repeated rows are copies of each other; with `first` equal rows of one doc_id
    cannot be told apart and are both the first. Texts that are null or shorter than `length`
    lose nothing. Other columns are ignored. `kept` is binary and may end or begin inside a
    character; with `as_text` it is a string without such halves.
    """
    carried = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    rows = keyed(docs, *carried)
    places = repeated_windows(rows, length, first, contents)
    found = (
        places.select("row_key", F.struct("doc_id", "a", "b").alias("place"))
        .groupBy("row_key")
        .agg(F.collect_list("place").alias("places"))
    )
    kinds = [(f"carried_{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    schema = StructType.fromDDL(
        f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"
    )
    for name, kind in kinds:
        schema = schema.add(name, kind)

    def run(batches):
        for batch in by_bytes(batches, "text"):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "places"))
            out = [
                _without(text.encode(), [s for s in spots or [] if s["doc_id"] == doc_id], length)
                for doc_id, text, spots in zip(*columns, strict=True)
            ]
            *figures, kept = zip(*out, strict=True)
            kept = pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(f, pa.int64()) for f in figures), kept,
                 *(batch.column(n) for n, _ in kinds)],
                names=schema.names,
            )

    # all columns and the one key, as where contents are cut, so that Spark deals the texts once
    joined = rows.join(found, "row_key", "left").select(rows["*"], found.places)
    cut = joined.mapInArrow(run, schema)
    return cut.select(*schema.names[:5], *[F.col(n).alias(c) for (n, _), c in zip(kinds, carry, strict=True)])


def _without(data: bytes, places: list[dict], length: int):
    """Length, bytes removed, runs removed, and the rest, without the windows that start in the places."""
    pieces, end, removed, spans = [], 0, 0, 0
    for place in sorted(places, key=lambda s: s["a"]):
        a, b = place["a"], place["b"] + length - 1
        if a > end or not spans:
            pieces.append(data[end:a])
            spans, end = spans + 1, a
        if b > end:
            removed += b - end
            end = b
    pieces.append(data[end:])
    return len(data), removed, spans, b"".join(pieces)


def passage_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_passages(docs, length).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )

"""Scoring texts with an interpolated modified Kneser-Ney model of word pairs.

Tokens are the words of a text, A-Z in lower case, and one end; the first token's context is a
start mark. Counting goes through one shuffle: tasks send sorted, packed counts of the pairs
they met, split by the leading bits of the pair's hash; the task that owns a shard adds them
up, writes the shard as a sorted array of hashes with counts, and sends on what the words of
its pairs gain (occurrences, contexts, continuations, how many pairs were seen once, twice, or
more). Those are added up the same way into sorted arrays by word.

Array files go to the shared folder, named by the manifest of the attempts that counted.
Scoring tasks memory-map them there and look hashes up by binary search, so a worker holds no
more of the model than the pages it touches. Nothing of the model passes the driver but file
names and a dozen sums.
"""

import io
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, shared_folder, stored, whole_text

#: Tokens whose pairs a task counts before it sends them.
FLUSH = 2_000_000
END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds white space
START = xxhash.xxh3_64_intdigest(b"\n\n")
_FIELDS = ["raw", "continuations", "total", "once", "twice", "more"]


def tokens(text: str) -> np.ndarray:
    """64-bit hashes of the words, then the end."""
    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * np.uint64(0x9E3779B97F4A7C15)) ^ ((right << np.uint64(31)) | (right >> np.uint64(33)))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _contexts(texts: list[str]):
    """Of several texts: all tokens, the token before each, and the number per text."""
    parts = [tokens(t) for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    right = np.concatenate(parts)
    left = np.concatenate([[np.uint64(START)], right[:-1]])
    left[np.cumsum(counts)[:-1]] = START
    return left, right, counts


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length; small numbers are squeezed."""
    out = io.BytesIO()
    for c in columns:
        c = c if c.dtype == np.uint64 else c.astype(np.min_scalar_type(int(c.max(initial=0))))
        body = c.tobytes() if c.dtype == np.uint64 else zlib.compress(c.tobytes(), 1)
        out.write(np.array([c.itemsize, len(c), len(body)], np.int64).tobytes())
        out.write(body)
    return out.getvalue()


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        width, n, size = np.frombuffer(blob, np.int64, 3, at).tolist()
        body = blob[at + 24 : at + 24 + size]
        out.append(
            np.frombuffer(body, np.uint64) if width == 8 and size == 8 * n
            else np.frombuffer(zlib.decompress(body), f"u{width}").astype(np.int64)
        )
        at += 24 + size
    return out


def _sums(keys: np.ndarray, columns):
    """Distinct keys in order, where each begins, and the sums of the columns per key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], order[first], [np.add.reduceat(c[order], first) if len(first) else c for c in columns]


_PACKED = "shard int, counts binary"
_PACKED_ARROW = pa.schema([("shard", pa.int32()), ("counts", pa.binary())])


def _packed(shards, blobs):
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], schema=_PACKED_ARROW)


def _by_shard(keys: np.ndarray, bits: int):
    """(shard, slice) of sorted keys."""
    edges = np.searchsorted(_shard(keys, bits), np.arange((1 << bits) + 1))
    return [(s, slice(a, b)) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def _count_pairs(bits: int):
    def flush(lefts, rights):
        left, right = np.concatenate(lefts), np.concatenate(rights)
        keys, at, (n,) = _sums(pair_key(left, right), [np.ones(len(left), np.int64)])
        left, right = left[at], right[at]
        shards, blobs = [], []
        for s, rows in _by_shard(keys, bits):
            order = np.argsort(left[rows], kind="stable")
            l_, runs = np.unique(left[rows][order], return_counts=True)
            shards.append(s)
            blobs.append(_pack(l_, runs, right[rows][order], n[rows][order]))
        return _packed(shards, blobs)

    def run(batches):
        lefts, rights, held = [], [], 0
        for batch in by_bytes(batches, "text"):
            left, right, _ = _contexts(batch.column("text").to_pylist())
            lefts.append(left)
            rights.append(right)
            held += len(left)
            if held >= FLUSH:
                yield flush(lefts, rights)
                lefts, rights, held = [], [], 0
        if held:
            yield flush(lefts, rights)

    return run


def _local(folder: str) -> str:
    """The folder as a path that workers can map; it must be mounted at the same place on all."""
    path = re.sub(r"^file:/+", "/", folder)
    if re.match(r"\w+://?", path):
        raise ValueError(f"the model is memory-mapped; {folder} is not a mounted folder")
    return path


def _save(folder: str, name: str, **columns) -> str:
    import os

    os.makedirs(folder, exist_ok=True)
    stem = f"{folder}/{name}-{uuid.uuid4().hex}"
    for key, values in columns.items():
        np.save(f"{stem}.{key}.npy", values)
    return stem


def _each_shard(batches):
    """(shard, blobs) of rows that come sorted by shard."""
    shard, held = None, []
    for batch in batches:
        for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s != shard:
                if held:
                    yield shard, held
                shard, held = s, []
            held.append(blob)
    if held:
        yield shard, held


def _gains(left, right, n):
    """Words of some pairs, in order, with what each gains as a right and as a left word."""
    ends, _, as_right = _sums(right, [n, np.ones(len(n), np.int64)])
    starts, _, as_left = _sums(left, [n, *(c.astype(np.int64) for c in (n == 1, n == 2, n > 2))])
    words = np.union1d(ends, starts)
    sums = np.zeros((6, len(words)), np.int64)
    sums[:2, np.searchsorted(words, ends)] = as_right
    sums[2:, np.searchsorted(words, starts)] = as_left
    return words, sums


def _write_pairs(folder: str, bits: int):
    """Pair arrays of the shards; sends on the gains of words, and (shard -1) manifest lines."""

    def run(batches):
        for shard, blobs in _each_shard(batches):
            left, right, n = [], [], []
            for blob in blobs:
                l_, runs, r, c = _unpack(blob)
                left.append(np.repeat(l_, runs))
                right.append(r)
                n.append(c)
            left, right, n = (np.concatenate(c) for c in (left, right, n))
            keys, at, (n,) = _sums(pair_key(left, right), [n])
            left, right = left[at], right[at]
            big = np.flatnonzero(n >= 255)
            path = _save(folder, f"pairs-{shard:06d}", key=keys, n=np.minimum(n, 255).astype(np.uint8),
                         at=big, big=n[big])
            seen = np.array([(n == i).sum() for i in (1, 2, 3, 4)], np.int64)
            del keys
            words, sums = _gains(left, right, n)
            gains = _by_shard(words, bits)
            yield _packed([s for s, _ in gains], [_pack(words[rows], *(c[rows] for c in sums)) for _, rows in gains])
            yield _packed([-1], [f"pairs {shard} {path} {' '.join(map(str, seen.tolist()))}".encode()])

    return run


def _write_words(folder: str):
    schema = pa.schema([("line", pa.string())])

    def run(batches):
        for shard, blobs in _each_shard(batches):
            if shard < 0:
                yield pa.RecordBatch.from_arrays([pa.array([b.decode() for b in blobs])], schema=schema)
                continue
            columns = [np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True)]
            words, _, sums = _sums(columns[0], columns[1:])
            small = {f: c.astype(np.uint32 if c.max(initial=0) < 1 << 32 else np.int64) for f, c in zip(_FIELDS, sums, strict=True)}
            path = _save(folder, f"words-{shard:06d}", key=words, **small)
            raw, cont = sums[0], sums[1]
            figures = [raw.sum(), (raw > 0).sum(), cont.sum(), *((cont == i).sum() for i in (1, 2, 3, 4)), (cont > 2).sum()]
            line = f"words {shard} {path} {' '.join(str(int(x)) for x in figures)}"
            yield pa.RecordBatch.from_arrays([pa.array([line])], schema=schema)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more, from how many counts are 1 to 4.

    Where too few are seen to tell, 0.5, 1 and 1.5.
    """
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


def fit(docs: DataFrame, bits: int | None = None) -> dict:
    """Count the texts of `docs`; gives the model's files, sums and discounts.

    `bits`: the files are split by so many leading bits. By default there is about one shard
    for every two shuffle partitions, and eight at least.
    """
    spark = docs.sparkSession
    if bits is None:
        bits = max(3, int(np.ceil(np.log2(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) / 2)))))
    folder, shards = _local(shared_folder(spark, "kneser-ney")), 1 << bits
    texts = docs.select(whole_text().alias("text"))
    pairs = texts.mapInArrow(_count_pairs(bits), _PACKED).repartition(shards, "shard").sortWithinPartitions("shard")
    gains = pairs.mapInArrow(_write_pairs(folder, bits), _PACKED).repartition(shards, "shard").sortWithinPartitions("shard")
    manifest = stored(gains.mapInArrow(_write_words(folder), "line string"), "kneser-manifest")
    lines = [r.line.split(" ") for r in manifest.collect()]  # two lines per shard
    paths = {kind: {int(x[1]): x[2] for x in lines if x[0] == kind} for kind in ("pairs", "words")}
    sums = {k: np.sum([list(map(int, x[3:])) for x in lines if x[0] == k], axis=0) for k in ("pairs", "words")}
    seen = sums["pairs"].tolist() if paths["pairs"] else [0] * 4
    n, distinct, kinds, c1, c2, c3, c4, more = sums["words"].tolist() if paths["words"] else [0] * 8
    low = discounts(c1, c2, c3, c4)
    return {
        "bits": bits, "paths": paths, "tokens": n, "distinct": distinct, "kinds": kinds, "high": discounts(*seen),
        "low": low, "rest": (low[0] * c1 + low[1] * c2 + low[2] * more) / kinds if kinds else 1.0, "folder": folder,
    }


class _Arrays:
    """Memory-mapped arrays of a model, opened shard by shard."""

    def __init__(self, model: dict):
        self.model, self.open = model, {}

    def get(self, kind: str, shard: int, fields):
        if (kind, shard) not in self.open:
            path = self.model["paths"][kind].get(shard)
            self.open[kind, shard] = path and {f: np.load(f"{path}.{f}.npy", mmap_mode="r") for f in ("key", *fields)}
        return self.open[kind, shard]

    def find(self, kind: str, keys: np.ndarray, fields, value):
        """value(arrays, places, found) for sorted distinct keys, shard by shard, in one array."""
        out = []
        for shard, rows in _by_shard(keys, self.model["bits"]):
            arrays = self.get(kind, shard, fields)
            wanted = keys[rows]
            if arrays is None or not len(arrays["key"]):
                out.append(np.zeros((len(wanted), 6 if kind == "words" else 1), np.int64))
                continue
            place = np.minimum(np.searchsorted(arrays["key"], wanted), len(arrays["key"]) - 1)
            out.append(value(arrays, place) * (arrays["key"][place] == wanted)[:, None])
        return np.concatenate(out) if out else np.zeros((0, 1), np.int64)

    def words(self, keys):
        return self.find("words", keys, _FIELDS, lambda a, p: np.stack([a[f][p].astype(np.int64) for f in _FIELDS], 1))

    def pairs(self, keys):
        def value(a, p):
            n = a["n"][p].astype(np.int64)
            large = np.flatnonzero(n == 255)
            n[large] = a["big"][np.searchsorted(a["at"], p[large])]
            return n[:, None]

        return self.find("pairs", keys, ("n", "at", "big"), value)[:, 0]


@lru_cache(maxsize=1)
def _arrays(folder: str, model: "_Frozen") -> _Arrays:
    return _Arrays(model.model)


class _Frozen:
    """A model as a key of the worker's cache."""

    def __init__(self, model):
        self.model = model

    def __hash__(self):
        return hash(self.model["folder"])

    def __eq__(self, other):
        return self.model["folder"] == other.model["folder"]


def _discount(counts: np.ndarray, d) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def token_scores(arrays: _Arrays, left: np.ndarray, right: np.ndarray):
    """log10 P(right | left) of each token, and its training count."""
    m = arrays.model
    words, place = np.unique(np.concatenate([right, left]), return_inverse=True)
    facts = arrays.words(words)[place]
    raw, cont = facts[: len(right), 0], facts[: len(right), 1]
    total, once, twice, more = facts[len(right) :, 2:].T
    keys, place = np.unique(pair_key(left, right), return_inverse=True)
    n = arrays.pairs(keys)[place]
    uniform = m["rest"] / (m["distinct"] + 1)
    lower = (cont - _discount(cont, m["low"])) / max(m["kinds"], 1) + uniform
    known = total > 0
    size = np.where(known, total, 1)
    back = np.where(known, (np.stack([once, twice, more], 1) @ np.array(m["high"])) / size, 1.0)
    upper = np.where(known, (n - _discount(n, m["high"])) / size, 0.0)
    return np.log10(upper + back * lower), raw


def score(docs: DataFrame, model: dict, *extra) -> DataFrame:
    """doc_id, (extra columns,) n_tokens, n_known, base_score, score of every row of `docs`."""
    frozen = _Frozen(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, whole_text().alias("text"))
    names = texts.columns[:-1]
    figures = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(batches):
        arrays = _arrays(model["folder"], frozen)
        for batch in by_bytes(batches, "text"):
            left, right, counts = _contexts(batch.column("text").to_pylist())
            logs, raw = token_scores(arrays, left, right)
            base = np.log10((raw + 0.1) / (model["tokens"] + 0.1 * (model["distinct"] + 1)))
            doc = np.repeat(np.arange(len(counts)), counts)
            per = lambda values: np.bincount(doc, weights=values, minlength=len(counts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(counts), pa.array(per(raw > 0).astype(np.int64)),
                 pa.array(per(base)), pa.array(per(logs))],
                names=[*names, *(f for f, _ in figures)],
            )

    kinds = ", ".join(f"{c} {t}" for c, t in texts.dtypes[:-1])
    return texts.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base_score double, score double")


def held_out(parts: int):
    """Whether a document is kept from learning: crc32 of its id, as text, divides by `parts`.

    A null id is not held out.
    """
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % parts == 0, F.lit(False))


def score_documents(docs: DataFrame, parts: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model learns from all rows that are not held out. Null texts count as empty: one
    token, the end. Repeated rows count as often as they come. Without training rows every
    token has probability one over one. Other columns are ignored.
    """
    model = fit(docs.filter(~held_out(parts)))
    scored = score(docs, model, held_out(parts).alias("held_out"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        "base_score", "score",
    )

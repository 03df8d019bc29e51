"""Near-duplicate grouping of SimHash fingerprints by pigeonhole blocks.

A fingerprint has 64 bits, cut into six blocks. Two fingerprints that differ in at most four
bits agree in at least two blocks, so they share a key in one of the fifteen tables (pairs of
blocks). Within a key, distances are verified and only the edges of a spanning star per
connected set are given out, never all pairs. A key with more than `group` distinct
fingerprints is divided again: its remaining bits are cut into five blocks, of which a close
pair shares one. Fingerprints that are still crowded after two divisions lie close together;
their key is cut into parts, and a task compares two parts, so no group outgrows one task.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, keyed, stored
from .graph import components

BITS = 64
BLOCKS = 6
DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Distinct fingerprints compared with each other at once.
GROUP = 1024
#: Times that crowded keys are divided by further bits.
DIVISIONS = 2
#: Shingle hashes whose bits are counted at once.
_COUNTED = 1 << 16


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each word shingle, in order, with repeats.

    A-Z is lower-cased; a text with fewer words than a shingle has one, the whole sequence; a
    text without words has none.
    """
    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(tokens))
    n = len(tokens) - size + 1
    spans = zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def majority(hashes: np.ndarray) -> bytes:
    """The bits that are set in over half of the hashes, 64 to a hash; zero without hashes."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _COUNTED):
        part = hashes[k : k + _COUNTED].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """The SimHash of a text over its word shingles, each occurrence counted, as an unsigned integer.

    A text without words has fingerprint zero.
    """
    return int.from_bytes(majority(shingle_hashes(text, words)), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, row_key and fp (signed 64-bit) of every row; null texts count as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in by_bytes(batches, "text"):
            prints = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(np.array(prints, np.uint64).view(np.int64))],
                schema=schema,
            )

    return keyed(docs).mapInArrow(run, "doc_id long, row_key long, fp long")


def _masks(free: list[int], parts: int, picked: int) -> list[int]:
    """Masks over `picked` of the `parts` blocks that the free bit positions are cut into."""
    blocks = [sum(1 << int(b) for b in block) for block in np.array_split(free, parts)]
    return [sum(chosen) for chosen in combinations(blocks, picked)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def connected(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that it is connected with."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def _stars(distance: int):
    """For each row with an array `fps`: links of every fingerprint to the first of its connected set."""

    def run(frames):
        for frame in frames:
            sources, targets = [], []
            for values in frame["fps"]:
                fps = np.asarray(values, np.int64)
                unsigned = fps.view(np.uint64)
                near = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= distance
                label = connected(near)
                other = label != np.arange(len(fps))
                sources.append(fps[other])
                targets.append(fps[label[other]])
            if sources:
                yield pd.DataFrame({"a": np.concatenate(sources), "b": np.concatenate(targets)})

    return run


def _pairs_of_parts(rows: DataFrame, crowded: DataFrame, keys: list[str], group: int) -> DataFrame:
    """Arrays `fps`, of about `group` fingerprints, in which any two of one key meet."""
    cut = (
        rows.join(crowded, keys)
        .withColumn("parts", F.ceil(F.col("n") * 2 / group).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    pair = [F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")]
    return cut.groupBy(*keys, *pair).agg(F.collect_list("fp").alias("fps")).select("fps")


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs at most `distance` apart.

    `distinct` has one column fp, each value once.
    """
    masks = _masks(list(range(BITS)), blocks, blocks - distance)
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = None
    for division in range(DIVISIONS + 1):
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = stored(
            rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-keys"
        )
        gathered = (
            rows.join(sizes.filter(F.col("n") <= group).drop("n"), ["mask", "key"])
            .groupBy("mask", "key")
            .agg(F.collect_list("fp").alias("fps"))
        )
        edges = gathered.select("fps").mapInPandas(_stars(distance), "a long, b long")
        found = edges if found is None else found.union(edges)
        crowded = sizes.filter(F.col("n") > group)
        again = [r.mask for r in crowded.select("mask").distinct().collect()]  # 375 masks at most
        if not again:
            return found
        if division == DIVISIONS:
            pairs = _pairs_of_parts(rows, crowded, ["mask", "key"], group)
            return found.union(pairs.mapInPandas(_stars(distance), "a long, b long"))
        crowded = crowded.drop("n")
        finer = {}
        for mask in again:
            free = [b for b in range(BITS) if not mask >> b & 1]
            finer[mask] = [mask | _signed(m) for m in _masks(free, min(distance + 1, len(free)), 1)]
        table = F.create_map(
            *[x for m, more in finer.items() for x in (F.lit(m), F.array(*[F.lit(f) for f in more]))]
        )
        rows = (
            rows.join(crowded, ["mask", "key"])
            .select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
            .distinct()
        )


def near_groups(
    docs: DataFrame, words: int = SHINGLE, distance: int = DISTANCE, blocks: int = BLOCKS, group: int = GROUP
) -> DataFrame:
    """doc_id, fp (signed), component_id, row_key for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id among the rows whose fingerprints are connected by
    steps of at most `distance` bits. Null texts count as empty, and all empty texts have
    fingerprint zero; null doc_ids take part in grouping but never name a component (it is
    null if all are). Repeated rows are given back as often as they come; other columns are
    ignored.
    """
    prints = stored(fingerprints(docs, words), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), distance, blocks, group)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id", "row_key"
    )

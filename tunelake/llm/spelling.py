"""Grouping of spelling variants by PartEnum signatures.

A word is seen as its multiset of letters, a binary vector with one dimension per letter and
occurrence number. One replaced letter changes two dimensions, one inserted or deleted letter
one. The dimensions are dealt to parts; vectors that differ in at most k dimensions agree in
all but k parts, so every choice of parts without k of them gives a signature, and near words
share at least one. Words of equal length are compared with k = 2, words of lengths m and
m + 1 with k = 1. Near words also agree in their first or in their last half, so a half is part
of every signature; permutations of the same letters, of which a vocabulary is full, do not
crowd one signature then. Signatures are joined by equality, pairs are verified.

All joins are sort-merge joins by hint. Spark sizes a stored table by its compressed file, and
takes `signed` for as large as the words it came from, though it has some thirty rows per word:
left to choose, it broadcasts them through the driver.
"""

import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stored, whole_text

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: How many times a form must occur for each occurrence of its variant.
MORE = 5
#: Runs whose hash this number divides lose a letter.
DAMAGE = 199
#: Parts of the vector for words of equal length (two differences) and of neighbouring lengths (one).
EQUAL_PARTS, LONGER_PARTS = 5, 3
#: Characters that are searched at once, and words that a task counts before it sends them.
SLICE = 1 << 20
FLUSH = 300_000

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_OUTSIDE = re.compile("[^a-zÀ-ÿ]")


def _slices(text: str):
    """The text in slices that end outside runs."""
    start = 0
    while len(text) - start > SLICE:
        match = _OUTSIDE.search(text, start + SLICE)
        end = match.start() if match else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def words_of(doc_id: int | None, text: str):
    """(word, occurrences) of a text's runs that are long enough, after the damage; a word may come more than once."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for part in _slices(text.encode().lower().decode()):
        counts: dict[str, int] = {}
        for run in _RUN.findall(part):
            counts[run] = counts.get(run, 0) + 1
        for run, n in counts.items():
            h = zlib.crc32(run.encode(), start)
            if h % DAMAGE == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
            yield run, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough in all documents; null texts hold none."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        counts: dict[str, int] = {}
        for batch in by_bytes(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for word, n in words_of(doc_id, text.as_py()):
                    counts[word] = counts.get(word, 0) + n
                    if len(counts) >= FLUSH:
                        yield _counted(counts, schema)
                        counts.clear()
        yield _counted(counts, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def _counted(counts: dict[str, int], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit numbers, mixed."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _part_sums(words: list[str], parts: int) -> np.ndarray:
    """Of each word and part, a hash of the dimensions that are set there."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    number = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((letter, number))
    letter, number = letter[order], number[order]
    new = np.concatenate([[True], (letter[1:] != letter[:-1]) | (number[1:] != number[:-1])])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(letter)), 0))
    occurrence = np.arange(len(letter)) - begin
    value = _mixed((letter.astype(np.uint64) << np.uint64(32)) | occurrence.astype(np.uint64))
    value = _mixed(value + np.uint64(0x9E3779B97F4A7C15))
    part = (value >> np.uint64(40)) % np.uint64(parts)
    sums = np.zeros((len(words), parts), np.uint64)
    np.add.at(sums, (number, part.astype(np.int64)), value)
    return sums


def signatures(words: list[str]) -> np.ndarray:
    """One row of signatures per word, none repeated within a word but by chance."""
    columns = []
    halves = {}
    for longer in (False, True):  # the word as the shorter or equal one of a pair, or as the longer one
        for last in (False, True):
            keys = np.empty(len(words), np.uint64)
            for i, w in enumerate(words):
                least = len(w) - longer
                half = least // 2
                keys[i] = xxhash.xxh3_64_intdigest(f"{least} {last:d} {w[half - least:] if last else w[:half]}")
            halves[longer, last] = keys
    for parts, differences, roles in ((EQUAL_PARTS, 2, (False,)), (LONGER_PARTS, 1, (False, True))):
        sums = _part_sums(words, parts)
        for number, chosen in enumerate(combinations(range(parts), parts - differences)):
            vector = np.full(len(words), 100 * parts + number, np.uint64)
            for p in chosen:
                vector = _mixed(vector * np.uint64(31) + sums[:, p])
            columns += [_mixed(halves[longer, last] + vector) for longer in roles for last in (False, True)]
    return np.stack(columns, axis=1)


def signed(words: DataFrame) -> DataFrame:
    """(key, word, n), a row per word and signature."""
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in by_bytes(batches, "word", 1 << 18):
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                keys = signatures(part.column("word").to_pylist())
                at = pa.array(np.repeat(np.arange(len(part)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), part.column("word").take(at), part.column("n").take(at)], schema=schema
                )

    return words.mapInArrow(run, "key long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a before b, of the words one letter apart; each pair once."""
    rows = signed(words)
    left = rows.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rows.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    candidates = left.join(right.hint("merge"), "key").filter("a < b")
    return candidates.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) without cycles: the last word that forms lead to.

    Every round doubles the steps that a word looks ahead.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = stored(further, "roots")
        now = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if
    that occurs MORE times as often, else null; root is where forms lead to. Repeated rows count as
    often as they stand; a null doc_id enters the damage as an empty text; null and empty
    texts and an empty table give no words. Runs of any length are words. Other columns are
    ignored.
    """
    words = stored(vocabulary(docs), "words")
    pairs = near_pairs(words)
    both = pairs.select(
        F.explode(F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
        )).alias("p")
    ).select("p.*")
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first")
    )
    found = words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("first.less") >= MORE * F.col("n"), F.col("first")).alias("first"),
    )
    found = stored(found.select("word", F.col("first.near").alias("form"), "n", "n_near", (-F.col("first.less")).alias("form_n")), "forms")
    led = roots(found.filter("form IS NOT NULL"))
    return found.join(led.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

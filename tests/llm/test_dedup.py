"""Exact, near and passage deduplication against plain Python, with awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tunelake.llm import exact_dedup, graph, passages, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in rng.integers(0, 19, (n, 2)).tolist())


LONG = prose(1, 4000)
TEXTS = [
    (1, prose(2, 40)), (2, prose(2, 40).upper()), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "one two three"),
    (8, LONG), (9, LONG + " tail"), (10, prose(2, 40)), (10, prose(2, 40)), (None, prose(2, 40)), (None, "one"),
    (11, "a  b\tc"), (12, "a b c"), (13, "é ü ß " * 30), (14, "x" * 900), (15, prose(3, 300)), (16, prose(3, 299) + " y"),
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s", 0, False) for i, t in TEXTS]
    # further columns, some with the names of results
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, keep_id string, n_bytes int, kept boolean").repartition(3)


@pytest.fixture
def none(docs):
    return docs.limit(0)


def squeeze(text):
    out, space = [], False
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if not space:
                out.append(" ")
            space = True
        else:
            out.append(c)
            space = False
    return "".join(out)


@pytest.mark.parametrize("bits, capacity", [(64, 50_000), (3, 2)])
def test_exact_groups(docs, bits, capacity):
    """With three bits of hash, different texts share hashes and are chained."""
    hashing = lambda t: F.shiftleft(F.xxhash64(t), 64 - bits)
    got = exact_dedup.exact_groups(docs, hashing, capacity, 4).collect()
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[squeeze(t)].append(i)
    assert len(got) == len(TEXTS)
    want = sorted(
        (str(i), str(min((x for x in groups[squeeze(t)] if x is not None), default=None)), len(groups[squeeze(t)]),
         hashlib.sha256(squeeze(t).encode()).hexdigest())
        for i, t in TEXTS
    )
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


@pytest.mark.parametrize("capacity, max_depth", [(100, 8), (2, 20), (5000, 8)])
def test_directory_splits(spark, capacity, max_depth):
    keys = spark.range(1000).select(F.xxhash64("id").alias("h"))
    slots, depth = exact_dedup.directory(keys, capacity, max_depth)
    assert sorted(r.slot for r in slots.collect()) == list(range(1 << depth))
    placed = keys.withColumn("slot", exact_dedup._slot(F.col("h"), depth)).join(slots, "slot")
    load = placed.groupBy("depth", "bucket").count()
    assert load.agg(F.max("count")).first()[0] <= capacity
    assert load.agg(F.sum("count")).first()[0] == 1000
    # no bucket was split without need: with its sibling's keys it would be overfull
    pairs = load.filter("depth > 0").groupBy("depth", F.shiftright("bucket", 1).alias("parent")).agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("of")
    )
    assert pairs.filter(f"of = 2 AND n <= {capacity}").count() == 0


def test_directory_stops_at_its_finest(spark):
    """Keys that no bit parts stay in one overfull bucket."""
    slots, depth = exact_dedup.directory(spark.range(10).select(F.col("id").alias("h")), 2, 3)
    assert depth == 3 and slots.count() == 8


@pytest.mark.parametrize("bits", [64, 1])
def test_index_chains(spark, bits):
    """Copies in many partitions, hashes that collide: chains part texts by their bytes."""
    rows = [(i, f"text {i % 7}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    hashing = lambda t: F.shiftleft(F.xxhash64(t), 64 - bits)
    index = exact_dedup.build_index(docs, hashing, 2, 6).collect()
    assert sorted((r.keep_id, r.group_size) for r in index) == [(i, 100) for i in range(7)]
    chains = defaultdict(list)
    for r in index:
        chains[r.depth, r.bucket, r.h].append(r.chain)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in chains.values())
    assert bits == 64 or max(map(len, chains.values())) > 1


def test_exact_empty(none):
    assert exact_dedup.exact_groups(none).collect() == []


def plain_fingerprint(text, size=4):
    words = [w for w in squeeze(text).translate({c: c + 32 for c in range(65, 91)}).split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    root = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("group", [1024, 2])
def test_near_groups(docs, group):
    got = simhash.near_groups(docs, group=group).collect()
    prints = [plain_fingerprint(t or "") for _, t in TEXTS]
    root = plain_components(prints, 4)
    want = sorted(
        (str(i), p, str(min((TEXTS[k][0] for k in range(len(TEXTS)) if root[k] == r and TEXTS[k][0] is not None), default=None)))
        for (i, _), p, r in zip(TEXTS, prints, root, strict=True)
    )
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("group", [1000, 3])
def test_links_connect_what_all_pairs_connect(spark, group):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 30)
    prints = {int(s) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5))) for s in seeds for _ in range(8)}
    prints = sorted(prints)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), group=group)
    found = {r.a: r.b for r in graph.components(edges).collect()}
    root = plain_components(prints, 4)
    least = {r: min(p for p, q in zip(prints, root, strict=True) if q == r) for r in root}
    assert {p: least[r] for p, r in zip(prints, root, strict=True) if least[r] != p} == found


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(70, 70), (80, 81)], "a long, b long")
    assert {r.a: r.b for r in graph.components(edges).collect()} == {**{i: 0 for i in range(1, 13)}, 81: 80}


def test_near_empty(none):
    assert simhash.near_groups(none).collect() == []


def plain_removal(texts, length, first):
    places = defaultdict(list)
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0, k))
    data = [(t or "").encode() for _, t in texts]
    for k in order:
        for i in range(len(data[k]) - length + 1):
            places[data[k][i : i + length]].append((texts[k][0], texts[k][1], i))
    out = []
    for (doc, text), b in zip(texts, data, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            found = places[b[i : i + length]]
            if len(found) > 1 and not (first and found[0] == (doc, text, i)):
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(doc), len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


@pytest.mark.parametrize("length, first, contents", [(400, False, 2000), (40, False, 2000), (40, True, 2000), (40, False, 1), (40, True, 1), (1, False, 2000)])
def test_passages(spark, length, first, contents):
    texts = [(i, t) for i, t in TEXTS if i not in (8, 9)] if length == 1 else TEXTS
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, n_bytes int").repartition(3)
    got = passages.remove_passages(docs, length, first, contents).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_removal(texts, length, first)


def test_passages_carry_and_text(spark):
    docs = spark.createDataFrame([(1, "é" * 40, "fr"), (2, "xé" + "é" * 39 + "y", None)], "doc_id long, text string, kept string")
    got = passages.remove_passages(docs, 41, as_text=True, first=True, carry=("kept",))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept"]
    assert [tuple(r)[4] for r in got.orderBy("doc_id").collect()][1] == "xy"


@pytest.mark.parametrize("contents", [2000, 1])
def test_passages_of_repeated_first_rows(spark, contents):
    """Equal rows are both the first copy; a null doc_id too."""
    shared, texts = prose(50, 30), []
    for i in (1, None):
        own = prose(60 if i else 61, 30) + " " + shared
        texts += [(i, own + prose(51, 20)), (i, own + prose(51, 20))]
    texts.append((2, shared + " " + prose(52, 20)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = passages.remove_passages(docs, 40, True, contents).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_removal(texts, 40, True)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)


def test_passages_empty(none):
    assert passages.passage_digests(none).collect() == []


@pytest.mark.parametrize("contents", [2000, 1])
@pytest.mark.parametrize("carry", [(), ("kept",)])
def test_passages_deal_texts_once(spark, capsys, carry, contents):
    """The bytes of contents and what is left of the texts come from one shuffle of the texts."""
    shared = prose(50, 30)
    texts = [(i, prose(60 + i, 30) + shared + prose(80 + i, 30), "en") for i in range(9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, kept string").repartition(3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = passages.remove_passages(docs, 40, bool(carry), contents, bool(carry), carry)
        assert all(r.n_removed > 0 for r in got.collect() if r.doc_id or not carry)
        got.explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    reused = re.findall(r"ReusedExchange \[Reuses.*\n+Output.*\btext#", capsys.readouterr().out)
    assert len(reused) == (1 if contents == 2000 else 2)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_runs_combined(monkeypatch, size):
    """However many runs are combined at once, the numbers add up and the least place stays."""
    rng = np.random.default_rng(size)
    rows = [(None if d == 0 else d, int(k), int(s), int(s) + 1, int(a), int(c)) for d, k, s, a, c in rng.integers(0, 4, (200, 5)).tolist()]
    names = ["doc_id", "row_key", "start", "stop", "anchor", "content"]
    table = pa.table({n: pa.array(v, pa.int64()) for n, v in zip(names, zip(*rows, strict=True), strict=True)})
    monkeypatch.setattr(passages, "COMBINED_RUNS", size)
    total, least = Counter(), {}
    for batch in passages._combined(iter(table.to_batches(max_chunksize=3))):
        for r in batch.to_pylist():
            key, place = (r["anchor"], r["content"]), (r["doc_id"] is not None, r["doc_id"] or 0, r["row_key"], r["start"])
            total[key] += r["n"]
            least[key] = min(place, least.get(key, place))
    assert total == Counter((a, c) for *_, a, c in rows)
    for (a, c), place in least.items():
        assert place == min((d is not None, d or 0, k, s) for d, k, s, _, x, y in rows if (x, y) == (a, c))


def test_smaller_neighbours():
    values = np.random.default_rng(0).permutation(200)
    before, after = passages.smaller_neighbours(values)
    for i, v in enumerate(values):
        assert before[i] == max((k for k in range(i) if values[k] < v), default=-1)
        assert after[i] == min((k for k in range(i + 1, 200) if values[k] < v), default=200)


def test_matches_by_length():
    data = np.frombuffer(b"abcabcabdabc", np.uint8)
    starts = np.arange(10)
    earlier, later = passages.matches(data, starts, starts, 3)
    whole = bytes(data)
    for i in starts:
        same = [k for k in starts if whole[k : k + 3] == whole[i : i + 3]]
        assert earlier[i] == (min(same) < i) and later[i] == (max(same) > i)


@pytest.mark.parametrize("runs", [1, 7, 300])
def test_smaller_neighbours_of_rising_runs(runs):
    """What ends a long rising run looks back over the whole of it."""
    order = np.random.default_rng(runs).permutation(300)
    values = np.concatenate([np.sort(run) for run in np.array_split(order, runs)])
    before, after = passages.smaller_neighbours(values)
    for i, v in enumerate(values):
        assert before[i] == max((j for j in range(i) if values[j] < v), default=-1)
        assert after[i] == min((j for j in range(i + 1, 300) if values[j] < v), default=300)

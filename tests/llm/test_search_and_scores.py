"""Neighbours, language-model scores and toxicity against plain Python, with awkward rows."""

import zlib
from collections import Counter, defaultdict
from math import isclose, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.llm import kneser, neighbours, toxicity
from tunelake.llm.chunks import ChunkTable


def plain_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        found = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)[:k]
        out[q] = found
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_and_recall(spark, seed):
    """All queries lie in one of twenty clusters."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    rows[40] = (40, rows[20][1])  # equal vectors
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = neighbours.nearest(df, df.filter("vec_id % 20 = 0"), 10, list_size=150).collect()
    want = plain_nearest(rows, rows[::20], 10)
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == set(want)
    hits = 0
    for q, found in by.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda x: (-x[2], x[1])) or [x[0] for x in found] == list(range(1, 11))
        hits += len({i for _, i in want[q]} & {i for _, i, _ in found})
        assert all(isclose(s, float(np.dot(np.float64(rows[q][1]), np.float64(rows[i][1])))) for _, i, s in found)
    assert hits / (10 * len(want)) >= 0.9


def test_nearest_with_few_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]),
            (7, [1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (2, [0.5, 0.5]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(df, df, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (1, 1, 0, 1.0), (1, 2, 2, 0.5), (2, 1, 0, 0.5), (2, 2, 1, 0.5)]
    assert neighbours.nearest(df.limit(0), df).collect() == []
    assert neighbours.nearest(df, df.limit(0)).collect() == []


def test_nearest_of_one_common_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(300 + i, [float(i), 1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id IN (0, 7)"), 3, list_size=50).orderBy("query_id", "rank").collect()
    want = plain_nearest(rows, [rows[0], rows[7]], 3)
    assert [(r.query_id, r.vec_id) for r in got] == [(q, i) for q in (0, 7) for _, i in want[q]]


@pytest.mark.parametrize("same", [True, False])
def test_nearest_with_repeated_ids(spark, same):
    """Copies of a few rows, or one id with many vectors, do not crowd out other ids."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) + 3).tolist()) for i in range(200)]
    rows += [(i, [9.0] * 8 if same else [9.0 + j / 100] * 8) for i in range(200, 204) for j in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.nearest(df, df.filter("vec_id < 10"), 5, list_size=1000).collect()
    for q in range(10):
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(rows[q][1], v)))
        want = sorted(best, key=lambda i: (-round(best[i], 9), i))[:5]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


TEXTS = [(i, " ".join(np.random.default_rng(i).choice(list("abcdefgh"), 5 + i % 9).tolist())) for i in range(60)]
TEXTS += [(100, None), (101, ""), (102, "A b\tB  c\n\nunseen"), (100, None), (None, "a b"), (103, "É é " * 50), (104, "a " * 3000)]


def held(i, parts):
    return i is not None and zlib.crc32(str(i).encode()) % parts == 0


def words(text):
    return [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).split()] + ["\n"]


def test_kneser_ney(spark):
    pairs, raw, cont, total, kinds = Counter(), Counter(), Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for i, t in TEXTS:
        if not held(i, 10):
            last = "<s>"
            for w in words(t):
                pairs[last, w] += 1
                last = w
    for (v, w), c in pairs.items():
        raw[w] += c
        cont[w] += 1
        total[v] += c
        kinds[v][min(c, 3) - 1] += 1
    high = kneser.discounts(*(Counter(pairs.values())[i] for i in (1, 2, 3, 4)))
    low = kneser.discounts(*(Counter(cont.values())[i] for i in (1, 2, 3, 4)))
    n, v = sum(raw.values()), len(raw)
    types = sum(cont.values())
    rest = sum(low[min(c, 3) - 1] for c in cont.values()) / types / (v + 1)
    cut = lambda c, d: c - d[min(c, 3) - 1] if c else 0

    def probability(a, w):
        lower = cut(cont[w], low) / types + rest
        if not total[a]:
            return lower
        back = sum(d * k for d, k in zip(high, kinds[a], strict=True)) / total[a]
        return cut(pairs[a, w], high) / total[a] + back * lower

    assert isclose(sum(probability("a", w) for w in [*raw, "never seen"]), 1)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in TEXTS], "doc_id long, text string, score double").repartition(3)
    got = sorted(kneser.score_documents(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    for (i, t), r in zip(sorted(TEXTS, key=lambda x: (str(x[0]), len(words(x[1])))), got, strict=True):
        own = words(t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (i, held(i, 10), len(own), n)
        assert r.n_known == sum(raw[w] > 0 for w in own)
        assert isclose(r.base_score, sum(log10((raw[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-12)
        assert isclose(r.score, sum(log10(probability(a, w)) for a, w in zip(["<s>", *own], own, strict=False)), rel_tol=1e-12)


def test_kneser_ney_without_training_rows(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").filter(kneser.held_out(10))
    assert all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in kneser.score_documents(docs).collect())
    assert kneser.score_documents(docs.limit(0)).collect() == []


def test_large_counts_are_exact(spark):
    model = kneser.fit(spark.createDataFrame([("a b " * 700,)], "text string"), bits=2)
    arrays = kneser._Arrays(model)
    a, b = kneser.tokens("a b")[:2]
    keys = np.sort(kneser.pair_key(np.array([a, b], np.uint64), np.array([b, a], np.uint64)))
    assert sorted(arrays.pairs(keys).tolist()) == [699, 700]


def test_kernel_is_that_of_common_subsequences():
    def plain(x, y):
        def space(word):
            s, out = ["^", *word, "$"], Counter()
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                        if all(c.isalnum() or c in "^$" for c in (s[i], s[j], s[k])):
                            out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        a, b = space(x), space(y)
        dot = lambda p, q: sum(p[u] * q[u] for u in p)
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    some = ["idiot", "i.d.i.o.t", "idioot", "banana", "trash", "ab", "x"]
    got = toxicity.kernel(some, some)
    assert all(isclose(got[i, j], plain(x, y), abs_tol=1e-12) for i, x in enumerate(some) for j, y in enumerate(some))


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("aeioulnrst"), 4)) for _ in range(80)]
    bad = ["grumblok", "vexwort", "dunghead"]
    texts, labels = [], []
    for i in range(n):
        w = rng.choice(plain, 30).tolist()
        if i % 4 == 0:
            w[int(rng.integers(30))] = bad[int(rng.integers(3))]
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, labels, plain


def test_detector_tolerates_gaps():
    texts, labels, plain = labelled(600, 3)
    detector = toxicity.Detector(texts, labels)
    score = lambda t: float(detector.scores([t], ChunkTable(detector.offences, 1000))[0])
    base = " ".join(plain[:20])
    for w in ("grumblok", "GRUMBLOK", "gr-umblok", "grumbloook", "vex.wort", "d u n g h e a d", "dunghead!!"):
        assert score(f"{base} {w}") >= 0.5, w
    assert score(base) < 0.5 and score("") < 0.5


def test_detector_tolerates_wide_gaps_and_pairs():
    texts, labels, plain = labelled(600, 3)
    detector = toxicity.Detector(texts, labels)
    score = lambda t: float(detector.scores([t], ChunkTable(detector.offences, 1000))[0])
    base = " ".join(plain[:20])
    for w in ("g--r--u--m--b--l--o--k", "d...u...n...g...h...e...a...d", "v-*-e-*-x-*-w-*-o-*-r-*-t",
              "du ng he ad", "gr um bl ok", "it is ve xw or t so", "dun--ghe--ad"):
        assert score(f"{base} {w} {base}") >= 0.5, w
    assert score(f"{base} it is so or to be at {base}") < 0.5


def test_every_offending_word_counts():
    """Words of larger margin and no evidence do not push an offending one out of the sum."""
    detector = toxicity.Detector(*labelled(600, 3)[:2])
    values = {"grumblok": (1.0, 12.0)} | {f"weak{i}": (5.0, 0.0) for i in range(20)}
    detector.base = -6.0
    detector._values = lambda words, *weights: np.array([values.get(w, (-5.0, 0.0)) for w in words]).T
    detector.bias = 0.0
    score = lambda t: float(detector.scores([t], ChunkTable(detector.offences, 1000))[0])
    assert score("grumblok") > 0.99
    assert score(" ".join(values)) == score("grumblok")


def test_toxicity_query_shape(spark):
    texts, labels, _ = labelled(400, 4)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1), (9000, "", 1)], "doc_id long, text string, predicted int")
    marks = spark.createDataFrame([(i, k) for i, k in enumerate(labels)] + [(None, 1), (5, None), (9000, 7)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id, 5) for r in got)
    right = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id < 400]
    assert sum(right) / len(right) > 0.95
    clean = toxicity.drop_toxic(docs, toxicity.fit(docs, marks))
    assert clean.columns == docs.columns and clean.filter(F.col("doc_id").isNull()).count() == 1
    assert toxicity.score_documents(docs.limit(0), marks).collect() == []
    assert all(r.predicted == 0 for r in toxicity.score_documents(docs, marks.limit(0)).collect())


@pytest.mark.parametrize("kind", [0, 1])
def test_one_kind_of_labels(kind):
    detector = toxicity.Detector(["a b c", "d e f"], [kind, kind])
    assert (detector.scores(["x"], ChunkTable(detector.offences, 10))[0] >= 0.5) == bool(kind)


def test_toxicity_embeds_a_bounded_number_of_characters(monkeypatch):
    words = [f"w{i}" * 12 for i in range(9000)] + ["x" * 100_000, "", "end"]
    rng = np.random.default_rng(0)
    detector = toxicity.Detector([], [])
    detector.weights = rng.normal(size=1 << 18)
    number, code, weight = toxicity.embed(words)
    norm = np.maximum(np.sqrt(np.bincount(number, weights=weight**2, minlength=len(words))), 1e-12)
    want = np.bincount(number, weights=weight * detector.weights[code], minlength=len(words)) / norm
    sizes, embed = [], toxicity.embed
    monkeypatch.setattr(toxicity, "embed", lambda part: sizes.append((sum(map(len, part)), len(part))) or embed(part))
    assert np.array_equal(detector.margins(words), want + detector.bias)
    assert all(chars <= toxicity.PART_CHARS or n == 1 for chars, n in sizes)

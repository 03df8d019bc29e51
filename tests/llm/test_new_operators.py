"""Quality ranking, spelling variants and hard negatives against plain Python, with awkward rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tunelake.llm import negatives, passages, quality, spelling
from tunelake.llm.chunks import ChunkTable


def _good(rng, n):
    words = ["".join(rng.choice(list("aeinrst"), rng.integers(2, 8))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def _bad(rng, n):
    kind = rng.integers(3)
    text = _good(rng, n)
    return text.upper().replace(" ", "!! ") if kind == 0 else text.replace(" ", " | ") if kind == 1 else " ".join([text.split()[0]] * n)


def _held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_quality_ranks_held_out_texts(spark):
    rng = np.random.default_rng(0)
    kinds = [int(rng.random() < 0.8) for _ in range(600)]
    docs = [(i, (_good if k else _bad)(rng, int(rng.integers(20, 200))), "src", 0.5) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score double").repartition(4)
    labels = spark.createDataFrame([(i, k, 0) for i, k in enumerate(kinds)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(df, labels).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == _held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.predicted, kinds[r.doc_id]) for r in got if r.held_out]
    assert len(held) > 100 and sum(p == k for p, k in held) / len(held) > 0.97
    # labels of held-out rows are never read
    lies = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, round(r.score, 9)) for r in quality.score_documents(df, lies).collect()} == {(r.doc_id, round(r.score, 9)) for r in got}


def test_quality_threshold_is_the_quantile_of_bad_ones():
    rng = np.random.default_rng(1)
    y = (rng.random(500) < 0.7).astype(int)
    x = np.concatenate([rng.normal(size=(500, 3)) + y[:, None] * 2, rng.normal(size=(500, 2))], axis=1)
    ranking = quality.Ranking(x, y)
    assert ((ranking.scores(x) < 0.7).sum()) == (y == 0).sum()
    pairs = [(i, j) for i in np.flatnonzero(y == 1)[:100] for j in np.flatnonzero(y == 0)]
    s = ranking.scores(x)
    assert np.mean([s[i] > s[j] for i, j in pairs]) > 0.95


@pytest.mark.parametrize("known", [[], [(1, 1)], [(1, 0)], [(1, 0), (1, 1)], [(None, 1), (2, 7), (3, None)]])
def test_quality_without_pairs(spark, known):
    docs = [(1, "a text"), (1, "a text"), (2, None), (None, ""), (3, "x" * 200_000), (4, "\n \t")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    got = quality.score_documents(df, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in docs)
    only_bad = known == [(1, 0)] and not _held_out(1)
    assert {r.predicted for r in got} == {0 if only_bad else 1}
    assert quality.score_documents(df.limit(0), labels).collect() == []


@pytest.mark.parametrize("every", [2, 400])
def test_quality_learns_from_all_labelled_rows(spark, every):
    """Mean, spread and threshold are those of all rows, however rare one label is."""
    n = 7000
    rng = np.random.default_rng(1)
    good = np.arange(n) % every == 0
    x = rng.normal(size=(n, quality.WIDTH)).astype(np.float32)
    x[good, 3] += 2
    data = pa.table({"doc_id": np.arange(n), "held_out": np.zeros(n, bool), "features": pa.array(list(x))})
    labels = pa.table({"doc_id": np.arange(n), "quality": good.astype(np.int32)})
    ranking = quality.fit(spark.createDataFrame(data), spark.createDataFrame(labels))
    x = x.astype(float)
    assert np.allclose(ranking.mean, x.mean(axis=0), atol=1e-9) and np.allclose(ranking.spread, x.std(axis=0), atol=1e-9)
    strength = np.sort(ranking.strengths(x))
    bad = n - good.sum()
    assert ranking.threshold == pytest.approx((strength[bad - 1] + strength[bad]) / 2, abs=1e-9)
    assert ranking.weights.argmax() == 3


def test_quality_of_a_labelled_id_on_many_rows(spark):
    rng = np.random.default_rng(2)
    docs = [(1, _good(rng, 30)) for _ in range(400)] + [(3 if _held_out(2) else 2, _bad(rng, 30)) for _ in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    rows = quality.measured(df).withColumn("held_out", F.lit(False))
    ranking = quality.fit(rows, labels, sample=100)
    got = quality.score(rows, ranking).groupBy("doc_id").agg(F.avg("predicted").alias("p")).collect()
    assert all((r.p > 0.9) == (r.doc_id == 1) for r in got)


def plain_vocabulary(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    words = plain_vocabulary(docs)
    found = {}
    for w, n in words.items():
        close = sorted((-words[v], v) for v in words if near(w, v))
        form = close[0][1] if close and -close[0][0] >= 5 * n else None
        found[w] = (form, n, len(close), words[form] if form else None)
    out = set()
    for w, (form, n, n_near, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, form, root, n, n_near, form_n))
    return out


def _misspelt(rng, word):
    letters, at = list(word), int(rng.integers(len(word)))
    kind = rng.integers(4)
    letters[at : at + (kind != 1)] = [] if kind == 0 else [str(rng.choice(list("abé")))] if kind < 3 else letters[at][::-1]
    return "".join(letters)


def test_spelling_variants(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdeéÀ"), rng.integers(5, 10))) for _ in range(150)]
    base += ["".join(rng.permutation(list("abcabc"))) for _ in range(60)]  # many permutations of one multiset
    docs = [(None, "Lonely lonely LONELY lonely"), (3, None), (4, ""), (5, "123 ,;"), (5, "ÀÉàé÷× " * 9), (6, "w" * 70_000), (7, "aaaaaa " * 40 + "aaaaaaa " * 6 + "aaaaab " * 6)]
    for i in range(60):
        picked = rng.choice(base, 80).tolist() * int(rng.integers(1, 5))
        text = " ".join(w if rng.random() > 0.15 else _misspelt(rng, w) for w in picked)
        docs += [(i, text + ("," if i % 2 else "\n") + text.upper())] * (1 + (i % 10 == 0))
    chain = [("abcdefgh", 200), ("abcdefgx", 40), ("abcdefyx", 8), ("abcdezyx", 5)]
    docs.append((500, " ".join(w for w, n in chain for _ in range(n))))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("word", F.lit("x")).repartition(4)
    got = [tuple(r) for r in spelling.variants(df).collect()]
    assert spelling.variants(df).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len(got) == len(set(got)) and set(got) == plain_variants(docs)
    led = {r[0]: r[2] for r in got}
    assert led["abcdefyx"] == "abcdefgh"
    assert spelling.variants(df.limit(0)).collect() == []


def test_spelling_of_long_runs_and_slices(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 50)
    text = ("word " * 7 + "a" * 130 + "-" + "longer " * 9) * 3
    got = Counter()
    for w, n in spelling.words_of(9, text):
        got[w] += n
    assert {w: n for w, n in got.items() if n >= 5} == plain_vocabulary([(9, text)])


def test_signatures_of_near_words_meet():
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abcß"), rng.integers(6, 8))) for _ in range(1500)})
    keys = [set(row.tolist()) for row in spelling.signatures(words)]
    for i in range(0, len(words), 7):
        for j in range(len(words)):
            if near(words[i], words[j]):
                assert keys[i] & keys[j]


def test_spelling_joins_never_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcde"), 7)) for _ in range(40)]
    words = base + [w[:-1] for w in base] + ["f" * n for n in range(6, 40)]
    docs = [(i, " ".join(w for w in words for _ in range(30 if len(w) == 7 else 5))) for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plans = []

    def ran(rows):
        out = rows.collect()
        plans.append(rows._jdf.queryExecution().executedPlan().toString())  # as it ran
        return out

    written = spelling.stored
    monkeypatch.setattr(spelling, "stored", lambda rows, name: [ran(rows), written(rows, name)][1])
    assert int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) >= 10 << 20  # Spark's own
    got = ran(spelling.variants(df))
    assert {tuple(r) for r in got} == plain_variants(docs) and any(r.form for r in got)
    assert not [p for p in plans if "Broadcast" in p]
    assert sum(p.partition("Initial Plan")[0].count("SortMergeJoin") for p in plans) >= 4


def plain_negatives(rows, n_pos=5, n_neg=5):
    used = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        row = (label, [int(np.floor(256 * float(np.float64(x)))) for x in v])
        used[vec_id] = min(used.get(vec_id, row), row)
    out = set()
    for a, (label, v) in used.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, (other, w) in used.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            window = [(-t, i) for t, i, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:n_neg]
            out |= {(a, p, r, i, -s, t) for r, (t, i) in enumerate(window, 1)}
    return out


@pytest.mark.parametrize("block", [negatives.BLOCK, 2000])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 20))
    rows = []
    for i in range(1200):
        v = centres[i % 10] + 0.8 * rng.normal(size=20)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(i % 10)))
    rows[200] = (200, rows[0][1], 0)
    rows += [(1300 + i, rows[3][1], i % 4) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2001, rows[1][1], None), (2100, [float("nan")] * 20, 1), (2101, [None] * 20, 1), (2200, [0.5] * 3, 2),
             (2201, [], 2), (2300, [], 2), (None, rows[0][1], 3), (100, rows[5][1], 9), (100, rows[100][1], 0), (2400, [0.0] * 20, 4), (5, rows[5][1], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(1)).repartition(4)
    got = [tuple(r) for r in negatives.mine(df, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_negatives(rows)
    assert len(got) > 100
    assert negatives.mine(df.limit(0)).collect() == []
    assert negatives.mine(df.filter("vec_id = 100")).collect() == []


def test_index_loses_no_pair():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(400, 30)) * np.linspace(60, 1, 30)).astype(np.int64)
    q = (rng.normal(size=(20, 30)) * np.linspace(60, 1, 30)).astype(np.int64)
    exact = q @ x.T
    for low in (20000, 5000, 0, -(1 << 62)):
        lows = np.full(20, low, float) + np.arange(20) * (low > 0)
        index = negatives.BlockIndex(x, float(lows.min()), float(np.sqrt((q.astype(float) ** 2).sum(axis=1)).max()))
        anchor, row, score = index.search(q, lows)
        assert set(zip(anchor.tolist(), row.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact >= lows[:, None])), strict=True))
        assert (exact[anchor, row] == score).all()
        if low > 0:
            assert sum(len(r) for r, _ in index.lists) < len(x) * 4  # lists are shorter than the table
    by = defaultdict(int)
    for a in anchor.tolist():
        by[a] += 1
    assert set(by.values()) == {400}


def test_suffix_ranks_find_equal_windows():
    rng = np.random.default_rng(0)
    for trial in range(60):
        length = int(rng.integers(1, 30))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(length, 200))).astype(np.uint8)
        windows = [data[i : i + length].tobytes() for i in range(len(data) - length + 1)]
        ranks = passages.window_ranks(data, length)[: len(windows)]
        assert [w for _, w in sorted(zip(ranks.tolist(), windows, strict=True))] == sorted(windows)
        position = rng.permutation(len(windows))
        earlier, later = passages.matches(data, np.arange(len(windows)), position, length)
        for i, w in enumerate(windows):
            others = [position[j] for j, x in enumerate(windows) if x == w and j != i]
            assert earlier[i] == any(p < position[i] for p in others) and later[i] == any(p > position[i] for p in others)


def test_chunk_table_keeps_what_is_met_again():
    asked = []
    table = ChunkTable(lambda chunks: [asked.append(c) or c.upper() for c in chunks], 100)
    for i in range(400):
        table.learn(["often", f"rare {i}"])
        assert table["often"] == "OFTEN" and table[f"rare {i}"] == f"RARE {i}"
        assert len(table) + len(table.older) <= 110
    assert asked.count("often") == 1 and len(asked) == 401
    table.learn(["x" * 5000])
    table.learn(["y"])
    assert len(table) == 1

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tunelake.operators import ordered


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_running(spark, block):
    rng = random.Random(block)
    data = [(f"k{rng.randint(0, 3)}", i, rng.randint(-5, 5)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, seq bigint, v bigint").withColumn("b", ordered.block_of("seq", block))
    got = ordered.running(df, ["k"], ["seq"], "b", sums={"s": F.col("v")}, maxes={"m": F.col("v")})
    sums, tops, want = {}, {}, []
    for k, i, v in data:
        sums[k] = sums.get(k, 0) + v
        tops[k] = max(tops.get(k, v), v)
        want.append((k, i, sums[k], tops[k]))
    assert rows(got, "k", "seq", "s", "m") == rows(spark.createDataFrame(want, "k string, seq bigint, s bigint, m bigint"))


@pytest.mark.parametrize("n,block", [(1, 4), (7, 4), (50, 4), (7, 1000), (500, 3)])
def test_first_n(spark, n, block):
    data = [("hot" if i % 3 else "cold", i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, seq bigint").withColumn("b", ordered.block_of("seq", block))
    got = rows(ordered.first_n(df, ["k"], ["seq"], "b", n), "k", "seq")
    want = [(k, i) for key in ("hot", "cold") for k, i in [d for d in data if d[0] == key][:n]]
    assert got == sorted(want, key=lambda t: (t[0], str(t[1])))
    got = rows(ordered.first_n(df, ["k"], ["seq"], "b", n, last=True), "k", "seq")
    want = [(k, i) for key in ("hot", "cold") for k, i in [d for d in data if d[0] == key][-n:]]
    assert got == sorted(want, key=lambda t: (t[0], str(t[1])))


def test_numbered(spark):
    data = [(f"k{i % 3 if i % 2 else 0}", f"name{i * 7919 % 1000:04d}") for i in range(1000)]
    df = spark.createDataFrame(data, "k string, name string").repartition(7)
    names = sorted(n for _, n in data)
    got = {r["name"]: r["number"] for r in ordered.numbered(df, ["name"]).collect()}
    assert got == {n: i + 1 for i, n in enumerate(names)}
    within = ordered.numbered(df, ["name"], within=["k"]).collect()
    for key in ("k0", "k1", "k2"):
        mine = sorted((r["number"], r["name"]) for r in within if r["k"] == key)
        assert mine == list(enumerate(sorted(n for k, n in data if k == key), 1))

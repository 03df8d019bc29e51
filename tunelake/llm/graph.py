"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a that is not the smallest of its component b.

    `edges` has two columns a and b of one ordered type, without nulls; direction, order and
    repeats do not matter. Each round links the larger neighbours of a node to its smallest
    neighbour, then its smaller neighbours to the smallest of them; the number of rounds grows
    with the logarithm of the longest path. All rounds are joins and minima; the edges are
    written to the shared folder between rounds, nothing is collected.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
        "edges",
    )
    before = _signature(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(smallest)
            .distinct()
        )
        now = stored(small, "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    return now

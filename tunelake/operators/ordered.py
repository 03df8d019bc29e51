"""Ordered analytics that stay parallel when one key holds a large share of the rows.

A window over (key ORDER BY seq) sends a whole key to one task. Here rows carry a block
number, non-decreasing in their order, and a block holds a bounded number of rows. Windows
run inside (key, block); the totals of the blocks before it, one small row per block, are
then added. Detail rows are shuffled once, by (key, block).

Keys must not be NULL, and the order must be unique within a key.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_root

BLOCK_ROWS = 1 << 20


def block_of(seq, rows: int = BLOCK_ROWS):
    """Block of an integer position that is unique within its key: at most `rows` per block."""
    return F.expr(f"`{seq}` div {rows}")


def _inside(keys, order, block):
    return (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _earlier_blocks(keys, block):
    return Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def carried(
    totals: DataFrame, keys, block: str, sums=(), maxes=(), later: bool = False
) -> DataFrame:
    """Per (key, block): the sums / maxima over all earlier (or later) blocks of the key."""
    order = F.col(block).desc() if later else F.col(block)
    before = _earlier_blocks(keys, order)
    return totals.select(
        *keys,
        block,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.max(c).over(before).alias(f"_before_{c}") for c in maxes],
    )


def running(df: DataFrame, keys, order, block: str, sums=None, maxes=None) -> DataFrame:
    """Add running sums and maxima (current row included) in the order of each key.

    `sums` and `maxes` map a new column name to the expression to accumulate.
    """
    sums, maxes = sums or {}, maxes or {}
    totals = df.groupBy(*keys, block).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()],
        *[F.max(e).alias(n) for n, e in maxes.items()],
    )
    before = carried(totals, keys, block, sums, maxes)
    inside = _inside(keys, order, block)
    joined = df.join(before, [*keys, block])
    local = joined.select(
        *[F.col(c) for c in df.columns],
        *[F.col(f"_before_{n}") for n in [*sums, *maxes]],
        *[F.sum(e).over(inside).alias(f"_here_{n}") for n, e in sums.items()],
        *[F.max(e).over(inside).alias(f"_here_{n}") for n, e in maxes.items()],
    )
    return local.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_before_{n}") + F.coalesce(F.col(f"_here_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(f"_before_{n}", f"_here_{n}").alias(n) for n in maxes],
    )


def first_n(df: DataFrame, keys, order, block: str, n: int, last: bool = False) -> DataFrame:
    """The first (or last) n rows of each key, in order.

    Blocks that start after the n-th row are dropped by their counts alone, so what is left
    of a key is at most n rows plus one block.
    """
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("rows"))
    needed = carried(counts, keys, block, sums=["rows"], later=last).filter(F.col("_before_rows") < n)
    ordering = [F.col(c).desc() for c in order] if last else list(order)
    inside = Window.partitionBy(*keys, block).orderBy(*ordering)
    return (
        df.join(needed, [*keys, block])
        .withColumn("_at", F.col("_before_rows") + F.row_number().over(inside))
        .filter(F.col("_at") <= n)
        .select(*df.columns)
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and read on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, order, within=(), name: str = "number") -> DataFrame:
    """1-based position in a global order, or in the order of each key of `within`.

    Rows are range-partitioned by the order, so no task holds a whole key. The partition
    number becomes the block; it is written out once, so both passes see the same one.
    """
    ranged = df.repartitionByRange(*within, *order).withColumn("_block", F.spark_partition_id())
    fixed = cut_lineage(ranged)
    out = running(fixed, list(within), list(order), "_block", sums={name: F.lit(1)})
    return out.drop("_block")

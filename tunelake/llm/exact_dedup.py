"""Exact deduplication by an extendible-hash index on shared files.

Every text, its white space normalised, has a 64-bit hash; the leading bits of the hash name
its bucket. The directory starts with one bucket. In each round every bucket with more keys
than its capacity is split by one more bit, and where a split bucket was as deep as the
directory, the directory doubles; rounds end when no bucket is overfull.

One task owns all entries of a bucket. It orders them by hash and text: entries with one hash
form a chain, and an entry whose bytes equal those of the entry before it is a copy of it.
The links of the chains give the row that stays and the size of its group; they are written
to the shared folder, and every document is looked up there by hash and digest.

Only DataFrame operations are used. Copies are combined before entries are sent to their
buckets, first within a task and then within each of a few salts, so a text that a third of
all rows share comes to its owner in at most that many entries. The lookup is an equi-join
whose large partitions Spark can split, because the index has one row per link.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stored, whole_text

#: Bits of the finest directory; a bucket that is still overfull then stays so.
MAX_DEPTH = 20
#: Keys that a bucket holds before it is split.
CAPACITY = 16_384
#: Entries in which copies of one text reach their bucket, at most.
SALTS = 16
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, WHITE, " ")


def hash64(text: Column) -> Column:
    return F.xxhash64(text)


def _slot(h: Column, depth: int) -> Column:
    """The leading bits of a hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, max_depth: int) -> tuple[DataFrame, int]:
    """slot, depth and bucket of every slot, and the directory's depth: slots are that many leading bits.

    `keys` has a column h, each key once. A bucket is named by its depth and leading bits;
    the slots of a bucket that is less deep than the directory all point to it.
    """
    fine = stored(
        keys.groupBy(_slot(F.col("h"), max_depth).alias("finest")).agg(F.count(F.lit(1)).alias("n")), "exact-load"
    )
    last, found = keys.sparkSession.range(1).select(F.col("id").alias("bucket")), None
    for depth in range(max_depth + 1):
        load = fine.groupBy(F.shiftright("finest", max_depth - depth).alias("bucket")).agg(F.sum("n").alias("load"))
        loaded = stored(last.join(load, "bucket", "left"), "exact-round")
        over = (F.coalesce("load", F.lit(0)) > capacity) & F.lit(depth < max_depth)
        fits = loaded.filter(~over).select(F.lit(depth).alias("depth"), "bucket")
        found = fits if found is None else found.union(fits)
        split = loaded.filter(over)
        if split.isEmpty():
            break
        last = split.select(F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket"))
    width = F.expr(f"shiftleft(1L, {depth} - depth)")
    slots = F.sequence(F.col("bucket") * width, (F.col("bucket") + 1) * width - 1)
    return stored(found.select(F.explode(slots).alias("slot"), "depth", "bucket"), "exact-directory"), depth


def build_index(docs: DataFrame, hashing=hash64, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index: bucket, depth, h, chain (from 1), text_sha256, keep_id, group_size.

    One row per distinct text, a link of its hash's chain. keep_id is the smallest doc_id of
    its copies (null only if all are null), group_size the number of rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(whole_text()).alias("text"))
    texts = texts.withColumn("h", hashing(F.col("text")))
    slots, depth = directory(texts.select("h").distinct(), capacity, max_depth)
    entries = texts.groupBy(F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), "h", "text").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")
    )
    owned = (
        entries.withColumn("slot", _slot(F.col("h"), depth)).join(slots, "slot")
        .select("depth", "bucket", "h", "text", "least", "n").repartition("depth", "bucket")
    )
    in_chain = Window.partitionBy("depth", "bucket", "h").orderBy("text")
    links = (
        owned.withColumn("fresh", ~F.col("text").eqNullSafe(F.lag("text").over(in_chain)))
        .withColumn("chain", F.sum(F.col("fresh").cast("int")).over(in_chain.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("text_sha256", F.when(F.col("fresh"), F.sha2("text", 256)))
        .groupBy("depth", "bucket", "h", "chain")
        .agg(F.max("text_sha256").alias("text_sha256"), F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    return stored(links.select("bucket", "depth", "h", "chain", "text_sha256", "keep_id", "group_size"), "exact-index")


def exact_groups(docs: DataFrame, hashing=hash64, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row_key for every row of `docs` (doc_id, text).

    Null texts count as empty; all empty texts are one group. A null doc_id never wins against
    another id; in a group of null ids only, keep_id is null and the rows are kept. Rows with
    one doc_id and equal texts each count in group_size and share `kept`. Other columns are
    ignored, an empty table gives no rows.
    """
    index = build_index(docs, hashing, capacity, max_depth)
    text = normalised(whole_text())
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        hashing(text).alias("h"),
        F.sha2(text, 256).alias("text_sha256"),
        row_key().alias("row_key"),
    )
    found = rows.join(index.select("h", "text_sha256", "keep_id", "group_size"), ["h", "text_sha256"])
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "row_key",
    )


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""

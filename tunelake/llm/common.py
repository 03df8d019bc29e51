"""Helpers that the operators share: tables in the shared folder, batches of bounded bytes."""

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text that one step inside a Python worker handles at once (a longer text comes alone).
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below `spark.checkpoint.dir`, which all executors share.

    Where the setting is missing, a temporary folder stands in for it, in local mode only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local(\[[^,]*\]|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tunelake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keyed(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, text and row_key, a hash of both; other columns are left behind.

    Rows that agree in doc_id and text agree in row_key too, so (doc_id, row_key) can be a
    join key even where ids are missing or repeated.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), *extra
    ).withColumn("row_key", row_key())


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), whole_text())


def only_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id and row_key are in `kept`, each once, with all columns.

    Of rows that differ in other columns alone the one of the least hash over all stays.
    The join is by row_key alone, and ids are compared beside it, so that the count of equal
    rows needs no further shuffle of the texts.
    """
    rows = docs.withColumn("_row_key", row_key())
    wanted = kept.select(F.col("doc_id").alias("_doc_id"), F.col("row_key").alias("_row_key")).distinct()
    same = rows["_row_key"] == wanted["_row_key"]
    ids = (rows["doc_id"] == wanted["_doc_id"]) | (rows["doc_id"].isNull() & wanted["_doc_id"].isNull())
    found = rows.join(wanted, same & ids, "left_semi")
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    copies = Window.partitionBy("_row_key", "doc_id").orderBy(F.xxhash64(*hashed))
    return found.withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1").select(docs.columns)


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return (left.row_key == right.row_key) & left.doc_id.eqNullSafe(right.doc_id)


def by_bytes(batches, column: str, limit: int = BATCH_BYTES):
    """Slices of Arrow batches whose values in a column stay below the limit together.

    A single longer value makes a slice of its own.
    """
    for batch in batches:
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = length(values).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)

"""Dataset files appearing in a folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..sources.files import plain_path


def new_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl", **options) -> DataFrame:
    """Stream of (file, block, record) lines; a file belongs to one micro-batch."""
    return (
        spark.readStream.option("pathGlobFilter", pattern)
        .options(**options)
        .text(folder)
        .select(
            plain_path(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").alias("record"),
        )
    )


def new_documents(spark: SparkSession, folder: str, pattern: str = "*.json", **options) -> DataFrame:
    """Stream of whole (file, content) documents."""
    return (
        spark.readStream.option("pathGlobFilter", pattern)
        .options(**options)
        .text(folder, wholetext=True)
        .select(plain_path(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("content"))
    )


def catalogue_writer(stream: DataFrame, out: str, checkpoint: str):
    """Writer that adds each new file to the catalogue table once.

    A micro-batch is classified with the batch operators and written to a folder of its own
    number, so a repeated batch replaces itself.
    """
    whole = "content" in stream.columns

    def add(batch: DataFrame, batch_id: int) -> None:
        if whole:
            found = catalog.detect_documents(batch)
        else:
            records = batch.withColumn("pos", F.monotonically_increasing_id())
            found = catalog.detect_files(records, from_files=True)
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)

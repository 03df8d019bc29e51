"""Text, JSON and file-manifest scans."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.naming import base_name


def plain_path(uri: Column) -> Column:
    """Path of a file URI: no scheme, percent-escapes decoded (a plus sign stays)."""
    path = F.regexp_replace(uri, r"^[a-z0-9]+:(//)?(?=/)", "")
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _reader(spark: SparkSession, pattern: str | None, recursive: bool):
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return reader.option("pathGlobFilter", pattern) if pattern else reader


def read_documents(
    spark: SparkSession, path, pattern: str | None = None, recursive: bool = False
) -> DataFrame:
    """One row (file, content) per file. For small files: a document is one row of one task."""
    return _reader(spark, pattern, recursive).text(path, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("value").alias("content"),
    )


def read_lines(
    spark: SparkSession, path, pattern: str | None = None, recursive: bool = False
) -> DataFrame:
    """Rows (file, block, pos, record), blank lines included; large files are split.

    The block is the start of the file split. A line's id grows along its split, so
    (block, pos) orders the lines of a file although no line number is known yet.
    """
    return _reader(spark, pattern, recursive).text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("record"),
    )


def read_jsonl(spark: SparkSession, path, recursive: bool = False) -> DataFrame:
    return read_lines(spark, path, "*.jsonl", recursive)


def read_json_documents(spark: SparkSession, path, recursive: bool = False) -> DataFrame:
    return read_documents(spark, path, "*.json", recursive)


def read_typed_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """Elements of JSON-array files with a given schema, read as a stream within the file.

    The way for one array file too large for a single row: convert it once to JSON lines or
    Parquet with this, and scan the result.
    """
    return spark.read.schema(schema).option("multiLine", True).json(path)


def file_manifest(spark: SparkSession, path, recursive: bool = True) -> DataFrame:
    """Path and length of every file, without reading any content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select(plain_path(F.col("path")).alias("path"), F.col("length"))
        .withColumn("file_name", base_name(F.col("path")))
    )


def write_json(listing: DataFrame, path: str) -> None:
    """Export a listing as JSON lines; absent values stay visible as null."""
    listing.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_lines(rows: DataFrame, path: str, folder: str, text: str, order: str = "pos") -> None:
    """Text lines in one folder per value of `folder`, about one file per (folder, block).

    Rows are clustered by (folder, block) first: without it every task would add a file to
    every folder, and by the folder alone a large one would be written by one task.
    """
    clustered = rows.repartition(folder, "block").sortWithinPartitions(folder, "block", order)
    clustered.select(folder, F.col(text).alias("value")).write.mode("errorifexists").partitionBy(
        folder
    ).text(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    """Raw records (dataset, block, pos, record) back to JSON lines, one folder per dataset."""
    write_lines(records, path, "dataset", "record")


def write_arrays(records: DataFrame, path: str) -> None:
    """Raw records (dataset, block, pos, record) as JSON-array files, one for each dataset and block."""
    place = Window.partitionBy("dataset", "block")
    number = F.row_number().over(place.orderBy("pos"))
    opening = F.when(number == 1, F.lit("[")).otherwise(F.lit(","))
    closing = F.when(number == F.count(F.lit(1)).over(place), F.lit("]")).otherwise(F.lit(""))
    rows = records.select(
        F.concat_ws("-", "dataset", "block").alias("part"), "block", "pos", F.concat(opening, "record", closing).alias("line")
    )
    write_lines(rows, path, "part", "line")

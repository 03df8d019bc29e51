"""Workspace usage and health."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sizes, yaml
from ..functions.constants import WORKSPACE_DIRS


def directory_usage(files: DataFrame) -> DataFrame:
    """(directory, files, bytes) per top directory of rows (directory, length).

    A file of unknown size is counted and adds no bytes.
    """
    return files.groupBy("directory").agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.coalesce("length", F.lit(0))), F.lit(0)).alias("bytes"),
    )


def workspace_usage(files: DataFrame, labels=WORKSPACE_DIRS) -> DataFrame:
    """Usage of the fixed workspace directories; a missing one has 0 files and 0 bytes."""
    spark = files.sparkSession
    fixed = spark.range(len(labels)).select(
        F.col("id").alias("place"),
        F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("id").cast("int") + 1).alias("directory"),
    )
    used = directory_usage(files.filter(F.col("directory").isin(*labels)))
    return (
        fixed.join(used, "directory", "left")
        .select(
            "place",
            "directory",
            F.coalesce("files", F.lit(0)).alias("files"),
            F.coalesce("bytes", F.lit(0)).alias("bytes"),
        )
        .withColumn("size", sizes.short_size_text(F.col("bytes")))
        .orderBy("place")
        .drop("place")
    )


def download_totals(files: DataFrame, unknown_zero: bool = True) -> DataFrame:
    """Total size per repo of rows (repo_id, length); a total of 0 reads `unknown`."""
    total = F.col("bytes")
    text = sizes.size_text(total)
    if unknown_zero:
        text = F.when(total == 0, F.lit("unknown")).otherwise(text)
    return (
        files.groupBy("repo_id")
        .agg(F.sum(F.coalesce("length", F.lit(0))).alias("bytes"))
        .withColumn("size", text)
    )


def file_health(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """valid / corrupted / missing for each expected file.

    `documents` holds (file, content): flat YAML where the name says so, else JSON.
    """
    wrapped = F.from_json(
        F.concat(F.lit("["), F.col("content"), F.lit("]")),
        "array<string>",
        {"allowSingleQuotes": "false"},
    )
    ok = (F.size(wrapped) == 1) & F.try_parse_json("content").isNotNull()
    ok = F.when(F.col("file").rlike(r"\.ya?ml$"), yaml.flat_valid(F.col("content"))).otherwise(F.coalesce(ok, F.lit(False)))
    seen = documents.select("file", ok.alias("ok"))
    return expected.select("file").join(seen, "file", "left").select(
        "file",
        F.when(F.col("ok").isNull(), "missing").when(F.col("ok"), "valid").otherwise("corrupted").alias("status"),
    )


def health_counts(health: DataFrame) -> DataFrame:
    return health.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def error_kinds(log: DataFrame) -> DataFrame:
    """Kind of each failed download in rows with (exception, status, message)."""
    return log.withColumn(
        "kind", sizes.error_kind(F.col("exception"), F.col("status"), F.col("message"))
    )

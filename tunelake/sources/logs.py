"""Training-log scans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from .files import read_lines


def clean_lines(lines: DataFrame) -> DataFrame:
    """Trailing white space off, invalid bytes replaced, empty lines dropped."""
    line = F.regexp_replace(F.make_valid_utf8("line"), r"\s+$", "")
    return lines.withColumn("line", line).filter(F.col("line") != "")


def run_of_log(file):
    """Run name in `.../saves/<run>/<name>.log`."""
    return F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)


def read_logs(spark: SparkSession, path, pattern: str = "*.log", recursive: bool = True) -> DataFrame:
    """Rows (run, file, block, line_no, line) with 0-based line numbers of the file.

    Spark reads no line numbers. A split is read by one task, so a line's place in it is its id
    less the split's first id; lines of the earlier splits are counted by a scan that keeps no
    text, and only these counts are grouped. No file has to fit in one task.
    """
    lines = read_lines(spark, path, pattern, recursive)
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    before = ordered.carried(splits.drop("first"), ["file"], "block", sums=["n"])
    numbered = lines.join(splits.drop("n").join(before, ["file", "block"]), ["file", "block"]).select(
        run_of_log(F.col("file")).alias("run"),
        "file",
        (F.col("_before_n") + F.col("pos") - F.col("first")).alias("line_no"),
        F.col("record").alias("line"),
    )
    return clean_lines(numbered).withColumn("block", ordered.block_of("line_no"))

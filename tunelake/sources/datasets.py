"""Dataset folders."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import IGNORED_FILES
from ..functions.naming import base_name
from ..operators import catalog
from . import arrays
from .files import file_manifest, read_jsonl


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Format and number of examples of every JSON and JSON-lines file of a folder.

    Files of both kinds are split over tasks, so one of them may be of any size.
    """
    lines = catalog.detect_files(read_jsonl(spark, folder, recursive), from_files=True)
    wanted = ~base_name(F.col("file")).isin(IGNORED_FILES)
    found = arrays.document_heads(spark, folder, "*.json", recursive).filter(wanted)
    names = file_manifest(spark, folder, recursive).select(F.col("path").alias("file"))
    # a file of no bytes has no chunk, but is listed
    every = names.filter(F.col("file").endswith(".json") & wanted).join(found, "file", "left")
    described = catalog.described(every.select("file", "record", F.coalesce("examples", F.lit(0).cast("bigint")).alias("examples")))
    return lines.unionByName(described)

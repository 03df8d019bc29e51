"""Run configs, summaries, manifests and model configs. These files are small: one row each."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import yaml
from ..functions.constants import HISTORY_FIELDS
from ..functions.naming import base_name, stem
from .files import read_documents

MANIFEST_LINE = r"^#   ([^:]+): (.*)$"


def _lines(documents: DataFrame) -> DataFrame:
    keep = [c for c in documents.columns if c != "content"]
    return documents.select(
        *keep, F.posexplode_outer(F.split("content", r"\r\n|\r|\n")).alias("line_no", "line")
    )


#: Partitions a core that documents are dealt to.
SHARES = 4


def _dealt(documents: DataFrame) -> DataFrame:
    """The documents, dealt out evenly: reading them costs far more than their bytes tell."""
    return documents.repartition(SHARES * documents.sparkSession.sparkContext.defaultParallelism)


def config_entries(documents: DataFrame) -> DataFrame:
    """(…, key, value) rows of flat `key: value` documents; comments are ignored."""
    keep = [c for c in documents.columns if c != "content"]
    entries = yaml.flat_entries(F.col("content"))
    return _dealt(documents).select(*keep, F.inline_outer(entries)).filter(F.col("key").isNotNull())


def manifest_entries(documents: DataFrame) -> DataFrame:
    """(…, key, value) rows of the comment header; nested keys arrive as `key.sub`."""
    keep = [c for c in documents.columns if c != "content"]
    return (
        _lines(documents)
        .filter(F.col("line").rlike(MANIFEST_LINE))
        .select(
            *keep,
            F.regexp_extract("line", MANIFEST_LINE, 1).alias("key"),
            F.regexp_extract("line", MANIFEST_LINE, 2).alias("value"),
        )
    )


def manifest_header(metadata: Column, title: str) -> Column:
    """Comment header of an ordered array<struct<key, value>>."""
    lines = F.transform(metadata, lambda e: F.concat(F.lit("#   "), e["key"], F.lit(": "), e["value"]))
    head = F.lit(f"# {title}\n# ---------------------------------\n")
    return F.concat(head, F.array_join(lines, "\n"), F.lit("\n"))


def read_configs(spark: SparkSession, path, recursive: bool = False) -> DataFrame:
    """Documents (run, content) of `<run>.yaml` files, summaries excluded."""
    docs = read_documents(spark, path, "*.yaml", recursive)
    name = stem(base_name(F.col("file")))
    return docs.select(name.alias("run"), "content").filter(~F.col("run").endswith("_summary"))


def read_summaries(spark: SparkSession, path, recursive: bool = False) -> DataFrame:
    docs = read_documents(spark, path, "*_summary.yaml", recursive)
    name = F.regexp_replace(base_name(F.col("file")), r"_summary\.yaml$", "")
    return docs.select(name.alias("run"), "content")


def document_fields(documents: DataFrame, keys: list[str]) -> DataFrame:
    """The given keys of each flat document as columns; the last entry of a key counts.

    A document is one row, so its fields need neither a row per entry nor a shuffle.
    """
    keep = [c for c in documents.columns if c != "content"]
    read = _dealt(documents).select(*keep, yaml.flat_entries(F.col("content")).alias("_e"))

    def last(key):
        found = F.filter("_e", lambda e: e["key"] == key)
        return F.try_element_at(found, F.lit(-1))["value"].alias(key)

    return read.select(*keep, *[last(k) for k in keys])


def history_rows(summaries: DataFrame) -> DataFrame:
    """The ten history fields of summary documents."""
    rows = document_fields(summaries, HISTORY_FIELDS)
    return rows.withColumn("epochs", F.col("epochs").try_cast("double"))


def config_field(documents: DataFrame, field: str, default: str) -> DataFrame:
    """One field of JSON config documents; unreadable or absent gives the default."""
    value = F.get_json_object("content", f"$.{field}")
    return documents.withColumn(field, F.coalesce(value, F.lit(default))).drop("content")

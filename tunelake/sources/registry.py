"""Dataset registry: a JSON object keyed by dataset name, or a versioned table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import strip_bom
from .files import read_documents

ENTRIES = (
    "map<string,struct<file_name:string,hf_hub_url:string,formatting:string,"
    "columns:map<string,string>,tags:map<string,string>>>"
)


def parse_registry(documents: DataFrame) -> DataFrame:
    """Registry rows of a registry document; an unreadable one gives no rows."""
    entries = F.from_json(strip_bom(F.col("content")), ENTRIES)
    return documents.select(F.explode(entries).alias("name", "entry")).select("name", "entry.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry(read_documents(spark, path))


def entry_json(registry: DataFrame) -> DataFrame:
    """(name, entry): each row as the JSON entry of the registry object, empty fields left out."""
    fields = [c for c in registry.columns if c != "name"]
    return registry.select("name", F.to_json(F.struct(*fields)).alias("entry"))


def write_version(registry: DataFrame, root: str, version: int) -> None:
    """Full rewrite into a new version folder; the one being read is never touched."""
    registry.write.mode("errorifexists").parquet(f"{root}/version={version}")


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of the registry table, the newest by default."""
    table = spark.read.parquet(root)
    wanted = (
        spark.read.parquet(root).select(F.max("version")).scalar()
        if version is None
        else F.lit(version)
    )
    return table.filter(F.col("version") == wanted).drop("version")

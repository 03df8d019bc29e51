"""Inventory of cached models, adapters and merged models.

Cache files are rows (entry, snapshot, file_name, length); config documents are rows
(entry, snapshot, file_name, content).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.constants import TEXT_GENERATION_TYPES, TOKENIZER_BY_TYPE
from . import ordered

UNKNOWN_TYPE = "?"
PATHS_PER_ROW = 10000


def cache_files(manifest: DataFrame) -> DataFrame:
    """Split `.../<entry>/snapshots/<snapshot>/<file>` paths of a manifest."""
    parts = r"([^/]+)/snapshots/([^/]+)/([^/]+)$"
    return manifest.filter(F.col("path").rlike(parts)).select(
        F.regexp_extract("path", parts, 1).alias("entry"),
        F.regexp_extract("path", parts, 2).alias("snapshot"),
        F.regexp_extract("path", parts, 3).alias("file_name"),
        "length",
    )


def model_entries(files: DataFrame) -> DataFrame:
    """Only the cache folders of models, with their repo id."""
    repo = naming.repo_id(F.col("entry"))
    return files.withColumn("repo_id", repo).filter(F.col("repo_id").isNotNull())


def chosen_snapshots(files: DataFrame) -> DataFrame:
    """Greatest snapshot name per entry. Names are hashes: this is a fixed choice, not an age."""
    return files.groupBy("entry").agg(F.max("snapshot").alias("snapshot"))


def is_weight(file_name):
    return file_name.rlike(r"\.(safetensors|bin)$")


def model_sizes(files: DataFrame) -> DataFrame:
    """Weight size in GiB of the chosen snapshot of each model."""
    weights = F.sum(F.when(is_weight(F.col("file_name")), F.col("length")).otherwise(0))
    per_snapshot = model_entries(files).groupBy("repo_id", "entry", "snapshot").agg(
        weights.alias("bytes")
    )
    return per_snapshot.groupBy("repo_id", "entry").agg(
        F.max("snapshot").alias("snapshot"),
        (F.max_by("bytes", "snapshot") / float(1024**3)).alias("size_gb"),
    )


def config_types(configs: DataFrame) -> DataFrame:
    """(entry, snapshot, model_type) of readable model configs; a missing field gives `?`."""
    readable = F.json_object_keys("content").isNotNull()
    return configs.filter((F.col("file_name") == "config.json") & readable).select(
        "entry",
        "snapshot",
        F.coalesce(F.get_json_object("content", "$.model_type"), F.lit(UNKNOWN_TYPE)).alias("model_type"),
    )


def with_types(models: DataFrame, types: DataFrame) -> DataFrame:
    """Models with the type of their snapshot; no or unreadable config gives `?`."""
    return models.join(types, ["entry", "snapshot"], "left").withColumn(
        "model_type", F.coalesce("model_type", F.lit(UNKNOWN_TYPE))
    )


def text_generation(models: DataFrame) -> DataFrame:
    return models.filter(F.col("model_type").isin(UNKNOWN_TYPE, *TEXT_GENERATION_TYPES))


def list_models(files: DataFrame, types: DataFrame) -> DataFrame:
    """Models that generate text or whose type is unknown, by lower-cased repo id."""
    return (
        text_generation(with_types(model_sizes(files), types))
        .select("repo_id", "size_gb", "model_type")
        .orderBy(F.lower("repo_id"), "repo_id")
    )


def lookup_types(ids: DataFrame, files: DataFrame, types: DataFrame) -> DataFrame:
    """Model type of each repo id, ignoring case; NULL when no chosen snapshot has a config.

    Of several cache entries for an id the first by entry name with a config decides.
    """
    known = (
        model_entries(chosen_snapshots(files).join(types, ["entry", "snapshot"]))
        .groupBy(F.lower("repo_id").alias("_key"))
        .agg(F.min_by("model_type", "entry").alias("model_type"))
    )
    return (
        ids.withColumn("_key", F.lower("repo_id")).join(known, "_key", "left").drop("_key")
    )


def templates(ids: DataFrame, files: DataFrame, types: DataFrame) -> DataFrame:
    """Chat template of each repo id."""
    typed = lookup_types(ids, files, types)
    return typed.withColumn("template", naming.template(F.col("repo_id"), F.col("model_type")))


def adapters(configs: DataFrame) -> DataFrame:
    """(path, base_model) from adapter configs (path of the folder, content)."""
    base = F.get_json_object("content", "$.base_model_name_or_path")
    return configs.select(
        "path", F.coalesce(F.nullif(base, F.lit("")), F.lit("unknown")).alias("base_model")
    )


def adapters_by_base(found: DataFrame, per_row: int = PATHS_PER_ROW) -> DataFrame:
    """Adapter paths of each base model, in path order, as rows (base_model, part, paths).

    Part 0 holds the first `per_row` paths and so on: no base model is too large for a row.
    """
    placed = ordered.numbered(found, ["path"], within=["base_model"], name="n")
    return (
        placed.withColumn("part", F.floor((F.col("n") - 1) / per_row).cast("bigint"))
        .groupBy("base_model", "part")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
    )


def list_adapters(manifest: DataFrame, saves: str) -> DataFrame:
    """Folders holding an adapter config, relative to the saves folder."""
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    return manifest.filter(naming.base_name(F.col("path")) == "adapter_config.json").select(
        naming.relative_path(folder, saves).alias("path"), folder.alias("full_path")
    )


def list_merged(manifest: DataFrame, models_dir: str) -> DataFrame:
    """Folders one level below the models folder that hold a config, in name order."""
    inner = naming.relative_path(F.col("path"), models_dir)
    return (
        manifest.filter(inner.rlike(r"^[^/]+/config\.json$"))
        .select(F.regexp_replace(inner, r"/config\.json$", "").alias("name"))
        .orderBy("name")
    )


def chat_options(models: DataFrame, found: DataFrame, merged: DataFrame) -> DataFrame:
    """(model, adapter, kind): each model alone, with each adapter trained on it, and merged ones."""
    base = models.select(F.col("repo_id").alias("model"), F.lit(None).cast("string").alias("adapter"))
    with_adapter = found.select(F.col("base_model").alias("model"), F.col("path").alias("adapter"))
    with_adapter = with_adapter.join(
        models.select(F.col("repo_id").alias("model")).distinct(), "model", "left_semi"
    )
    return (
        base.withColumn("kind", F.lit("base"))
        .unionByName(with_adapter.withColumn("kind", F.lit("adapter")))
        .unionByName(
            merged.select(F.col("name").alias("model"), F.lit("merged").alias("kind")),
            allowMissingColumns=True,
        )
    )


def tokenizer_audit(configs: DataFrame) -> DataFrame:
    """Models whose tokenizer class does not fit their type, with the corrected config text.

    The greatest snapshot that has both configs is looked at; types without a known class
    give no finding.
    """
    text = lambda name: F.max(F.when(F.col("file_name") == name, F.col("content")))
    pairs = (
        model_entries(configs.filter(F.col("file_name").isin("config.json", "tokenizer_config.json")))
        .groupBy("repo_id", "entry", "snapshot")
        .agg(text("config.json").alias("model"), text("tokenizer_config.json").alias("tokenizer"))
        .filter("model is not null and tokenizer is not null")
    )
    newest = pairs.groupBy("repo_id", "entry").agg(
        F.max("snapshot").alias("snapshot"),
        F.max_by(F.struct("model", "tokenizer"), "snapshot").alias("c"),
    )
    found = F.coalesce(F.get_json_object("c.tokenizer", "$.tokenizer_class"), F.lit(""))
    expected = F.try_element_at(
        naming.literal_map(TOKENIZER_BY_TYPE), F.get_json_object("c.model", "$.model_type")
    )
    # only the key of the outer object is set; nested ones keep their values
    fields = F.from_json("c.tokenizer", "map<string,variant>")
    value = F.try_variant_get(F.parse_json(F.to_json(F.array("expected"))), "$[0]", "variant")
    corrected = F.to_json(
        F.map_concat(
            F.map_filter(fields, lambda k, _: k != "tokenizer_class"), F.create_map(F.lit("tokenizer_class"), value)
        )
    )
    return (
        newest.withColumn("found", found)
        .withColumn("expected", expected)
        .filter(F.col("expected").isNotNull() & (F.col("found") != F.col("expected")))
        .select("repo_id", "snapshot", "found", "expected", corrected.alias("corrected"))
    )

"""Dataset catalogue.

Records are rows (dataset, file, block, pos, record): `record` is raw JSON text and
(block, pos) is its place in the file. Detected files are rows (name, file_name, extension,
format, message_key, tag_style, examples).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect
from ..functions.binding import bind
from ..functions.constants import FROM_TAGS, IGNORED_FILES, SAMPLE_CAP
from ..functions.naming import base_name, extension, stem
from . import ordered

REGISTRY_SCHEMA = (
    "name string, file_name string, hf_hub_url string, formatting string, "
    "columns map<string,string>, tags map<string,string>"
)


def _but(df: DataFrame, *dropped: str) -> list[str]:
    return [c for c in df.columns if c not in dropped]


def exploded(documents: DataFrame) -> DataFrame:
    """One row per item of `_items`.

    The outer form keeps Spark from adding a filter on the size of the array, which would
    parse every document once more.
    """
    rows = documents.select(
        *_but(documents, "_items"), F.posexplode_outer("_items").alias("pos", "record")
    )
    return rows.filter(F.col("pos").isNotNull()).withColumn("block", F.lit(0).cast("bigint"))


# --- scans over raw text ----------------------------------------------------
def array_records(documents: DataFrame) -> DataFrame:
    """One row per element of each JSON-array document (file, content)."""
    items = detect.array_items(detect.strip_bom(F.col("content")))
    return exploded(documents.select(*_but(documents, "content"), items.alias("_items")))


def line_records(lines: DataFrame) -> DataFrame:
    """The non-blank lines, each one record."""
    return lines.filter(F.col("record").rlike(r"\S"))


def _read_document(text, use):
    """use(shape, items) of a `.json` text: an array, a single object, or else lines."""
    lines = F.split(text, r"\r\n|\r|\n")
    return bind(
        detect.array_items(text),
        lambda items: F.when(items.isNotNull(), use("array", items))
        .when(detect.single_object(text).isNotNull(), use("object", F.array(text)))
        .otherwise(use("lines", lines)),
    )


def document_records(documents: DataFrame) -> DataFrame:
    """Records of `.json` documents (file, content), with the fallback to JSON lines.

    Adds `shape`: array, object (a single record, to be counted but never listed) or lines.
    """
    keep = _but(documents, "content")
    read = _read_document(
        detect.strip_bom(F.col("content")),
        lambda shape, items: F.struct(F.lit(shape).alias("shape"), items.alias("items")),
    )
    parsed = documents.select(*keep, read.alias("_d"))
    return exploded(
        parsed.select(*keep, F.col("_d.shape").alias("shape"), F.col("_d.items").alias("_items"))
    )


def first_records(records: DataFrame, by=("file",)) -> DataFrame:
    """The record at the first place of each file; a blank first line stays blank."""
    return records.groupBy(*by).agg(
        F.min_by("record", F.struct("block", "pos")).alias("record")
    )


def data_files(files: DataFrame) -> DataFrame:
    """Files of a data folder that may hold a dataset, in name order (path or file_name)."""
    name = F.col("file_name")
    return files.filter(
        ~name.startswith(".")
        & ~name.isin(IGNORED_FILES)
        & (name.endswith(".json") | name.endswith(".jsonl"))
    ).orderBy("file_name")


def json_files(files: DataFrame) -> DataFrame:
    """Every JSON or JSON-lines file of a manifest, at any depth."""
    name = F.col("file_name")
    return files.filter(name.endswith(".json") | name.endswith(".jsonl"))


# --- detection --------------------------------------------------------------
def classify(records: DataFrame) -> DataFrame:
    """Add format, message_key and tag_style to each record."""
    record = bind(detect.single_object(F.col("record")), detect.classification)
    return records.withColumn("_c", record).select(*records.columns, "_c.*")


def described(files: DataFrame) -> DataFrame:
    """Detected files from rows (file, record = first record or NULL, examples)."""
    name = base_name(F.col("file"))
    return classify(files).select(
        stem(name).alias("name"),
        "file",
        name.alias("file_name"),
        extension(name).alias("extension"),
        "format",
        "message_key",
        "tag_style",
        "examples",
    )


def detect_files(records: DataFrame, from_files: bool = False) -> DataFrame:
    """Format and number of examples of each file, in one pass over the records.

    The count is partial per task; only one record per file and task is shuffled. Records
    scanned from files start in block 0: with `from_files` the other blocks carry no text.
    """
    head = F.when(F.col("block") == 0, F.col("record")) if from_files else F.col("record")
    slim = records.select(
        "file", "block", "pos", head.alias("record"), F.col("record").rlike(r"\S").alias("filled")
    )
    return described(
        slim.groupBy("file").agg(
            F.min_by("record", F.struct("block", "pos")).alias("record"),
            F.count_if("filled").alias("examples"),
        )
    )


def document_heads(documents: DataFrame) -> DataFrame:
    """(file, shape, record, examples) of `.json` documents (file, content), from one parse.

    `record` is the first record; a document that is one object counts as one example and
    has none.
    """

    def head(shape, items):
        first = F.lit(None).cast("string") if shape == "object" else F.get(items, F.lit(0))
        filled = F.filter(items, lambda x: x.rlike(r"\S")) if shape == "lines" else items
        return F.struct(
            F.lit(shape).alias("shape"), first.alias("record"), F.size(filled).cast("bigint").alias("examples")
        )

    read = _read_document(detect.strip_bom(F.col("content")), head)
    return documents.select("file", read.alias("_d")).select("file", "_d.*")


def detect_documents(documents: DataFrame) -> DataFrame:
    """Format and number of examples of `.json` documents (file, content), without a shuffle."""
    return described(document_heads(documents))


# --- listing and counting ---------------------------------------------------
def drop_stale(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registry rows whose file exists, plus the hub rows that have no file."""
    has_file = F.coalesce(F.col("file_name"), F.lit("")) != ""
    present = files.select("file_name", F.lit(True).alias("_present")).distinct()
    return registry.join(present, "file_name", "left").filter(~has_file | F.col("_present")).select(*registry.columns)


def registered_listing(registry: DataFrame, source: str = "registered") -> DataFrame:
    return registry.select(
        "name",
        F.coalesce("formatting", F.lit("alpaca")).alias("format"),
        F.lit(source).alias("source"),
    )


def discovered_listing(detected: DataFrame, source: str = "auto") -> DataFrame:
    """One row per name: the first recognised file in name order."""
    return (
        detected.filter(F.col("format").isNotNull())
        .groupBy("name")
        .agg(F.min_by("format", "file_name").alias("format"))
        .withColumn("source", F.lit(source))
    )


def union_listing(registered: DataFrame, discovered: DataFrame) -> DataFrame:
    """Registered rows win over discovered files of the same name."""
    return registered.unionByName(discovered.join(registered, "name", "left_anti"))


def count_examples(detected: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Examples per dataset name: `<name>.json`, then `<name>.jsonl`, then the registry's file."""
    rank = F.when(F.col("extension") == ".json", 0).when(F.col("extension") == ".jsonl", 1)
    own = (
        detected.withColumn("_rank", rank)
        .filter(F.col("_rank").isNotNull())
        .groupBy("name")
        .agg(F.min_by("examples", "_rank").alias("own"))
    )
    if registry is None:
        return own.select("name", F.col("own").alias("examples"))
    by_file = detected.groupBy("file_name").agg(F.max("examples").alias("linked"))
    linked = registry.select("name", "file_name").join(by_file, "file_name", "left").drop("file_name")
    return own.join(linked, "name", "full_outer").select(
        "name", F.coalesce("own", "linked", F.lit(0)).alias("examples")
    )


def list_datasets(
    detected: DataFrame, registry: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """The dataset listing with counts, in name order.

    Stale registry rows go, registered names win over discovered ones. The detection result,
    one row per file, is used twice: it is kept when it is first computed, so that the records
    are scanned once.
    """
    detected = detected.persist()
    kept = drop_stale(registry, detected if files is None else files)
    linked = detected.groupBy("file_name").agg(F.max("examples").alias("linked"))
    registered = (
        kept.select("name", "file_name", "formatting")
        .join(linked, "file_name", "left")
        .select("name", "formatting", "linked", F.lit(True).alias("registered"))
    )
    recognised = F.when(F.col("format").isNotNull(), F.col("file_name"))
    rank = F.when(F.col("extension") == ".json", 0).when(F.col("extension") == ".jsonl", 1)
    found = detected.groupBy("name").agg(
        F.min_by("format", recognised).alias("format"), F.min_by("examples", rank).alias("own")
    )
    known = F.coalesce("registered", F.lit(False))
    return (
        registered.join(found, "name", "full_outer")
        .filter(known | F.col("format").isNotNull())
        .select(
            "name",
            F.when(known, F.coalesce("formatting", F.lit("alpaca")))
            .otherwise(F.col("format"))
            .alias("format"),
            F.when(known, "registered").otherwise("auto").alias("source"),
            F.coalesce("own", "linked", F.lit(0)).alias("examples"),
        )
        .orderBy("name")
    )


def list_demo_datasets(detected: DataFrame, registry: DataFrame) -> DataFrame:
    """Listing of a bundled folder: no stale pass, counts from the folder's own files only."""
    detected = detected.persist()  # one row per file
    listing = union_listing(
        registered_listing(registry, "demo"), discovered_listing(detected, "demo")
    )
    return (
        listing.join(count_examples(detected), "name", "left")
        .withColumn("examples", F.coalesce("examples", F.lit(0)))
        .orderBy("name")
    )


def readiness(counts: DataFrame) -> DataFrame:
    return counts.withColumn("band", detect.readiness(F.col("examples")))


def sample_cap(records: DataFrame, n: int = SAMPLE_CAP, keys=("dataset",)) -> DataFrame:
    """At most n records per dataset, in document order."""
    return ordered.first_n(records, list(keys), ["pos"], "block", n)


# --- registry ---------------------------------------------------------------
def registry_entries(detected: DataFrame) -> DataFrame:
    """Registry rows for detected files: per name, `.json` is tried before `.jsonl`."""
    rank = F.when(F.col("extension") == ".json", 0).when(F.col("extension") == ".jsonl", 1)
    best = (
        detected.filter(F.col("format").isNotNull())
        .withColumn("_rank", rank)
        .filter(F.col("_rank").isNotNull())
        .groupBy("name")
        .agg(
            F.min_by(
                F.struct("file_name", "format", "message_key", "tag_style"), "_rank"
            ).alias("e")
        )
    )
    return best.select(
        "name",
        F.col("e.file_name").alias("file_name"),
        F.lit(None).cast("string").alias("hf_hub_url"),
        F.col("e.format").alias("formatting"),
        detect.columns_map(F.col("e.message_key")).alias("columns"),
        detect.tag_map(F.col("e.tag_style")).alias("tags"),
    )


def register_absent(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Add entries whose name is not registered; existing rows stay untouched."""
    return registry.unionByName(entries.join(registry, "name", "left_anti"))


def upsert(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """New entries replace the old ones of the same name entirely."""
    return registry.join(entries, "name", "left_anti").unionByName(entries)


def delete_entries(registry: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept rows, files left without an entry, unknown names)."""
    kept = registry.join(names, "name", "left_anti")
    doomed = (
        registry.join(names, "name", "left_semi")
        .filter(F.coalesce("file_name", F.lit("")) != "")
        .select("name", "file_name")
    )
    return kept, doomed, names.join(registry, "name", "left_anti")


def merge_registries(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing rows win; only a missing `columns` is filled from the incoming row."""
    e, i = existing.alias("e"), incoming.alias("i")
    seen = F.col("e.name").isNotNull()
    pick = lambda c: F.when(seen, F.col(f"e.{c}")).otherwise(F.col(f"i.{c}")).alias(c)
    return e.join(i, F.col("e.name") == F.col("i.name"), "full_outer").select(
        F.coalesce("e.name", "i.name").alias("name"),
        *[pick(c) for c in ("file_name", "hf_hub_url", "formatting")],
        F.coalesce("e.columns", "i.columns").alias("columns"),
        pick("tags"),
    )


def missing_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """JSON files of the source folder that the target folder lacks.

    The source registry is a `.json` file like any other here, so it is copied too when the
    target has none.
    """
    name = F.col("file_name")
    wanted = source.filter(name.endswith(".json") | name.endswith(".jsonl"))
    return wanted.join(target, "file_name", "left_anti")


def resolve_datasets(names: DataFrame, registry: DataFrame, data_dir: str = "data") -> DataFrame:
    """Where a dataset name points to: its file, its hub address, or the name itself."""
    local = F.when(
        F.coalesce("file_name", F.lit("")) != "",
        F.concat(F.lit(data_dir.rstrip("/") + "/"), F.col("file_name")),
    )
    return names.join(registry.select("name", "file_name", "hf_hub_url"), "name", "left").select(
        *names.columns, F.coalesce(local, "hf_hub_url", "name").alias("target")
    )


def download_vote(files: DataFrame) -> DataFrame:
    """Registry entry of each download (dataset, pos, file_name, record = first record).

    The first recognised file in walk order decides; with none, the first JSON file is
    registered as alpaca.
    """
    seen = classify(files)
    row = F.struct("file_name", "format", "message_key", "tag_style")
    known = F.col("format").isNotNull()
    votes = seen.groupBy("dataset").agg(
        F.min_by(F.when(known, row), F.when(known, F.col("pos"))).alias("hit"),
        F.min_by(row, "pos").alias("head"),
    )
    return votes.select(
        F.col("dataset").alias("name"),
        F.coalesce("hit.file_name", "head.file_name").alias("file_name"),
        F.coalesce("hit.format", F.lit("alpaca")).alias("formatting"),
        F.col("hit.message_key").alias("message_key"),
        F.col("hit.tag_style").alias("tag_style"),
    )


def select_datasets(runs: DataFrame) -> DataFrame:
    """One row per dataset named in a comma-separated `dataset` column."""
    parts = F.transform(F.split("dataset", ","), lambda x: detect.strip_space(x))
    return runs.select(
        *[c for c in runs.columns if c != "dataset"],
        detect.strip_space(F.get(F.split("dataset", ","), F.lit(0))).alias("active_dataset"),
        F.explode(F.filter(parts, lambda x: x != "")).alias("dataset"),
    )


# --- normalising ------------------------------------------------------------
def normalise(records: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Every record as `messages array<struct<role, content>>`.

    Role and content fields and role names follow the dataset's registered tags; without them
    the message's own style decides. An alpaca record becomes a user and an assistant
    message, a plain text one message of role `text`.
    """
    record = F.col("record")
    none = F.lit(None)
    if registry is not None:
        tags = registry.select(
            F.col("name").alias("dataset"),
            F.col("tags").alias("_tags"),
            F.try_element_at("columns", F.lit("messages")).alias("_named"),
        )
        base = records.join(tags, "dataset", "left")
    else:
        base = records.withColumn("_tags", none.cast("map<string,string>")).withColumn(
            "_named", none.cast("string")
        )
    tag = lambda f: F.try_element_at("_tags", F.lit(f))
    first_of = lambda m, *keys: F.coalesce(*[F.try_element_at(m, k) for k in keys])

    def plain(role):
        return (
            F.when(role == tag("user_tag"), "user")
            .when(role == tag("assistant_tag"), "assistant")
            .when(role == tag("system_tag"), "system")
            .when(role == FROM_TAGS["user_tag"], "user")
            .when(role == FROM_TAGS["assistant_tag"], "assistant")
            .otherwise(role)
        )

    def message(m):
        role = first_of(m, tag("role_tag"), F.lit("role"), F.lit("from"))
        content = first_of(m, tag("content_tag"), F.lit("content"), F.lit("value"))
        return F.struct(bind(role, plain).alias("role"), content.alias("content"))

    def turn(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    def read(keys):
        field = lambda f: F.get_json_object(record, f"$.{f}")
        named = F.coalesce(F.array_contains(keys, F.col("_named")), F.lit(False))
        key = F.when(named, F.col("_named")).otherwise(detect.key_of(keys))
        chat = F.from_json(detect.message_text(record, key), "array<map<string,string>>")
        question = F.concat(
            F.coalesce(field("instruction"), F.lit("")),
            bind(
                F.coalesce(field("input"), F.lit("")),
                lambda extra: F.when(extra != "", F.concat(F.lit("\n"), extra)).otherwise(""),
            ),
        )
        by_shape = lambda shape: (
            F.when(shape == "chat", F.transform(chat, message))
            .when(shape == "instruction", F.array(turn("user", question), turn("assistant", field("output"))))
            .when(shape == "completion", F.array(turn("user", field("prompt")), turn("assistant", field("completion"))))
            .when(shape == "text", F.array(turn("text", field("text"))))
        )
        return bind(detect.shape_of(keys), by_shape)

    messages = bind(F.json_object_keys(record), read)
    return base.withColumn("messages", messages).drop("record", "_tags", "_named")

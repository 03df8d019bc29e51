"""Dataset catalogue queries."""

from pyspark.sql import functions as F

from ..functions import detect, naming
from ..operators import catalog, ordered
from ..sources import arrays, files, registry as registry_io
from .inputs import load, table, with_inputs
from .named import named
from .session import scratch


# --- oracle building blocks -------------------------------------------------
def has(record, key):
    return f"coalesce(list_contains(json_keys({record}), '{key}'), false)"


def format_sql(r):
    return f"""CASE WHEN {has(r, 'instruction')} AND {has(r, 'output')} THEN 'alpaca'
      WHEN {has(r, 'messages')} OR {has(r, 'conversations')} THEN 'sharegpt'
      WHEN {has(r, 'prompt')} AND {has(r, 'completion')} THEN 'alpaca'
      WHEN {has(r, 'text')} THEN 'alpaca' END"""


def key_sql(r):
    return f"""CASE WHEN {format_sql(r)} <> 'sharegpt' THEN NULL WHEN {has(r, 'messages')} THEN 'messages'
      WHEN {has(r, 'conversations')} THEN 'conversations' END"""


def style_sql(r):
    first = f"coalesce(json_extract({r}, '$.messages[0]'), json_extract({r}, '$.conversations[0]'))"
    return f"""CASE WHEN {format_sql(r)} <> 'sharegpt' THEN NULL WHEN {has(first, 'role')} THEN 'role'
      WHEN {has(first, 'from')} THEN 'from' END"""


DETECTED = f"""firsts AS (SELECT dataset AS name, file AS file_name, arg_min(record, pos) AS record, count(*) AS examples
    FROM raw_records GROUP BY dataset, file),
  detected AS (SELECT name, file_name, examples, {format_sql('record')} AS format, {key_sql('record')} AS message_key,
    {style_sql('record')} AS tag_style FROM firsts),
  kept AS (SELECT * FROM registry WHERE coalesce(file_name, '') = '' OR file_name IN (SELECT file_name FROM source_files)),
  listing AS (SELECT name, coalesce(formatting, 'alpaca') AS format, 'registered' AS source FROM kept
    UNION ALL SELECT name, format, 'auto' FROM detected WHERE format IS NOT NULL AND name NOT IN (SELECT name FROM kept))"""


def detected_sql(body):
    return with_inputs("", "raw_records", "registry", "source_files").rstrip() + ", " + DETECTED + " " + body


# --- shared frames ----------------------------------------------------------
def raw_records(spark, sf, rows=ordered.BLOCK_ROWS):
    return load(spark, sf, "raw_records").withColumn("block", ordered.block_of("pos", rows))


def registry_frame(spark, sf, name="registry"):
    rows = load(spark, sf, name)
    return rows.select(
        "name",
        "file_name",
        "hf_hub_url",
        "formatting",
        detect.columns_map(F.col("message_key")).alias("columns"),
        detect.tag_map(F.col("tag_style")).alias("tags"),
    )


def flat(registry):
    """Registry rows with the two maps as plain columns."""
    return registry.select(
        "name",
        "file_name",
        "hf_hub_url",
        "formatting",
        F.try_element_at("columns", F.lit("messages")).alias("message_key"),
        F.try_element_at("tags", F.lit("role_tag")).alias("role_tag"),
        F.try_element_at("tags", F.lit("user_tag")).alias("user_tag"),
    )


FLAT = """name, file_name, hf_hub_url, formatting, message_key,
    CASE tag_style WHEN 'role' THEN 'role' WHEN 'from' THEN 'from' END AS role_tag,
    CASE tag_style WHEN 'role' THEN 'user' WHEN 'from' THEN 'human' END AS user_tag"""


def detected(spark, sf):
    return catalog.detect_files(raw_records(spark, sf))


# --- scans ------------------------------------------------------------------
@named(
    "json_array_records",
    with_inputs(
        """SELECT file, CAST(i AS INT) AS pos, CAST(len(json_keys(content, '$[' || i || ']')) AS INT) AS n_keys,
        CAST(length(coalesce(content ->> ('$[' || i || '].output'), content ->> ('$[' || i || '].text'), '')) AS INT) AS chars
        FROM (SELECT *, unnest(range(CAST(json_array_length(content) AS BIGINT))) AS i FROM dataset_documents WHERE doc_id % 3 = 0) x""",
        "dataset_documents",
    ),
)
def json_array_records(spark, sf):
    docs = load(spark, sf, "dataset_documents").select("file", "content")
    rec = catalog.array_records(docs)
    body = F.coalesce(
        F.get_json_object("record", "$.output"), F.get_json_object("record", "$.text"), F.lit("")
    )
    return rec.select(
        "file", "pos", F.size(F.json_object_keys("record")).alias("n_keys"), F.length(body).alias("chars")
    )


@named(
    "jsonl_scan",
    with_inputs(
        f"""SELECT dataset, count(*) AS examples, CAST(sum(length(record)) AS BIGINT) AS chars,
        count({format_sql('record')}) AS recognised FROM raw_records GROUP BY dataset""",
        "raw_records",
    ),
)
def jsonl_scan(spark, sf):
    """Write every record as JSON lines, then scan the files."""
    out = scratch(spark, "jsonl")
    files.write_jsonl(raw_records(spark, sf), out)
    lines = catalog.line_records(files.read_lines(spark, out, recursive=True))
    seen = lines.withColumn("dataset", F.regexp_extract("file", r"dataset=([^/]+)/", 1))
    return seen.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum(F.length("record")).alias("chars"),
        F.count(detect.record_format(F.col("record"))).alias("recognised"),
    )


SHAPE = """CASE WHEN NOT json_valid(content) THEN 'lines' WHEN json_type(content) = 'ARRAY' THEN 'array' ELSE 'object' END"""


@named(
    "json_fallback",
    with_inputs(
        f"""SELECT file, shape, CAST(CASE shape WHEN 'array' THEN json_array_length(content) WHEN 'object' THEN 1 ELSE 2 END AS BIGINT) AS examples,
        CASE WHEN shape <> 'object' THEN {format_sql('record')} END AS format
        FROM (SELECT *, CASE shape WHEN 'array' THEN json_extract(content, '$[0]') WHEN 'object' THEN CAST(content AS JSON)
          ELSE CAST(split_part(content, CHR(10), 1) AS JSON) END AS record
          FROM (SELECT file, content, {SHAPE} AS shape FROM dataset_documents) a) b""",
        "dataset_documents",
    ),
)
def json_fallback(spark, sf):
    docs = load(spark, sf, "dataset_documents").select("file", "content")
    found = catalog.classify(catalog.document_heads(docs))
    return found.select("file", "shape", "examples", "format")


@named(
    "split_arrays",
    with_inputs(
        f"""SELECT dataset, 'array' AS shape, count(*) AS examples, CAST(sum(len(json_keys(record))) AS BIGINT) AS n_keys,
        CAST(sum(length(coalesce(record ->> '$.output', record ->> '$.text', ''))) AS BIGINT) AS chars,
        count({format_sql('record')}) AS recognised FROM raw_records GROUP BY dataset""",
        "raw_records",
    ),
)
def split_arrays(spark, sf):
    """Write the records as array files, then read these in small chunks."""
    out = scratch(spark, "arrays")
    files.write_arrays(load(spark, sf, "raw_records").withColumn("block", ordered.block_of("pos", 2000)), out)
    read = arrays.document_records(spark, out, "*.txt", recursive=True, size=1 << 14)
    body = F.coalesce(F.get_json_object("record", "$.output"), F.get_json_object("record", "$.text"), F.lit(""))
    seen = read.withColumn("dataset", F.regexp_extract("file", r"part=(.+)-\d+/", 1))
    return seen.groupBy("dataset", "shape").agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum(F.size(F.json_object_keys("record"))).alias("n_keys"),
        F.sum(F.length(body)).alias("chars"),
        F.count(detect.record_format(F.col("record"))).alias("recognised"),
    )


@named(
    "bom_read",
    with_inputs(f"SELECT pos, {format_sql('record')} AS format FROM raw_records", "raw_records"),
)
def bom_read(spark, sf):
    """Every record behind a byte-order mark, as a one-element array document."""
    docs = load(spark, sf, "raw_records").select(
        "pos", F.concat(F.lit("\ufeff["), "record", F.lit("]")).alias("content")
    )
    items = detect.array_items(detect.strip_bom(F.col("content")))
    return docs.select("pos", detect.record_format(F.get(items, F.lit(0))).alias("format"))


@named(
    "first_records",
    with_inputs(
        f"""SELECT file, CAST(length(record) AS INT) AS chars, {format_sql('record')} AS format
        FROM (SELECT file, arg_min(record, pos) AS record FROM raw_records GROUP BY file) f""",
        "raw_records",
    ),
)
def first_records(spark, sf):
    firsts = catalog.first_records(raw_records(spark, sf))
    return firsts.select(
        "file", F.length("record").alias("chars"), detect.record_format(F.col("record")).alias("format")
    )


@named(
    "data_folder_files",
    with_inputs(
        """SELECT file_name, length FROM folder_names WHERE file_name NOT LIKE '.%' AND file_name NOT IN ('dataset_info.json', 'README.txt')
        AND (file_name LIKE '%.json' OR file_name LIKE '%.jsonl')""",
        "folder_names",
    ),
)
def data_folder_files(spark, sf):
    return catalog.data_files(load(spark, sf, "folder_names").drop("folder"))


@named(
    "download_files",
    with_inputs(
        """SELECT folder, count(*) AS files, min(file_name) AS first_file FROM folder_names
        WHERE file_name LIKE '%.json' OR file_name LIKE '%.jsonl' GROUP BY folder""",
        "folder_names",
    ),
)
def download_files(spark, sf):
    found = catalog.json_files(load(spark, sf, "folder_names"))
    return found.groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"), F.min("file_name").alias("first_file")
    )


@named("registry_read", with_inputs(f"SELECT {FLAT} FROM registry", "registry"))
def registry_read(spark, sf):
    """Registry rows to one-entry registry documents and back."""
    entries = registry_io.entry_json(registry_frame(spark, sf))
    name = F.regexp_extract(F.to_json(F.array("name")), r"^\[(.*)\]$", 1)
    docs = entries.select(F.concat(F.lit("{"), name, F.lit(": "), "entry", F.lit("}")).alias("content"))
    return flat(registry_io.parse_registry(docs))


UPSERTED = f"""SELECT {FLAT} FROM (SELECT * FROM registry WHERE name NOT IN (SELECT name FROM incoming)
    UNION ALL SELECT * FROM incoming) u"""


@named("registry_write", with_inputs(UPSERTED, "registry", "incoming"))
def registry_write(spark, sf):
    """Two versions of the registry table; the newest is read back."""
    root = scratch(spark, "registry")
    registry_io.write_version(registry_frame(spark, sf), root, 1)
    old = registry_io.read_version(spark, root, 1)
    new = catalog.upsert(old, registry_frame(spark, sf, "incoming"))
    registry_io.write_version(new, root, 2)
    return flat(registry_io.read_version(spark, root))


@named("json_export", detected_sql("SELECT name, format, source FROM listing"))
def json_export(spark, sf):
    out = scratch(spark, "listing")
    listing = catalog.union_listing(
        catalog.registered_listing(
            catalog.drop_stale(registry_frame(spark, sf), load(spark, sf, "source_files"))
        ),
        catalog.discovered_listing(detected(spark, sf)),
    )
    files.write_json(listing, out)
    return spark.read.schema("name string, format string, source string").json(out)


# --- classification ---------------------------------------------------------
@named(
    "format_classifier",
    with_inputs(f"SELECT pos, {format_sql('record')} AS format FROM raw_records", "raw_records"),
)
def format_classifier(spark, sf):
    return load(spark, sf, "raw_records").select(
        "pos", detect.record_format(F.col("record")).alias("format")
    )


@named(
    "message_column",
    with_inputs(f"SELECT pos, {key_sql('record')} AS message_key FROM raw_records", "raw_records"),
)
def message_column(spark, sf):
    column = detect.columns_map(detect.message_column(F.col("record")))
    return load(spark, sf, "raw_records").select(
        "pos", F.try_element_at(column, F.lit("messages")).alias("message_key")
    )


@named(
    "tag_mapping",
    with_inputs(
        f"""SELECT conv_id, turn, style AS role_tag, CASE style WHEN 'role' THEN 'content' WHEN 'from' THEN 'value' END AS content_tag,
        CASE style WHEN 'role' THEN 'user' WHEN 'from' THEN 'human' END AS user_tag,
        CASE style WHEN 'role' THEN 'assistant' WHEN 'from' THEN 'gpt' END AS assistant_tag,
        CASE WHEN style IS NOT NULL THEN 'system' END AS system_tag
        FROM (SELECT conv_id, turn, {style_sql('record')} AS style FROM message_records) s""",
        "message_records",
    ),
)
def tag_mapping(spark, sf):
    tags = detect.tag_map(detect.tag_style(F.col("record")))
    return load(spark, sf, "message_records").withColumn("tags", tags).select(
        "conv_id",
        "turn",
        *[
            F.try_element_at("tags", F.lit(t)).alias(t)
            for t in ("role_tag", "content_tag", "user_tag", "assistant_tag", "system_tag")
        ],
    )


@named(
    "normalised_messages",
    "SELECT conv_id, turn, role, text AS content FROM conversations",
)
def normalised_messages(spark, sf):
    rows = catalog.normalise(load(spark, sf, "message_records"))
    return rows.select("conv_id", "turn", F.inline_outer("messages")).filter("role is not null")


@named(
    "normalised_records",
    with_inputs(
        """SELECT pos, count(role) AS messages, max(CASE WHEN i = 0 THEN role END) AS first_role, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS chars
        FROM (SELECT d.doc_id AS pos, i, CASE WHEN d.doc_id % 8 = 4 THEN 'text' WHEN d.doc_id % 8 = 6 THEN NULL WHEN i = 0 THEN 'user' ELSE 'assistant' END AS role,
            CASE d.doc_id % 8 WHEN 4 THEN CASE WHEN i = 0 THEN text END WHEN 6 THEN NULL WHEN 7 THEN CASE WHEN i = 1 THEN text ELSE '' END
              ELSE CASE WHEN i = 0 THEN substr(text, 1, 40) ELSE text END END AS content
          FROM documents d, (VALUES (0), (1)) v(i) WHERE d.doc_id % 8 <> 5 AND NOT (d.doc_id % 8 = 4 AND i = 1)) x GROUP BY pos
        UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE doc_id % 8 = 5""",
    ),
)
def normalised_records(spark, sf):
    """Records of every shape, read by their dataset's registered tags where there are any."""
    rows = catalog.normalise(raw_records(spark, sf), registry_frame(spark, sf))
    sizes = F.transform("messages", lambda m: F.coalesce(F.length(m["content"]), F.lit(0)))
    return rows.select(
        "pos",
        F.when(F.col("messages").isNotNull(), F.size("messages").cast("bigint")).alias("messages"),
        F.get("messages", F.lit(0))["role"].alias("first_role"),
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("chars"),
    )


# --- listing, counts --------------------------------------------------------
@named(
    "dataset_listing",
    detected_sql(
        """SELECT l.name, l.format, l.source, coalesce(d.examples, 0) AS examples
        FROM listing l LEFT JOIN detected d ON l.name = d.name"""
    ),
)
def dataset_listing(spark, sf):
    return catalog.list_datasets(
        detected(spark, sf), registry_frame(spark, sf), load(spark, sf, "source_files")
    ).select("name", "format", "source", "examples")


@named(
    "example_counts",
    detected_sql(
        """SELECT coalesce(d.name, k.name) AS name, coalesce(d.examples, 0) AS examples
        FROM detected d FULL JOIN registry k ON d.name = k.name"""
    ),
)
def example_counts(spark, sf):
    return catalog.count_examples(detected(spark, sf), registry_frame(spark, sf))


@named(
    "demo_listing",
    detected_sql(
        """SELECT l.name, l.format, 'demo' AS source, coalesce(d.examples, 0) AS examples FROM (
          SELECT name, coalesce(formatting, 'alpaca') AS format FROM registry
          UNION ALL SELECT name, format FROM detected WHERE format IS NOT NULL AND name NOT IN (SELECT name FROM registry)) l
        LEFT JOIN detected d ON l.name = d.name"""
    ),
)
def demo_listing(spark, sf):
    rows = catalog.list_demo_datasets(detected(spark, sf), registry_frame(spark, sf))
    return rows.select("name", "format", "source", "examples")


@named(
    "readiness_bands",
    detected_sql(
        """SELECT name, examples, CASE WHEN examples >= 1000 THEN 'quality' WHEN examples >= 100 THEN 'usable'
        WHEN examples >= 10 THEN 'sanity' ELSE 'too small' END AS band FROM detected"""
    ),
)
def readiness_bands(spark, sf):
    return catalog.readiness(catalog.count_examples(detected(spark, sf)))


@named(
    "name_sort",
    detected_sql("SELECT name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS number FROM listing"),
)
def name_sort(spark, sf):
    listing = catalog.list_datasets(
        detected(spark, sf), registry_frame(spark, sf), load(spark, sf, "source_files")
    )
    return ordered.numbered(listing.select("name"), ["name"]).select("name", "number")


@named(
    "download_vote",
    with_inputs(
        f"""SELECT dataset AS name, coalesce(arg_min(file_name, pos) FILTER (format IS NOT NULL), arg_min(file_name, pos)) AS file_name,
        coalesce(arg_min(format, pos) FILTER (format IS NOT NULL), 'alpaca') AS formatting,
        arg_min(coalesce(key, '-'), pos) FILTER (format IS NOT NULL) AS message_key
        FROM (SELECT dataset, pos, 'part-' || pos || '.jsonl' AS file_name, {format_sql('record')} AS format, {key_sql('record')} AS key
          FROM raw_records) v GROUP BY dataset""",
        "raw_records",
    ),
)
def download_vote(spark, sf):
    """Each record as the first one of a file of its dataset's download."""
    rows = load(spark, sf, "raw_records").select(
        "dataset",
        "pos",
        "record",
        F.concat(F.lit("part-"), F.col("pos").cast("string"), F.lit(".jsonl")).alias("file_name"),
    )
    return catalog.download_vote(rows).select(
        "name",
        "file_name",
        "formatting",
        F.coalesce("message_key", F.lit("-")).alias("message_key"),
    )


CAP = 7


@named(
    "sample_cap",
    with_inputs(
        f"SELECT dataset, pos FROM raw_records QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY pos) <= {CAP}",
        "raw_records",
    ),
)
def sample_cap(spark, sf):
    rows = raw_records(spark, sf, 100).select("dataset", "block", "pos")
    return catalog.sample_cap(rows, CAP).select("dataset", "pos")


# --- registry jobs ----------------------------------------------------------
@named("registered_wins", detected_sql("SELECT name, format, source FROM listing WHERE source = 'auto'"))
def registered_wins(spark, sf):
    kept = catalog.drop_stale(registry_frame(spark, sf), load(spark, sf, "source_files"))
    found = catalog.discovered_listing(detected(spark, sf))
    return found.join(catalog.registered_listing(kept), "name", "left_anti").select("name", "format", "source")


@named("listing_union", detected_sql("SELECT source, count(*) AS n FROM listing GROUP BY source"))
def listing_union(spark, sf):
    kept = catalog.drop_stale(registry_frame(spark, sf), load(spark, sf, "source_files"))
    rows = catalog.union_listing(
        catalog.registered_listing(kept), catalog.discovered_listing(detected(spark, sf))
    )
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@named(
    "stale_entries",
    with_inputs(
        f"""SELECT {FLAT} FROM registry WHERE coalesce(file_name, '') = '' OR file_name IN (SELECT file_name FROM source_files)""",
        "registry",
        "source_files",
    ),
)
def stale_entries(spark, sf):
    return flat(catalog.drop_stale(registry_frame(spark, sf), load(spark, sf, "source_files")))


@named(
    "stale_flags",
    with_inputs(
        """SELECT name, coalesce(file_name, '') <> '' AND file_name NOT IN (SELECT file_name FROM source_files) AS stale FROM registry""",
        "registry",
        "source_files",
    ),
)
def stale_flags(spark, sf):
    """Which registry rows the clean-up would drop."""
    rows = registry_frame(spark, sf)
    kept = catalog.drop_stale(rows, load(spark, sf, "source_files")).select("name", F.lit(False).alias("s"))
    return rows.join(kept, "name", "left").select("name", F.coalesce("s", F.lit(True)).alias("stale"))


@named(
    "register_absent",
    detected_sql(
        f"""SELECT {FLAT} FROM registry UNION ALL
        SELECT {FLAT} FROM (SELECT name, file_name, CAST(NULL AS STRING) AS hf_hub_url, format AS formatting, message_key, tag_style
          FROM detected WHERE format IS NOT NULL AND name NOT IN (SELECT name FROM registry)) n"""
    ),
)
def register_absent(spark, sf):
    entries = catalog.registry_entries(detected(spark, sf))
    return flat(catalog.register_absent(registry_frame(spark, sf), entries))


@named("registry_upsert", with_inputs(UPSERTED, "registry", "incoming"))
def registry_upsert(spark, sf):
    return flat(catalog.upsert(registry_frame(spark, sf), registry_frame(spark, sf, "incoming")))


@named(
    "registry_delete",
    with_inputs(
        """SELECT name, 'kept' AS what, file_name FROM registry WHERE name NOT IN (SELECT name FROM incoming)
        UNION ALL SELECT name, 'file', file_name FROM registry WHERE name IN (SELECT name FROM incoming) AND coalesce(file_name, '') <> ''
        UNION ALL SELECT name, 'unknown', NULL FROM incoming WHERE name NOT IN (SELECT name FROM registry)""",
        "registry",
        "incoming",
    ),
)
def registry_delete(spark, sf):
    names = load(spark, sf, "incoming").select("name")
    kept, doomed, unknown = catalog.delete_entries(registry_frame(spark, sf), names)
    return (
        kept.select("name", F.lit("kept").alias("what"), "file_name")
        .unionByName(doomed.select("name", F.lit("file").alias("what"), "file_name"))
        .unionByName(unknown.select("name", F.lit("unknown").alias("what")), allowMissingColumns=True)
    )


@named(
    "registry_merge",
    with_inputs(
        f"""SELECT {FLAT} FROM (SELECT coalesce(r.name, i.name) AS name,
          CASE WHEN r.name IS NULL THEN i.file_name ELSE r.file_name END AS file_name,
          CASE WHEN r.name IS NULL THEN i.hf_hub_url ELSE r.hf_hub_url END AS hf_hub_url,
          CASE WHEN r.name IS NULL THEN i.formatting ELSE r.formatting END AS formatting,
          coalesce(r.message_key, i.message_key) AS message_key,
          CASE WHEN r.name IS NULL THEN i.tag_style ELSE r.tag_style END AS tag_style
        FROM registry r FULL JOIN incoming i ON r.name = i.name) m""",
        "registry",
        "incoming",
    ),
)
def registry_merge(spark, sf):
    return flat(
        catalog.merge_registries(registry_frame(spark, sf), registry_frame(spark, sf, "incoming"))
    )


@named(
    "missing_files",
    with_inputs(
        """SELECT DISTINCT file_name FROM incoming WHERE file_name NOT IN (SELECT file_name FROM source_files)""",
        "incoming",
        "source_files",
    ),
)
def missing_files(spark, sf):
    source = load(spark, sf, "incoming").select("file_name")
    return catalog.missing_files(source, load(spark, sf, "source_files").select("file_name"))


@named(
    "dataset_targets",
    with_inputs(
        """SELECT d.doc_id, d.source AS name, coalesce(CASE WHEN r.file_name <> '' THEN 'data/' || r.file_name END, r.hf_hub_url, d.source) AS target
        FROM documents d LEFT JOIN registry r ON d.source = r.name""",
        "registry",
    ),
)
def dataset_targets(spark, sf):
    names = table(spark, sf, "documents").select("doc_id", F.col("source").alias("name"))
    return catalog.resolve_datasets(names, registry_frame(spark, sf))


@named(
    "dataset_selection",
    with_inputs(
        """SELECT seq, trim(split_part(dataset, ',', 1)) AS active_dataset, trim(part) AS dataset
        FROM (SELECT seq, dataset, unnest(string_split(dataset, ',')) AS part FROM finished) f WHERE trim(part) <> ''""",
        "finished",
    ),
)
def dataset_selection(spark, sf):
    return catalog.select_datasets(load(spark, sf, "finished").select("seq", "dataset"))


@named(
    "path_parts",
    with_inputs(
        """SELECT path, regexp_replace(path, '^work/', '') AS relative, regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]*$', '') AS stem
        FROM workspace_files""",
        "workspace_files",
    ),
)
def path_parts(spark, sf):
    path = F.col("path")
    return load(spark, sf, "workspace_files").select(
        "path",
        naming.relative_path(path, "work").alias("relative"),
        naming.stem(naming.base_name(path)).alias("stem"),
    )

"""Model, adapter and hub-catalogue queries."""

from pyspark.sql import functions as F

from ..functions import naming
from ..functions.constants import (
    TEMPLATE_BY_NAME,
    TEMPLATE_BY_TYPE,
    TEXT_GENERATION_TYPES,
    TOKENIZER_BY_TYPE,
)
from ..operators import inventory, ordered, search
from .inputs import FAMILY_TYPE, load, table, with_inputs
from .named import named

REPO = "replace(substr(entry, 9), '--', '/')"
TYPES = f"""types AS (SELECT entry, snapshot, coalesce(content ->> '$.model_type', '?') AS model_type FROM cache_configs
    WHERE file_name = 'config.json' AND json_valid(content)),
  models AS (SELECT entry, {REPO} AS repo_id, max(snapshot) AS snapshot FROM cache WHERE entry LIKE 'models--%' GROUP BY entry),
  sized AS (SELECT m.*, (SELECT coalesce(sum(CASE WHEN file_name LIKE '%.safetensors' OR file_name LIKE '%.bin' THEN length ELSE 0 END), 0)
      FROM cache c WHERE c.entry = m.entry AND c.snapshot = m.snapshot) / 1073741824.0 AS size_gb FROM models m),
  typed AS (SELECT s.*, coalesce(t.model_type, '?') AS model_type FROM sized s LEFT JOIN types t ON s.entry = t.entry AND s.snapshot = t.snapshot)"""
KINDS = ", ".join(f"'{t}'" for t in ["?", *TEXT_GENERATION_TYPES])


def cache_sql(body):
    return with_inputs("", "cache", "cache_configs").rstrip() + ", " + TYPES + " " + body


def case_sql(pairs, value):
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def cascade_sql(value):
    tests = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({value}), '{m}')" for m in marks) + f" THEN '{t}'"
        for marks, t in TEMPLATE_BY_NAME
    )
    return f"CASE {tests} ELSE 'qwen3' END"


REASONING = "CASE WHEN contains(lower(repo_id), 'deepseek-r1') OR contains(lower(repo_id), 'deepseekr1') THEN 'deepseekr1' END"


def cache(spark, sf):
    return load(spark, sf, "cache")


def types(spark, sf):
    return inventory.config_types(load(spark, sf, "cache_configs"))


@named(
    "repo_ids",
    with_inputs(
        f"SELECT DISTINCT entry, CASE WHEN entry LIKE 'models--%' THEN {REPO} END AS repo_id FROM cache", "cache"
    ),
)
def repo_ids(spark, sf):
    return cache(spark, sf).select("entry", naming.repo_id(F.col("entry")).alias("repo_id")).distinct()


@named("safe_names", with_inputs("SELECT id, replace(id, '/', '_') AS name FROM catalogue", "catalogue"))
def safe_names(spark, sf):
    return load(spark, sf, "catalogue").select("id", naming.safe_name(F.col("id")).alias("name"))


@named(
    "chosen_snapshots",
    with_inputs("SELECT entry, max(snapshot) AS snapshot FROM cache GROUP BY entry", "cache"),
)
def chosen_snapshots(spark, sf):
    return inventory.chosen_snapshots(cache(spark, sf))


@named("model_sizes", cache_sql("SELECT repo_id, snapshot, round(size_gb, 6) AS size_gb FROM sized"))
def model_sizes(spark, sf):
    return inventory.model_sizes(cache(spark, sf)).select(
        "repo_id", "snapshot", F.round("size_gb", 6).alias("size_gb")
    )


@named("model_config_scan", cache_sql("SELECT entry, snapshot, model_type FROM types"))
def model_config_scan(spark, sf):
    return types(spark, sf)


@named("model_types", cache_sql("SELECT repo_id, snapshot, model_type FROM typed"))
def model_types(spark, sf):
    models = inventory.with_types(inventory.model_sizes(cache(spark, sf)), types(spark, sf))
    return models.select("repo_id", "snapshot", "model_type")


@named(
    "text_generation_models",
    f"SELECT p_partkey, {FAMILY_TYPE} AS model_type FROM part WHERE {FAMILY_TYPE} IN ({KINDS})",
)
def text_generation_models(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr(FAMILY_TYPE).alias("model_type"))
    return inventory.text_generation(rows)


@named(
    "model_listing",
    cache_sql(f"SELECT repo_id, round(size_gb, 6) AS size_gb, model_type FROM typed WHERE model_type IN ({KINDS})"),
)
def model_listing(spark, sf):
    rows = inventory.list_models(cache(spark, sf), types(spark, sf))
    return rows.withColumn("size_gb", F.round("size_gb", 6))


@named(
    "models_sorted",
    cache_sql(
        f"""SELECT repo_id, CAST(row_number() OVER (ORDER BY lower(repo_id), repo_id) AS BIGINT) AS number
        FROM typed WHERE model_type IN ({KINDS})"""
    ),
)
def models_sorted(spark, sf):
    models = inventory.list_models(cache(spark, sf), types(spark, sf)).select("repo_id")
    keyed = models.withColumn("sort_key", F.lower("repo_id"))
    return ordered.numbered(keyed, ["sort_key", "repo_id"]).select("repo_id", "number")


LOOKUP = f"""asked AS (SELECT DISTINCT upper({REPO}) AS repo_id FROM cache),
  found AS (SELECT lower(m.repo_id) AS k, arg_min(t.model_type, m.entry) AS model_type
    FROM models m JOIN types t ON m.entry = t.entry AND m.snapshot = t.snapshot GROUP BY 1),
  looked AS (SELECT a.repo_id, f.model_type FROM asked a LEFT JOIN found f ON lower(a.repo_id) = f.k)"""


def asked(spark, sf):
    repo = F.replace(F.expr("substr(entry, 9)"), F.lit("--"), F.lit("/"))
    return cache(spark, sf).select(F.upper(repo).alias("repo_id")).distinct()


@named("type_lookup", cache_sql("SELECT * FROM looked").replace(TYPES, TYPES + ", " + LOOKUP))
def type_lookup(spark, sf):
    return inventory.lookup_types(asked(spark, sf), cache(spark, sf), types(spark, sf))


@named(
    "template_by_type",
    cache_sql(
        f"SELECT repo_id, {case_sql(TEMPLATE_BY_TYPE, 'model_type')} AS template FROM typed"
    ),
)
def template_by_type(spark, sf):
    models = inventory.with_types(inventory.model_sizes(cache(spark, sf)), types(spark, sf))
    return models.select("repo_id", naming.type_template(F.col("model_type")).alias("template"))


@named(
    "reasoning_templates",
    with_inputs(f"SELECT DISTINCT repo_id, {REASONING} AS template FROM (SELECT {REPO} AS repo_id FROM cache) c", "cache"),
)
def reasoning_templates(spark, sf):
    ids = asked_plain(spark, sf)
    return ids.select("repo_id", naming.reasoning_template(F.col("repo_id")).alias("template"))


def asked_plain(spark, sf):
    repo = F.replace(F.expr("substr(entry, 9)"), F.lit("--"), F.lit("/"))
    return cache(spark, sf).select(repo.alias("repo_id")).distinct()


@named(
    "template_cascade",
    with_inputs(f"SELECT id, {cascade_sql('id')} AS template FROM catalogue", "catalogue"),
)
def template_cascade(spark, sf):
    return load(spark, sf, "catalogue").select("id", naming.name_template(F.col("id")).alias("template"))


@named(
    "templates",
    cache_sql(
        f"""SELECT repo_id, model_type, coalesce({REASONING}, {case_sql(TEMPLATE_BY_TYPE, 'model_type')}, {cascade_sql('repo_id')}) AS template
        FROM looked"""
    ).replace(TYPES, TYPES + ", " + LOOKUP),
)
def templates(spark, sf):
    return inventory.templates(asked(spark, sf), cache(spark, sf), types(spark, sf))


# --- adapters, merged models, chat choices ----------------------------------
ADAPTERS = """adapters AS (SELECT path, coalesce(nullif(CASE WHEN json_valid(content) THEN content ->> '$.base_model_name_or_path' END, ''), 'unknown') AS base_model
    FROM adapter_configs)"""


def found_adapters(spark, sf):
    return inventory.adapters(load(spark, sf, "adapter_configs"))


#: Paths of a row: few, so that base models have several rows.
PATHS = 50


@named(
    "adapters_by_base",
    with_inputs("", "adapter_configs").rstrip()
    + f""", {ADAPTERS} SELECT base_model, part, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM (
      SELECT *, CAST(floor((row_number() OVER (PARTITION BY base_model ORDER BY path) - 1) / {PATHS}) AS BIGINT) AS part
      FROM adapters) a GROUP BY base_model, part""",
)
def adapters_by_base(spark, sf):
    rows = inventory.adapters_by_base(found_adapters(spark, sf), PATHS)
    return rows.select(
        "base_model", "part", F.size("paths").cast("bigint").alias("n"), F.array_join("paths", ",").alias("paths")
    )


@named(
    "adapter_listing",
    with_inputs(
        """SELECT regexp_replace(regexp_replace(path, '/[^/]+$', ''), '^work/saves/', '') AS path, regexp_replace(path, '/[^/]+$', '') AS full_path
        FROM workspace_files WHERE path LIKE '%/adapter_config.json'""",
        "workspace_files",
    ),
)
def adapter_listing(spark, sf):
    return inventory.list_adapters(load(spark, sf, "workspace_files"), "work/saves")


MERGED = """SELECT regexp_extract(path, '^work/models/([^/]+)/config\\.json$', 1) AS name FROM workspace_files
    WHERE regexp_matches(path, '^work/models/[^/]+/config\\.json$')"""


@named("merged_listing", with_inputs(MERGED, "workspace_files"))
def merged_listing(spark, sf):
    return inventory.list_merged(load(spark, sf, "workspace_files"), "work/models")


OPTIONS = (
    with_inputs("", "cache", "cache_configs", "adapter_configs", "workspace_files").rstrip()
    + f""", {TYPES}, {ADAPTERS}, shown AS (SELECT repo_id FROM typed WHERE model_type IN ({KINDS})),
  options AS (SELECT repo_id AS model, NULL AS adapter, 'base' AS kind FROM shown
    UNION ALL SELECT base_model, path, 'adapter' FROM adapters WHERE base_model IN (SELECT repo_id FROM shown)
    UNION ALL SELECT name, NULL, 'merged' FROM (SELECT DISTINCT * FROM ({MERGED}) m) d) """
)


def options(spark, sf):
    models = inventory.list_models(cache(spark, sf), types(spark, sf))
    merged = inventory.list_merged(load(spark, sf, "workspace_files"), "work/models").distinct()
    return inventory.chat_options(models, found_adapters(spark, sf), merged)


@named("chat_options", OPTIONS + "SELECT model, adapter, kind FROM options")
def chat_options(spark, sf):
    return options(spark, sf)


@named("chat_option_union", OPTIONS + "SELECT kind, count(*) AS n FROM options GROUP BY kind")
def chat_option_union(spark, sf):
    return options(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@named(
    "tokenizer_audit",
    with_inputs(
        f"""SELECT repo_id, snapshot, found, expected, replace(replace(replace(tok, found, expected), '": ', '":'), ', "', ',"') AS corrected FROM (
          SELECT entry, {REPO} AS repo_id, snapshot, tok, tok ->> '$.tokenizer_class' AS found,
            {case_sql(TOKENIZER_BY_TYPE, "CASE WHEN json_valid(cfg) THEN cfg ->> '$.model_type' END")} AS expected FROM (
            SELECT c.entry, c.snapshot, c.content AS cfg, t.content AS tok,
              row_number() OVER (PARTITION BY c.entry ORDER BY c.snapshot DESC) AS rn
            FROM cache_configs c JOIN cache_configs t ON c.entry = t.entry AND c.snapshot = t.snapshot
            WHERE c.file_name = 'config.json' AND t.file_name = 'tokenizer_config.json' AND c.entry LIKE 'models--%') p WHERE rn = 1) q
        WHERE expected IS NOT NULL AND found <> expected""",
        "cache_configs",
    ),
)
def tokenizer_audit(spark, sf):
    return inventory.tokenizer_audit(load(spark, sf, "cache_configs"))


# --- hub catalogue ----------------------------------------------------------
TEXT_TASK = "list_contains(coalesce(string_split(tag_text, ','), []), 'text-generation') OR coalesce(pipeline_tag, '') = 'text-generation'"


def catalogue(spark, sf):
    return load(spark, sf, "catalogue").withColumn("tags", F.split("tag_text", ","))


def top_sql(word, only):
    return f"""SELECT CAST(row_number() OVER (ORDER BY rank DESC) AS INT) AS number, id, downloads, likes FROM (
      SELECT * FROM (SELECT id, coalesce(downloads, 0) AS downloads, likes, tag_text, pipeline_tag,
        row_number() OVER (ORDER BY coalesce(downloads, 0) DESC, id) AS rank FROM catalogue WHERE contains(lower(id), '{word}')) r
      WHERE rank <= 20 {'AND (' + TEXT_TASK + ')' if only else ''} ORDER BY rank DESC LIMIT 10) t"""


@named(
    "hub_text_generation",
    with_inputs(f"SELECT id, downloads, likes FROM catalogue WHERE {TEXT_TASK}", "catalogue"),
)
def hub_text_generation(spark, sf):
    return catalogue(spark, sf).filter(search.generates_text()).select("id", "downloads", "likes")


@named("model_search", with_inputs(top_sql("ring", True), "catalogue"))
def model_search(spark, sf):
    return search.search(catalogue(spark, sf), "ring")


@named("dataset_search", with_inputs(top_sql("bolt", False), "catalogue"))
def dataset_search(spark, sf):
    return search.search(catalogue(spark, sf), "Bolt", models_only=False)

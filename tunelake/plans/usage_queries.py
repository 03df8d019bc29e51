"""Workspace usage, health and size queries."""

from pyspark.sql import functions as F

from ..functions import sizes
from ..operators import ordered, usage
from ..sources import files
from .inputs import load, table, with_inputs
from .named import named
from .session import scratch

SHORT = """CASE WHEN bytes >= 1073741824 THEN printf('%.2f GB', bytes / 1073741824.0) WHEN bytes >= 1048576 THEN printf('%.1f MB', bytes / 1048576.0)
    ELSE bytes || ' B' END"""


def long_sql(n):
    tests = " ".join(
        f"WHEN {n} < {1024 ** (i + 1)} THEN printf('%.1f {u}', {n} / {1024 ** i}.0)" for i, u in enumerate(sizes.UNITS)
    )
    return f"CASE WHEN {n} IS NULL THEN '?' {tests} ELSE printf('%.1f PB', {n} / {1024 ** 5}.0) END"


@named(
    "manifest_scan",
    "SELECT source AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source",
)
def manifest_scan(spark, sf):
    """Sizes of text files, one folder per source, that hold the documents."""
    folder = scratch(spark, "manifest")
    rows = table(spark, sf, "documents").withColumn("block", ordered.block_of("doc_id"))
    files.write_lines(rows, folder, "source", "text", "doc_id")
    found = files.file_manifest(spark, folder).filter("file_name LIKE 'part-%'")
    name = F.regexp_extract("path", r"source=([^/]+)/", 1)
    return found.groupBy(name.alias("folder")).agg(F.sum("length").alias("bytes"))


@named(
    "directory_usage",
    with_inputs(
        f"""SELECT directory, files, bytes, {SHORT} AS size FROM (
          SELECT l.directory, count(d.directory) AS files, CAST(coalesce(sum(d.length), 0) AS BIGINT) AS bytes
          FROM (VALUES ('data'), ('yaml'), ('saves'), ('models'), ('configs')) l(directory)
          LEFT JOIN disk_files d ON l.directory = d.directory GROUP BY l.directory) u""",
        "disk_files",
    ),
)
def directory_usage(spark, sf):
    return usage.workspace_usage(load(spark, sf, "disk_files"))


@named(
    "download_totals",
    with_inputs(
        f"""SELECT repo_id, bytes, CASE WHEN bytes = 0 THEN 'unknown' ELSE {long_sql('bytes')} END AS size
        FROM (SELECT repo_id, CAST(sum(coalesce(length, 0)) AS BIGINT) AS bytes FROM page_files GROUP BY repo_id) t""",
        "page_files",
    ),
)
def download_totals(spark, sf):
    return usage.download_totals(load(spark, sf, "page_files"))


@named(
    "size_texts",
    f"""SELECT doc_id, {long_sql('n')} AS size FROM (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN n_chars * CAST(pow(10, doc_id % 12) AS BIGINT) END AS n FROM documents) s""",
)
def size_texts(spark, sf):
    n = F.when(F.col("doc_id") % 9 != 0, F.col("n_chars") * F.pow(F.lit(10), F.col("doc_id") % 12).cast("bigint"))
    return table(spark, sf, "documents").select("doc_id", sizes.size_text(n).alias("size"))


@named(
    "short_sizes",
    f"SELECT doc_id, {SHORT} AS size FROM (SELECT doc_id, n_chars * CAST(pow(10, doc_id % 8) AS BIGINT) AS bytes FROM documents) s",
)
def short_sizes(spark, sf):
    n = F.col("n_chars") * F.pow(F.lit(10), F.col("doc_id") % 8).cast("bigint")
    return table(spark, sf, "documents").select("doc_id", sizes.short_size_text(n).alias("size"))


HEALTH = """SELECT 'doc_' || e.event_id || '.json' AS file, CASE WHEN x.file IS NULL THEN 'missing' WHEN json_valid(x.content) THEN 'valid' ELSE 'corrupted' END AS status
    FROM events e LEFT JOIN dataset_documents x ON x.file = 'doc_' || e.event_id || '.json'"""


def health(spark, sf):
    """A file is expected per event; those without a document are missing."""
    name = F.concat(F.lit("doc_"), F.col("event_id").cast("string"), F.lit(".json"))
    expected = table(spark, sf, "events").select(name.alias("file"))
    present = load(spark, sf, "dataset_documents")
    return usage.file_health(expected, present.select("file", "content"))


@named("file_health", with_inputs(HEALTH, "dataset_documents"))
def file_health(spark, sf):
    return health(spark, sf)


@named(
    "registry_health",
    with_inputs(f"SELECT status, count(*) AS files FROM ({HEALTH}) h GROUP BY status", "dataset_documents"),
)
def registry_health(spark, sf):
    return usage.health_counts(health(spark, sf))


@named(
    "state_health",
    with_inputs(
        """SELECT 'state_' || p.p_partkey || '.yaml' AS file, CASE WHEN d.file IS NULL THEN 'missing'
        WHEN d.content LIKE '# state%' THEN 'valid' ELSE 'corrupted' END AS status
        FROM part p LEFT JOIN state_documents d ON d.file = 'state_' || p.p_partkey || '.yaml'""",
        "state_documents",
    ),
)
def state_health(spark, sf):
    """Health of one YAML state file per part."""
    name = F.concat(F.lit("state_"), F.col("p_partkey").cast("string"), F.lit(".yaml"))
    return usage.file_health(table(spark, sf, "part").select(name.alias("file")), load(spark, sf, "state_documents"))


@named(
    "error_kinds",
    with_inputs(
        """SELECT event_id, CASE WHEN exception = 'GatedRepoError' THEN 'auth' WHEN exception = 'RepositoryNotFoundError' THEN 'not_found'
        WHEN status IN (401, 403) THEN 'auth' WHEN status = 404 THEN 'not_found' WHEN exception IN ('ConnectionError', 'Timeout') THEN 'network'
        WHEN exception IN ('OSError', 'HTTPError', 'IOError') AND (lower(message) LIKE '%disk%' OR lower(message) LIKE '%space%') THEN 'disk'
        ELSE 'unknown' END AS kind FROM download_log""",
        "download_log",
    ),
)
def error_kinds(spark, sf):
    return usage.error_kinds(load(spark, sf, "download_log")).select("event_id", "kind")

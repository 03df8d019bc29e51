"""Run config, manifest, history and state queries."""

from pyspark.sql import functions as F

from ..functions import naming
from ..functions.constants import CONFIG_DEFAULTS, HISTORY_FIELDS, STATE_DEFAULTS
from ..operators import ordered, runs, trainlog
from ..sources import configs
from .inputs import load, table, with_inputs
from .log_queries import LIMIT, PARSED, TARGET, log_lines
from .named import named

HISTORY = """history AS (SELECT seq, run AS name, run AS output_name, model, 'saves/' || run || '/lora' AS adapter, template, dataset, stage, epochs,
    'configs/' || run || '.yaml' AS config, strftime(finished_at, '%Y-%m-%d %H:%M') AS timestamp FROM finished WHERE success)"""


def history_sql(body, *more):
    return with_inputs("", "finished", *more).rstrip() + ", " + HISTORY + " " + body


def history(spark, sf):
    return runs.history_records(load(spark, sf, "finished"))


# --- configs ----------------------------------------------------------------
@named(
    "config_scan",
    with_inputs(
        """SELECT run, 'bf16' AS key, 'true' AS value FROM docs UNION ALL SELECT run, 'empty', NULL FROM docs
        UNION ALL SELECT run, 'dataset', regexp_extract(content, 'dataset: ''(.*)''', 1) FROM docs
        UNION ALL SELECT run, 'cutoff_len', regexp_extract(content, 'cutoff_len: (\\d+)', 1) FROM docs
        UNION ALL SELECT run, 'output_dir', regexp_extract(content, 'output_dir: (\\S+)', 1) FROM docs
        UNION ALL SELECT run, 'noted', regexp_extract(content, 'noted: (.*)  #', 1) FROM docs
        UNION ALL SELECT run, 'quoted key', regexp_extract(content, 'quoted key.: (.*)', 1) FROM docs
        UNION ALL SELECT run, 'folded', regexp_extract(content, 'folded: (.*)', 1) || ' ' || regexp_extract(content, 'folded: .*\\n  (.*)', 1)
          || ' ' || regexp_extract(content, 'folded: .*\\n  .*\\n  (.*)', 1) FROM docs
        UNION ALL SELECT run, 'escaped', replace(replace(replace(regexp_extract(content, 'escaped: "(.*)"', 1),
          CHR(92) || 'n', CHR(10)), CHR(92) || 'u00e9', 'é'), CHR(92) || '"', '"') FROM docs""",
        "config_documents",
    ).replace("config_documents AS", "docs AS"),
)
def config_scan(spark, sf):
    return configs.config_entries(load(spark, sf, "config_documents"))


@named(
    "summary_scan",
    history_sql(
        "SELECT name, output_name, model, adapter, coalesce(template, '?') AS template, trim(dataset) AS dataset, stage, epochs, config, timestamp, seq FROM history"
    ),
)
def summary_scan(spark, sf):
    """History records as summary documents and back."""
    rows = history(spark, sf)
    lines = F.array(
        *[
            F.concat(F.lit(f"{c}: "), F.coalesce(F.trim(F.col(c).cast("string")), F.lit("'?'")))
            for c in HISTORY_FIELDS
        ]
    )
    docs = rows.select("seq", F.array_join(lines, "\n").alias("content"))
    return configs.history_rows(docs)


@named(
    "wide_configs",
    with_inputs(
        """SELECT run, max(CASE WHEN key = 'template' THEN value END) AS template, max(CASE WHEN key = 'stage' THEN value END) AS stage,
        max(CASE WHEN key = 'cutoff_len' THEN value END) AS cutoff_len FROM config_entries GROUP BY run""",
        "config_entries",
    ),
)
def wide_configs(spark, sf):
    return runs.wide_configs(load(spark, sf, "config_entries"), ["template", "stage", "cutoff_len"])


@named(
    "config_overlay",
    with_inputs(
        f"""SELECT run, key, arg_max(value, p) AS value FROM (
          SELECT r.run, d.key, d.value, 0 AS p FROM (SELECT DISTINCT run FROM config_entries) r,
            (VALUES {', '.join(f"('{k}', '{v}')" for k, v in CONFIG_DEFAULTS.items())}) d(key, value)
          UNION ALL SELECT run, key, value, 1 FROM config_entries) l GROUP BY run, key""",
        "config_entries",
    ),
)
def config_overlay(spark, sf):
    own = load(spark, sf, "config_entries")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in CONFIG_DEFAULTS.items()])
    defaults = own.select("run").distinct().select("run", F.inline(pairs))
    return runs.overlay(defaults, own)


DEFAULT_ROWS = {
    "num_train_epochs": "coalesce(param_epochs, epochs)",
    "learning_rate": "coalesce(learning_rate, '0.0001')",
    "per_device_train_batch_size": "coalesce(batch_size, '2')",
    "gradient_accumulation_steps": "coalesce(grad_accum, '8')",
    "cutoff_len": "coalesce(cutoff_len, '512')",
    "warmup_ratio": "coalesce(warmup_ratio, '0.1')",
    "save_steps": "CASE WHEN target_loss IS NOT NULL THEN '1' ELSE '100' END",
    "logging_steps": "CASE WHEN target_loss IS NOT NULL THEN '1' ELSE '5' END",
    "model_name_or_path": "model", "template": "template", "dataset": "dataset", "dataset_dir": "'data'",
    "output_dir": "'saves/' || run || '/lora'", "bf16": "bf16", "fp16": "fp16",
    "preprocessing_num_workers": "workers", "dataloader_pin_memory": "pin_memory", "finetuning_type": "method",
    "lora_rank": "CASE WHEN method = 'lora' THEN coalesce(lora_rank, '8') END",
    "lora_dropout": "CASE WHEN method = 'lora' THEN coalesce(lora_dropout, '0.05') END",
    "lora_alpha": "CASE WHEN method = 'lora' AND lora_alpha <> '0' THEN lora_alpha END",
    "lora_target": "CASE WHEN method = 'lora' THEN 'all' END",
    "stage": "'sft'", "max_samples": "'10000'", "lr_scheduler_type": "'cosine'", "plot_loss": "'true'",
    "seed": "seed", "overwrite_output_dir": "'true'", "report_to": "'none'", "trust_remote_code": "'true'", "do_train": "'true'",
}


@named(
    "run_configs",
    with_inputs(
        "SELECT * FROM ("
        + " UNION ALL ".join(f"SELECT run, '{k}' AS key, {v} AS value FROM sweep" for k, v in DEFAULT_ROWS.items())
        + ") c WHERE value IS NOT NULL",
        "sweep",
    ),
)
def run_configs(spark, sf):
    return runs.build_configs(load(spark, sf, "sweep"))


SAFE = {"preprocessing_num_workers": "8", "dataloader_pin_memory": "true"}


@named(
    "config_patch",
    with_inputs(
        """SELECT run, key, value FROM config_entries WHERE key <> 'dataloader_pin_memory'
        UNION ALL SELECT DISTINCT run, 'dataloader_pin_memory', 'true' FROM config_entries
        UNION ALL SELECT DISTINCT run, 'preprocessing_num_workers', '8' FROM config_entries""",
        "config_entries",
    ),
)
def config_patch(spark, sf):
    return runs.patch(load(spark, sf, "config_entries"), SAFE)[0]


PIN = {"dataloader_pin_memory": "true"}


@named(
    "config_patch_changes",
    with_inputs(
        "SELECT run, max(CASE WHEN key = 'dataloader_pin_memory' THEN value END) IS DISTINCT FROM 'true' AS changed FROM config_entries GROUP BY run",
        "config_entries",
    ),
)
def config_patch_changes(spark, sf):
    return runs.patch(load(spark, sf, "config_entries"), PIN)[1]


@named(
    "output_dirs",
    with_inputs(
        "SELECT run, key, CASE WHEN key = 'output_dir' THEN 'saves/' || run || '/lora' ELSE value END AS value FROM config_entries",
        "config_entries",
    ),
)
def output_dirs(spark, sf):
    return runs.fix_output_dir(load(spark, sf, "config_entries"))


NEXT = "'run_' || CAST(CAST(substr(run, 5) AS BIGINT) + 1 AS STRING)"


@named(
    "config_diff",
    with_inputs(
        f"""SELECT coalesce(a.run, b.run) AS run, coalesce(a.key, b.key) AS key, a.value AS left_value, b.value AS right_value
        FROM config_entries a FULL JOIN (SELECT {NEXT} AS run, key, value FROM config_entries) b ON a.run = b.run AND a.key = b.key
        WHERE a.value IS DISTINCT FROM b.value OR a.run IS NULL OR b.run IS NULL""",
        "config_entries",
    ),
)
def config_diff(spark, sf):
    """Each run against the one before it."""
    own = load(spark, sf, "config_entries")
    before = own.withColumn("run", F.expr(NEXT))
    return runs.diff(own, before, keys=("run", "key"))


# --- manifests --------------------------------------------------------------
@named(
    "manifest_entries",
    with_inputs(
        """SELECT run, 'command' AS key, 'quick_train' AS value FROM docs
        UNION ALL SELECT run, 'cli_args.model', regexp_extract(content, 'cli_args.model: ([^\\n]*)', 1) FROM docs
        UNION ALL SELECT run, 'random_seed', regexp_extract(content, 'random_seed: (\\d+)', 1) FROM docs""",
        "config_documents",
    ).replace("config_documents AS", "docs AS"),
)
def manifest_entries(spark, sf):
    return configs.manifest_entries(load(spark, sf, "config_documents"))


@named(
    "manifest_headers",
    with_inputs(
        """SELECT run, '# run manifest' || CHR(10) || '# ---------------------------------' || CHR(10) || '#   model: ' || model || CHR(10)
        || '#   cli_args.dataset: ' || dataset || CHR(10) AS header FROM sweep""",
        "sweep",
    ),
)
def manifest_headers(spark, sf):
    items = F.array(
        F.struct(F.lit("model").alias("key"), F.col("model").alias("value")),
        F.struct(F.lit("cli_args.dataset").alias("key"), F.col("dataset").alias("value")),
    )
    return load(spark, sf, "sweep").select("run", configs.manifest_header(items, "run manifest").alias("header"))


@named(
    "manifests",
    with_inputs(
        """SELECT run, key, value FROM (
          SELECT run, 'command' AS key, 'train' AS value FROM sweep UNION ALL SELECT run, 'platform', 'linux' FROM sweep
          UNION ALL SELECT run, 'cli_args.model', model FROM sweep UNION ALL SELECT run, 'cli_args.learning_rate', learning_rate FROM sweep
          UNION ALL SELECT run, 'random_seed', lora_alpha FROM sweep) m WHERE value IS NOT NULL""",
        "sweep",
    ),
)
def manifests(spark, sf):
    absent = F.lit(None).cast("string")
    rows = load(spark, sf, "sweep").select(
        "run",
        *[absent.alias(k) for k in ("tool_version", "trainer_version", "python_version", "git_commit", "timestamp")],
        F.lit("linux").alias("platform"),
        F.lit("train").alias("command"),
        F.col("lora_alpha").alias("seed"),
        "model",
        "learning_rate",
    )
    return runs.manifests(rows, ["model", "learning_rate"])


# --- history ----------------------------------------------------------------
@named(
    "history_append",
    history_sql(
        f"SELECT {', '.join(HISTORY_FIELDS)}, seq FROM history WHERE seq % 2 = 0 UNION ALL SELECT {', '.join(HISTORY_FIELDS)}, seq FROM history WHERE seq % 2 = 1"
    ),
)
def history_append(spark, sf):
    """The even runs are recorded already, the odd ones are appended."""
    rows = load(spark, sf, "finished")
    old = runs.history_records(rows.filter("seq % 2 = 0"))
    return runs.append_history(old, rows.filter("seq % 2 = 1"))


@named(
    "history_times",
    history_sql("SELECT seq, strptime(timestamp, '%Y-%m-%d %H:%M') AS recorded_at FROM history"),
)
def history_times(spark, sf):
    return runs.parsed_times(history(spark, sf)).select("seq", "recorded_at")


@named(
    "history_listing",
    history_sql(
        """SELECT row_number() OVER (ORDER BY seq) AS number, output_name, model, dataset, stage, CAST(epochs AS STRING) AS epochs FROM history"""
    ),
)
def history_listing(spark, sf):
    return runs.list_history(history(spark, sf))


@named(
    "listing_defaults",
    history_sql("SELECT seq, coalesce(template, '?') AS template FROM history"),
)
def listing_defaults(spark, sf):
    return history(spark, sf).select("seq", F.coalesce("template", F.lit("?")).alias("template"))


@named(
    "numbered_runs",
    history_sql("SELECT model, seq, row_number() OVER (PARTITION BY model ORDER BY seq) AS number FROM history"),
)
def numbered_runs(spark, sf):
    return ordered.numbered(history(spark, sf).select("model", "seq"), ["seq"], within=["model"])


@named(
    "latest_runs",
    history_sql("SELECT model, max(seq) AS seq, arg_max(name, seq) AS name, arg_max(dataset, seq) AS dataset FROM history GROUP BY model"),
)
def latest_runs(spark, sf):
    return runs.latest_run(history(spark, sf), ["model"]).select("model", "seq", "name", "dataset")


@named(
    "history_without_runs",
    history_sql("SELECT seq, name FROM history WHERE name NOT IN (SELECT run FROM finished WHERE NOT success)"),
)
def history_without_runs(spark, sf):
    failed = load(spark, sf, "finished").filter(~F.col("success")).select(F.col("run").alias("name"))
    return runs.without_runs(history(spark, sf), failed).select("seq", "name")


@named(
    "history_reset",
    history_sql("SELECT seq, name FROM history WHERE name NOT IN (SELECT name FROM history WHERE template IS NULL)"),
)
def history_reset(spark, sf):
    """Names with a record without template are reset."""
    rows = history(spark, sf)
    return runs.reset_history(rows, rows.filter("template IS NULL")).select("seq", "name")


@named(
    "run_reconciliation",
    history_sql(
        """SELECT h.adapter, h.name, CASE WHEN a.path IS NULL THEN 'missing adapter' ELSE 'ok' END AS status
        FROM history h LEFT JOIN (SELECT DISTINCT path FROM adapter_configs WHERE content <> 'broken') a ON h.adapter = a.path
        UNION ALL SELECT DISTINCT path, NULL, 'no history' FROM adapter_configs
        WHERE content <> 'broken' AND path NOT IN (SELECT adapter FROM history)""",
        "adapter_configs",
    ),
)
def run_reconciliation(spark, sf):
    """An adapter whose config is broken counts as gone."""
    found = load(spark, sf, "adapter_configs").filter("content <> 'broken'").select("path")
    return runs.reconcile(history(spark, sf), found)


@named(
    "run_summary",
    with_inputs("", "log_lines", "finished").rstrip()
    + f""", {PARSED}, {HISTORY},
    counted AS (SELECT run, count(*) FILTER (m) AS steps, arg_max(total, line_no) FILTER (total IS NOT NULL) AS total_steps FROM parsed GROUP BY run)
    SELECT h.name AS run, h.model, h.dataset, c.steps, c.total_steps, CASE WHEN NOT isnan(first_loss) THEN first_loss END AS first_loss,
      CASE WHEN NOT isnan(last_loss) THEN last_loss END AS last_loss, best_loss, best_step, target_hit, early_stopped
    FROM history h LEFT JOIN counted c ON h.name = c.run LEFT JOIN outcome o ON h.name = o.run""",
)
def run_summary(spark, sf):
    lines = log_lines(spark, sf)
    outcome = trainlog.outcomes(trainlog.monitor(lines, TARGET, LIMIT))
    rows = runs.run_summary(history(spark, sf), trainlog.counters(lines), outcome)
    for c in ("first_loss", "last_loss"):
        rows = rows.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return rows


# --- state, names -----------------------------------------------------------
@named(
    "state_defaults",
    with_inputs(
        "SELECT user_id, " + ", ".join(f"coalesce({k}, '{v}') AS {k}" for k, v in STATE_DEFAULTS.items()) + " FROM states",
        "states",
    ),
)
def state_defaults(spark, sf):
    return runs.merge_state(load(spark, sf, "states"))


@named(
    "state_reset",
    with_inputs(
        "SELECT user_id, "
        + ", ".join(f"CASE WHEN theme = 'light' THEN '{v}' ELSE coalesce({k}, '{v}') END AS {k}" for k, v in STATE_DEFAULTS.items())
        + " FROM states",
        "states",
    ),
)
def state_reset(spark, sf):
    """Users of the light theme are reset."""
    states = load(spark, sf, "states")
    return runs.reset_state(states, states.filter("theme = 'light'"))


@named(
    "state_after_run",
    history_sql(
        """SELECT name, model AS active_model, trim(split_part(dataset, ',', 1)) AS active_dataset, template AS active_template, adapter AS active_adapter FROM history"""
    ),
)
def state_after_run(spark, sf):
    return runs.state_after(history(spark, sf))


@named(
    "export_names",
    with_inputs(
        """SELECT path, 'models/' || regexp_extract(replace(regexp_replace(path, '/+$', ''), '/lora', ''), '[^/]+$') AS destination FROM adapter_configs""",
        "adapter_configs",
    ),
)
def export_names(spark, sf):
    return load(spark, sf, "adapter_configs").select("path", naming.export_name(F.col("path")).alias("destination"))


@named("run_names", "SELECT event_id, strftime(ts, 'run_%Y%m%d_%H%M%S') AS run FROM events")
def run_names(spark, sf):
    return table(spark, sf, "events").select("event_id", naming.run_name(F.col("ts")).alias("run"))

"""Run configs, manifests, run history and application state.

Configs are rows (run, key, value) with text values.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.constants import (
    CONFIG_DEFAULTS,
    LORA_DEFAULTS,
    STATE_DEFAULTS,
    TARGET_LOSS_STEPS,
)
from ..functions.detect import strip_space
from . import ordered


# --- configs ----------------------------------------------------------------
def overlay(*layers: DataFrame, keys=("run", "key")) -> DataFrame:
    """Merge (run, key, value) layers; the later layer wins for a key, even with NULL."""
    stacked = None
    for priority, layer in enumerate(layers):
        one = layer.select(*keys, "value", F.lit(priority).alias("_priority"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return (
        stacked.groupBy(*keys)
        .agg(F.max_by(F.struct("value"), "_priority").alias("_v"))
        .select(*keys, F.col("_v.value").alias("value"))
    )


def build_configs(sweep: DataFrame, data_dir: str = "data") -> DataFrame:
    """Training config of every run of a sweep, as (run, key, value).

    `sweep` has run, model, template, dataset, epochs, method, the optional parameters
    lora_rank, lora_dropout, lora_alpha, learning_rate, param_epochs, batch_size, grad_accum,
    cutoff_len, warmup_ratio, target_loss, the probed bf16, fp16, workers, pin_memory, and
    possibly the seed of the run's manifest; all text, NULL where not given. All layers of a run lie in its own row, so the overlay is a
    projection without a shuffle.
    """
    c = F.col
    lora = c("method") == "lora"
    targeted = c("target_loss").isNotNull()
    default = lambda k: F.lit(CONFIG_DEFAULTS[k])

    values = {k: F.lit(v) for k, v in CONFIG_DEFAULTS.items()}
    values.update(
        model_name_or_path=c("model"),
        template=c("template"),
        dataset=c("dataset"),
        dataset_dir=F.lit(data_dir),
        output_dir=naming.adapter_dir(c("run")),
        bf16=F.coalesce("bf16", F.lit("false")),
        fp16=c("fp16"),
        preprocessing_num_workers=c("workers"),
        dataloader_pin_memory=c("pin_memory"),
        finetuning_type=c("method"),
        num_train_epochs=F.coalesce("param_epochs", "epochs"),
        learning_rate=F.coalesce("learning_rate", default("learning_rate")),
        per_device_train_batch_size=F.coalesce("batch_size", default("per_device_train_batch_size")),
        gradient_accumulation_steps=F.coalesce("grad_accum", default("gradient_accumulation_steps")),
        cutoff_len=F.coalesce("cutoff_len", default("cutoff_len")),
        warmup_ratio=F.coalesce("warmup_ratio", default("warmup_ratio")),
        lora_rank=F.when(lora, F.coalesce("lora_rank", F.lit(LORA_DEFAULTS["lora_rank"]))),
        lora_dropout=F.when(lora, F.coalesce("lora_dropout", F.lit(LORA_DEFAULTS["lora_dropout"]))),
        lora_alpha=F.when(lora & (c("lora_alpha").try_cast("double") > 0), c("lora_alpha")),
        lora_target=F.when(lora, F.lit(LORA_DEFAULTS["lora_target"])),
    )
    if "seed" in sweep.columns:  # the seed that the run's manifest names
        values["seed"] = c("seed")
    for key, value in TARGET_LOSS_STEPS.items():
        values[key] = F.when(targeted, F.lit(value)).otherwise(values[key])

    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return sweep.select("run", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def wide_configs(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One row per run with the given keys as columns."""
    return entries.groupBy("run").pivot("key", keys).agg(F.first("value", ignorenulls=True))


def fix_output_dir(entries: DataFrame) -> DataFrame:
    """`output_dir` always follows the run name."""
    value = F.when(F.col("key") == "output_dir", naming.adapter_dir(F.col("run"))).otherwise(F.col("value"))
    return entries.withColumn("value", value)


def patch(entries: DataFrame, safe: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Set the given keys in every run: (patched entries, (run, changed))."""
    runs = entries.select("run").distinct()
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("safe")) for k, v in safe.items()])
    wanted = runs.select("run", F.inline(pairs))
    kept = entries.filter(~F.col("key").isin(*safe))
    patched = kept.select("run", "key", "value").unionByName(
        wanted.select("run", "key", F.col("safe").alias("value"))
    )
    same = F.lit(0)
    for key, value in safe.items():
        hit = (F.col("key") == key) & F.col("value").eqNullSafe(F.lit(value))
        same = same + F.when(hit, 1).otherwise(0)
    changed = entries.groupBy("run").agg((F.sum(same) < len(safe)).alias("changed"))
    return patched, changed


def diff(left: DataFrame, right: DataFrame, keys=("key",)) -> DataFrame:
    """Keys whose value differs between two configs (or two sets of paired configs)."""
    a = left.select(*keys, F.col("value").alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col("value").alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    differs = ~F.col("left_value").eqNullSafe(F.col("right_value")) | F.col("_l").isNull() | F.col("_r").isNull()
    return both.filter(differs).drop("_l", "_r")


# --- manifests --------------------------------------------------------------
MANIFEST_FIELDS = [
    "tool_version", "trainer_version", "python_version", "platform", "git_commit",
    "timestamp", "command",
]


def manifests(runs: DataFrame, args: list[str]) -> DataFrame:
    """(run, key, value) manifest rows; a missing seed is drawn from the run name.

    `args` are the columns recorded as command arguments, NULL ones left out.
    """
    drawn = F.pmod(F.xxhash64("run"), F.lit(2**32))
    seed = F.coalesce(F.col("seed").cast("bigint"), drawn).cast("string")
    pairs = [(k, F.col(k).cast("string")) for k in MANIFEST_FIELDS]
    pairs += [(f"cli_args.{a}", F.col(a).cast("string")) for a in args]
    pairs.append(("random_seed", seed))
    items = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return runs.select("run", F.inline(F.filter(items, lambda p: p["value"].isNotNull())))


# --- history ----------------------------------------------------------------
def history_records(finished: DataFrame) -> DataFrame:
    """The ten history fields of the successful runs.

    `finished` has seq, run, model, dataset, stage, epochs, template, success, finished_at.
    """
    run = F.col("run")
    return finished.filter(F.col("success")).select(
        "seq",
        run.alias("name"),
        run.alias("output_name"),
        "model",
        naming.adapter_dir(run).alias("adapter"),
        "template",
        "dataset",
        "stage",
        "epochs",
        naming.config_path(run).alias("config"),
        F.date_format("finished_at", "yyyy-MM-dd HH:mm").alias("timestamp"),
    )


def append_history(history: DataFrame, finished: DataFrame) -> DataFrame:
    return history.unionByName(history_records(finished))


def parsed_times(history: DataFrame) -> DataFrame:
    """Add the local history time as a timestamp without zone."""
    return history.withColumn(
        "recorded_at", F.expr("try_to_timestamp(timestamp, 'yyyy-MM-dd HH:mm')").cast("timestamp_ntz")
    )


def list_history(history: DataFrame) -> DataFrame:
    """Numbered listing in append order, `?` for absent values."""
    shown = ["output_name", "model", "dataset", "stage", "epochs"]
    rows = history.select("seq", *[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in shown])
    return ordered.numbered(rows, ["seq"]).select("number", *shown)


def latest_run(history: DataFrame, keys=()) -> DataFrame:
    """The last appended record, overall or per key."""
    last = F.max_by(F.struct(*history.columns), "seq").alias("h")
    grouped = history.groupBy(*keys).agg(last) if keys else history.agg(last)
    return grouped.select("h.*")


def without_runs(history: DataFrame, names: DataFrame) -> DataFrame:
    """History without the named runs; rows without a name stay."""
    return history.join(names.select("name").distinct(), "name", "left_anti").select(*history.columns)


def reset_history(history: DataFrame, names: DataFrame) -> DataFrame:
    """The history without the records of the given names."""
    return without_runs(history, names)


def reconcile(history: DataFrame, found: DataFrame) -> DataFrame:
    """(adapter, name, status): runs whose adapter is gone, adapters no run recorded.

    History may hold many runs of one adapter; it is the streamed side of both joins.
    """
    present = found.select(F.col("path").alias("adapter")).distinct().withColumn("_there", F.lit(True))
    runs = history.select("adapter", "name").join(present, "adapter", "left").select(
        "adapter",
        "name",
        F.when(F.col("_there"), "ok").otherwise("missing adapter").alias("status"),
    )
    recorded = history.select("adapter").distinct()
    orphans = present.join(recorded, "adapter", "left_anti").select(
        "adapter", F.lit(None).cast("string").alias("name"), F.lit("no history").alias("status")
    )
    return runs.unionByName(orphans)


def run_summary(history: DataFrame, counted: DataFrame, outcome: DataFrame) -> DataFrame:
    """One row per recorded run: what was trained and how the loss went."""
    return (
        history.select(F.col("name").alias("run"), "model", "dataset")
        .join(counted, "run", "left")
        .join(
            outcome.select(
                "run", "first_loss", "last_loss", "best_loss", "best_step", "target_hit", "early_stopped"
            ),
            "run",
            "left",
        )
    )


# --- state ------------------------------------------------------------------
def merge_state(stored: DataFrame) -> DataFrame:
    """Stored fields over the defaults, per user."""
    return stored.select(
        *[c for c in stored.columns if c not in STATE_DEFAULTS],
        *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in STATE_DEFAULTS.items()],
    )


def reset_state(stored: DataFrame, users: DataFrame) -> DataFrame:
    """The given users' states back to the defaults; the others' over the defaults as stored."""
    chosen = users.select("user_id").distinct().withColumn("_reset", F.lit(True))
    rows = stored.join(chosen, "user_id", "left")
    return rows.select(
        *[c for c in stored.columns if c not in STATE_DEFAULTS],
        *[
            F.when(F.col("_reset").isNull(), F.coalesce(F.col(k), F.lit(v))).otherwise(F.lit(v)).alias(k)
            for k, v in STATE_DEFAULTS.items()
        ],
    )


def state_after(history: DataFrame) -> DataFrame:
    """Active model, dataset, template and adapter after a training: the first named dataset counts."""
    first = strip_space(F.get(F.split("dataset", ","), F.lit(0)))
    return history.select(
        "name",
        F.col("model").alias("active_model"),
        F.coalesce(first, F.lit("")).alias("active_dataset"),
        F.col("template").alias("active_template"),
        F.col("adapter").alias("active_adapter"),
    )


from datetime import datetime

from pyspark.sql import functions as F

from tests.conftest import rows
from tunelake.operators import runs
from tunelake.sources import configs

SWEEP = (
    "run string, model string, template string, dataset string, epochs string, method string, lora_rank string, lora_dropout string, lora_alpha string, "
    "learning_rate string, param_epochs string, batch_size string, grad_accum string, cutoff_len string, warmup_ratio string, target_loss string, "
    "bf16 string, fp16 string, workers string, pin_memory string"
)


def sweep(spark, *changes):
    base = dict.fromkeys([c.split()[0] for c in SWEEP.split(", ")])
    base.update(model="m", template="qwen3", dataset="d", epochs="3.0", method="lora", bf16="false", workers="8", pin_memory="true")
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in changes], SWEEP)


def built(spark, **change):
    entries = runs.build_configs(sweep(spark, {"run": "r", **change}))
    return {r["key"]: r["value"] for r in entries.collect()}


def test_build_configs(spark):
    plain = built(spark)
    assert plain["lora_rank"] == "8" and plain["lora_dropout"] == "0.05" and plain["lora_target"] == "all" and "lora_alpha" not in plain
    assert plain["output_dir"] == "saves/r/lora" and plain["save_steps"] == "100" and plain["num_train_epochs"] == "3.0" and plain["bf16"] == "false"
    assert not [k for k in built(spark, method="freeze", lora_rank="4", lora_alpha="2") if k.startswith("lora_")]
    tuned = built(spark, lora_rank="16", lora_dropout="0.1", lora_alpha="32", learning_rate="5e-5", batch_size="1", grad_accum="16", cutoff_len="1024", param_epochs="1.0", target_loss="0.5")
    want = dict(lora_rank="16", lora_dropout="0.1", lora_alpha="32", learning_rate="5e-5", per_device_train_batch_size="1",
                gradient_accumulation_steps="16", cutoff_len="1024", num_train_epochs="1.0", save_steps="1", logging_steps="1")
    assert {k: tuned[k] for k in want} == want
    assert "lora_alpha" not in built(spark, lora_alpha="0")


def test_build_configs_needs_no_shuffle(spark):
    plan = runs.build_configs(sweep(spark, {"run": "r"}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_overlay_patch_diff(spark):
    make = lambda data: spark.createDataFrame(data, "run string, key string, value string")
    low, high = make([("r", "a", "1"), ("r", "b", "2")]), make([("r", "b", None), ("r", "c", "3")])
    assert rows(runs.overlay(low, high)) == [("r", "a", "1"), ("r", "b", None), ("r", "c", "3")]
    entries = make([("x", "w", "8"), ("x", "k", "v"), ("y", "w", "0")])
    patched, changed = runs.patch(entries, {"w": "8"})
    assert rows(patched) == [("x", "k", "v"), ("x", "w", "8"), ("y", "w", "8")]
    assert rows(changed) == [("x", False), ("y", True)]
    left, right = make([("x", "a", "1"), ("x", "b", None), ("x", "c", "3")]), make([("y", "a", "2"), ("y", "b", None), ("y", "d", "4")])
    assert rows(runs.diff(left, right)) == [("a", "1", "2"), ("c", "3", None), ("d", None, "4")]


DOC = """# run manifest
# ---------------------------------
#   command: train
#   cli_args.model: org/a: b
#   random_seed: 42
bf16: true
dataset: 'it''s'
quoted: "x y"
empty:
nothing: null
note: a: b
output_dir: saves/other/lora
"""


def test_config_documents(spark, tmp_path):
    (tmp_path / "run_1.yaml").write_text(DOC)
    (tmp_path / "run_1_summary.yaml").write_text("name: run_1\nepochs: 3.0\nmodel: m\ntimestamp: 2026-01-02 03:04\n")
    docs = configs.read_configs(spark, str(tmp_path))
    got = {r["key"]: r["value"] for r in configs.config_entries(docs).collect()}
    assert got == {"bf16": "true", "dataset": "it's", "quoted": "x y", "empty": None, "nothing": None, "note": "a: b", "output_dir": "saves/other/lora"}
    manifest = {r["key"]: r["value"] for r in configs.manifest_entries(docs).collect()}
    assert manifest == {"command": "train", "cli_args.model": "org/a: b", "random_seed": "42"}
    fixed = runs.fix_output_dir(configs.config_entries(docs)).filter("key = 'output_dir'")
    assert rows(fixed, "value") == [("saves/run_1/lora",)]
    summary = configs.history_rows(configs.read_summaries(spark, str(tmp_path))).first()
    assert (summary["name"], summary["epochs"], summary["model"], summary["stage"]) == ("run_1", 3.0, "m", None)


def test_manifest_round_trip(spark):
    items = F.array(F.struct(F.lit("command").alias("key"), F.lit("train").alias("value")), F.struct(F.lit("cli_args.x").alias("key"), F.lit("1").alias("value")))
    docs = spark.range(1).select(F.lit("r").alias("run"), configs.manifest_header(items, "manifest").alias("content"))
    assert rows(configs.manifest_entries(docs)) == [("r", "cli_args.x", "1"), ("r", "command", "train")]
    assert configs.config_entries(docs).count() == 0


def test_manifest_seed(spark):
    df = spark.createDataFrame([("a", "7", "m"), ("b", None, None)], "run string, seed string, model string")
    for c in runs.MANIFEST_FIELDS:
        df = df.withColumn(c, F.lit("train") if c == "command" else F.lit(None).cast("string"))
    got = runs.manifests(df, ["model"])
    seeds = {r["run"]: int(r["value"]) for r in got.filter("key = 'random_seed'").collect()}
    assert seeds["a"] == 7 and 0 <= seeds["b"] < 2**32
    assert rows(got.filter("key like 'cli%'")) == [("a", "cli_args.model", "m")]


FINISHED = "seq bigint, run string, model string, dataset string, stage string, epochs double, template string, success boolean, finished_at timestamp_ntz"


def test_history(spark):
    at = datetime(2026, 1, 2, 3, 4, 5)
    df = spark.createDataFrame(
        [(1, "r1", "m", " d1 , d2", "sft", 3.0, "qwen3", True, at), (2, "r2", "m", "d", None, None, None, True, at), (3, "r3", "m", "d", "sft", 1.0, "t", False, at)], FINISHED
    )
    history = runs.history_records(df)
    first = history.filter("seq = 1").first()
    assert (first["adapter"], first["config"], first["timestamp"]) == ("saves/r1/lora", "configs/r1.yaml", "2026-01-02 03:04")
    assert runs.parsed_times(history).filter("seq = 1").first()["recorded_at"] == datetime(2026, 1, 2, 3, 4)
    assert rows(runs.list_history(history)) == [(1, "r1", "m", " d1 , d2", "sft", "3.0"), (2, "r2", "m", "d", "?", "?")]
    assert runs.latest_run(history).first()["name"] == "r2"
    names = spark.createDataFrame([("r1",)], "name string")
    nameless = history.withColumn("name", F.when(F.col("seq") == 1, F.col("name")))
    assert rows(runs.without_runs(nameless, names), "seq") == [(2,)]
    assert rows(runs.reset_history(history, names), "seq") == [(2,)]
    assert runs.state_after(history).filter("name = 'r1'").first()["active_dataset"] == "d1"
    more = runs.append_history(history, df.withColumn("seq", F.col("seq") + 10).filter("run = 'r1'"))
    assert rows(more, "seq") == [(1,), (11,), (2,)]


def test_reconcile(spark):
    history = spark.createDataFrame([("saves/a/lora", "a"), ("saves/a/lora", "a2"), ("saves/b/lora", "b")], "adapter string, name string")
    found = spark.createDataFrame([("saves/a/lora",), ("saves/z/lora",)], "path string")
    assert rows(runs.reconcile(history, found)) == [
        ("saves/a/lora", "a", "ok"), ("saves/a/lora", "a2", "ok"), ("saves/b/lora", "b", "missing adapter"), ("saves/z/lora", None, "no history")
    ]


def test_state(spark):
    fields = "user_id int, active_model string, active_adapter string, active_template string, active_dataset string, theme string, training_history string"
    df = spark.createDataFrame([(1, "m", None, None, None, "light", None), (2, "n", None, "t", None, None, '["r"]')], fields)
    two = (2, "n", "", "t", "", "dark", '["r"]')
    assert rows(runs.merge_state(df)) == [(1, "m", "", "qwen3", "", "light", "[]"), two]
    assert rows(runs.reset_state(df, df.filter("user_id = 1"))) == [(1, "", "", "qwen3", "", "dark", "[]"), two]

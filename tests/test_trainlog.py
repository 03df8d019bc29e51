import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tunelake.functions import logline
from tunelake.operators import ordered, trainlog
from tunelake.sources import logs

NAN = float("nan")
LINES = [
    ("{'loss': '3.35', 'grad_norm': '4.318', 'learning_rate': '9.619e-05', 'epoch': '0.87'}", (3.35, 4.318, 9.619e-05, 0.87)),
    ("{'loss': 2.41, 'total_flos': 12, 'epoch': 1.0}", (2.41, None, None, 1.0)),
    ("INFO {'loss': '1.5'} done", (1.5, None, None, None)),
    ("{'loss': 2.1234}", (2.1234, None, None, None)),
    ("{'loss' : 'nan', 'epoch': 1}", (NAN, None, None, 1.0)),
    ("{'loss': None, 'epoch': 2}", (None, None, None, 2.0)),
    ("{'loss': True}", (1.0, None, None, None)),
    ("{'loss': nan, 'epoch': 1}", None),
    ("{'loss': '1.0d'}", (None, None, None, None)),
    ("{bad group} {'loss': 0.5}", (0.5, None, None, None)),
    ("{'other': 1} {'loss': 0.5}", (None, None, None, None)),
    ("{'eval_loss': 0.5}", None),
    ("{'train_loss': 0.5}", None),
    ("the loss is 3", None),
    ('{"loss": 1.0}', None),
    ("'loss': 0.5 without braces", None),
    ("{'loss': 1e-3,}", (0.001, None, None, None)),
    ("{'loss': null}", None),
]


@pytest.mark.parametrize("line,want", LINES)
def test_parse_metrics(spark, line, want):
    got = spark.createDataFrame([(line,)], "line string").select(logline.parse_metrics(F.col("line")).alias("m")).first()["m"]
    same = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))
    assert (got is None) == (want is None)
    assert want is None or all(same(a, b) for a, b in zip(got, want))


def test_small_extracts(spark):
    df = spark.createDataFrame(
        [("  Total optimization steps = 1,234",), ("Total optimization steps=77",), ("steps = 5",)], "line string"
    )
    got = [r[0] for r in df.select(logline.total_steps(F.col("line"))).collect()]
    assert got == [1, 77, None]
    df = spark.createDataFrame([("a/checkpoint-12",), ("checkpoint-9/lora",), ("x/old-checkpoint-3-b",)], "path string")
    assert [r[0] for r in df.select(logline.checkpoint_step(F.col("path"))).collect()] == [12, None, 3]
    df = spark.createDataFrame(
        [(0.12, 0.1, True), (0.1201, 0.1, False), (10.5, 10.0, True), (10.51, 10.0, False), (None, 1.0, False), (NAN, 1.0, False)],
        "loss double, target double, want boolean",
    )
    wrong = df.filter(logline.within_target(F.col("loss"), F.col("target")) != F.col("want"))
    assert rows(wrong) == []


def model(lines, target, limit):
    """Plain loop over (loss or None for an unreadable metrics line)."""
    step, best, best_step, hit_seen, patience, stop, trace = 0, None, None, False, 0, None, []
    for loss in lines:
        step += 1
        if loss is None:
            continue
        hit = not math.isnan(loss) and loss <= target + max(0.02, abs(target) * 0.05)
        if hit:
            if stop is None and (best is None or loss < best):
                best, best_step = loss, step
            patience, hit_seen = 0, True
        elif hit_seen:
            patience += 1
        if stop is None and hit_seen and patience > limit:
            stop = step
        trace.append((step, hit, hit_seen, patience))
    live_hit = best is not None
    return best, best_step, live_hit, stop, trace


def series(rng, n):
    kinds = [None, NAN, 0.05, 0.1, 0.12, 0.11, 5.0, 3.0, 2.0]
    return [rng.choice(kinds) for _ in range(n)]


def log_frame(spark, runs, block):
    data = []
    for run, losses in runs.items():
        at = 0
        for loss in losses:
            at += 1
            data.append((run, at, "prose"))
            at += 1
            text = "None" if loss is None else "'nan'" if math.isnan(loss) else str(loss)
            data.append((run, at, "{'loss': %s, 'epoch': %d}" % (text, at)))
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "run string, line_no bigint, line string")
    return df.withColumn("block", ordered.block_of("line_no", block))


@pytest.mark.parametrize("block", [3, 16, 1 << 20])
def test_monitor_against_plain_loop(spark, block):
    rng = random.Random(block)
    runs = {f"r{i}": series(rng, rng.randint(1, 40)) for i in range(60)}
    runs["exactly"] = [0.1] + [5.0] * 4
    runs["never"] = [5.0] * 12
    limit = 3
    judged = trainlog.monitor(log_frame(spark, runs, block), 0.1, limit)
    trace = {}
    for r in judged.orderBy("run", "line_no").collect():
        trace.setdefault(r["run"], []).append((r["step"], r["hit"], r["target_hit"], r["patience"]))
    outcome = {r["run"]: r for r in trainlog.outcomes(judged).collect()}
    stops = {r["run"]: r["stop_step"] for r in trainlog.stop_points(judged).collect()}
    for run, losses in runs.items():
        best, best_step, hit, stop, want = model(losses, 0.1, limit)
        assert trace.get(run, []) == want
        if want:
            o = outcome[run]
            assert (o["best_loss"], o["best_step"], o["target_hit"], o["stop_step"]) == (best, best_step, hit, stop)
            assert stops[run] == stop and o["early_stopped"] == (stop is not None)


def test_patience_limit_is_strict(spark):
    runs = {"thirty": [0.1] + [5.0] * 30, "thirty_one": [0.1] + [5.0] * 31}
    got = rows(trainlog.stop_points(trainlog.monitor(log_frame(spark, runs, 7), 0.1)))
    assert got == [("thirty", None), ("thirty_one", 32)]


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_counters_and_latest(spark, block):
    rng = random.Random(5)
    runs = {f"r{i}": series(rng, rng.randint(1, 30)) for i in range(20)}
    lines = log_frame(spark, runs, block)
    assert rows(trainlog.counters(lines), "run", "steps") == sorted((k, len(v)) for k, v in runs.items())
    latest = {r["run"]: r["epoch"] for r in trainlog.latest_metrics(lines).collect()}
    assert latest == {k: 2.0 * len(v) for k, v in runs.items()}
    steps = trainlog.running_steps(lines)
    assert rows(steps.groupBy("run").agg(F.max("step"))) == sorted((k, len(v)) for k, v in runs.items())
    run = trainlog.running_latest(lines)
    assert run.filter(F.col("epoch") != F.col("line_no")).count() == 0


def test_run_results_and_checkpoints(spark):
    runs = {"a": [5.0, 0.1, 0.05, 5.0], "b": [0.1] + [5.0] * 5, "c": [5.0]}
    outcome = trainlog.outcomes(trainlog.monitor(log_frame(spark, runs, 3), 0.1, 3))
    exits = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", None)], "run string, exit_code int")
    got = {r["run"]: (r["success"], r["target_not_reached"]) for r in trainlog.run_results(outcome, exits).collect()}
    assert got == {"a": (True, False), "b": (True, False), "c": (False, True), "d": (False, True)}
    paths = spark.createDataFrame(
        [("a", "s/a/checkpoint-2"), ("a", "s/a/checkpoint-4"), ("b", "s/b/checkpoint-5"), ("b", "s/b/checkpoint-8"), ("c", "s/c/checkpoint-1")],
        "run string, path string",
    )
    best = trainlog.best_checkpoints(outcome, trainlog.checkpoints(paths))
    assert rows(best) == [("a", 3, 2), ("b", 1, 5)]


def test_tail(spark):
    df = spark.createDataFrame([("r", i, f"Epoch {i}") for i in range(10)] + [("s", 0, "x")], "run string, line_no bigint, line string")
    got = trainlog.tail(df.withColumn("block", ordered.block_of("line_no", 4)), 5)
    assert [r["line"] for r in got.collect()] == [f"Epoch {i}" for i in range(5, 10)] + ["x"]
    many = [("r", i, f"Epoch {i}") for i in range(2500)]
    big = spark.createDataFrame(many, "run string, line_no bigint, line string").withColumn("block", ordered.block_of("line_no", 300))
    assert [r["line_no"] for r in trainlog.tail(big, 1200).collect()] == list(range(1300, 2500))


def test_read_logs_over_many_splits(spark, tmp_path):
    for run, n in (("big", 3000), ("small", 3)):
        (tmp_path / run).mkdir()
        body = "".join(f"line {i}  \t\n" if i % 10 else "\n" for i in range(n))
        (tmp_path / run / "train.log").write_bytes(body.encode() + b"bad \xff byte\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = logs.read_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for run, n in (("big", 3000), ("small", 3)):
        mine = {r["line_no"]: r["line"] for r in got if r["run"] == run}
        assert mine == {**{i: f"line {i}" for i in range(n) if i % 10}, n: "bad � byte"}


@pytest.mark.parametrize(
    "loss, want",
    [(".5", 0.5), ("1.", 1.0), ("+1.5", 1.5), ("1_000.0", 1000.0), ("-.25", -0.25), ("2.0, 'lr': (1,2)", 2.0), ("1_000_000", 1e6),
     ("1.e2", 100.0), ("'+1.5'", 1.5), ("007", None), ("nan", None)],
)
def test_number_forms(spark, loss, want):
    line = spark.createDataFrame([(f"{{'loss': {loss}, 'epoch': 1}}",)], "line string")
    assert line.select(logline.parse_metrics(F.col("line"))["loss"]).first()[0] == want

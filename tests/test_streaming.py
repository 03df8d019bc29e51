import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_chat import machine, random_text
from tests.test_trainlog import model, series
from tunelake.operators import ordered
from tunelake.plans import live_queries
from tunelake.plans.live_queries import ROCKSDB, drain, newest
from tunelake.plans.session import conf
from tunelake.streaming import discovery, logs, reasoning


def write_batches(folder, batches):
    folder.mkdir()
    start = time.time() - 1000
    for i, batch in enumerate(batches):
        path = folder / f"{i:03d}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in batch))
        os.utime(path, (start + i, start + i))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def log_rows(runs):
    out = []
    for run, losses in runs.items():
        for i, loss in enumerate(losses):
            text = "None" if loss is None else "'nan'" if loss != loss else str(loss)
            out.append({"run": run, "line_no": i, "line": "{'loss': %s, 'epoch': %d}" % (text, i)})
    return out


def test_monitor_over_shuffled_batches(spark, tmp_path):
    """Lines arrive in any order over several micro-batches; the result is that of the log."""
    rng = random.Random(4)
    runs = {f"r{i}": series(rng, rng.randint(5, 30)) for i in range(12)}
    data = log_rows(runs)
    rng.shuffle(data)
    write_batches(tmp_path / "in", [data[i::3] for i in range(3)])
    lines = stream(spark, tmp_path / "in", "run string, line_no bigint, line string")
    with conf(spark, **ROCKSDB):
        got = newest(drain(logs.monitor_stream(lines, 0.1, 3), spark, "update"), ["run"]).collect()
    assert len(got) == len(runs)
    for r in got:
        best, best_step, hit, stop, _ = model(runs[r["run"]], 0.1, 3)
        assert (r["target_hit"], r["stop_step"], r["early_stopped"]) == (hit, stop, stop is not None)
        assert r["late_lines"] == 0
        assert (r["best_loss"], r["best_step"]) == (best, best_step)


def test_latest_over_batches(spark, tmp_path):
    data = log_rows({"a": [1.0, 0.5, None], "b": [2.0]})
    write_batches(tmp_path / "in", [data[:2], data[2:]])
    lines = stream(spark, tmp_path / "in", "run string, line_no bigint, line string")
    lines = lines.withColumn("block", ordered.block_of("line_no"))
    got = newest(drain(logs.latest_stream(lines), spark, "update"), ["run"])
    assert {r["run"]: (r["loss"], r["epoch"]) for r in got.collect()} == {"a": (None, 2.0), "b": (2.0, 0.0)}
    assert drain(logs.metrics_stream(lines), spark).count() == 4


def test_reasoning_over_shuffled_batches(spark, tmp_path):
    rng = random.Random(8)
    data, want = [], {}
    for conv in range(40):
        text = random_text(rng) or "x"
        cuts = [text[i : i + 3] for i in range(0, len(text), 3)]
        data += [{"conv_id": conv, "turn": 0, "seq": i, "token": t, "last": i == len(cuts) - 1} for i, t in enumerate(cuts)]
        want[conv] = machine(text)
    rng.shuffle(data)
    write_batches(tmp_path / "in", [data[i::3] for i in range(3)])
    tokens = stream(spark, tmp_path / "in", "conv_id bigint, turn bigint, seq bigint, token string, last boolean")
    with conf(spark, **ROCKSDB):
        rows = drain(reasoning.visible_stream(tokens), spark).orderBy("conv_id", "part").collect()
    got = dict.fromkeys(want, "")
    for r in rows:
        got[r["conv_id"]] += r["text"]
    assert got == want


@pytest.mark.parametrize("whole", [False, True])
def test_discovery(spark, tmp_path, whole):
    folder, out = tmp_path / "data", str(tmp_path / "out")
    folder.mkdir()
    end = "json" if whole else "jsonl"

    def put(name, record, n):
        body = json.dumps([record] * n) if whole else (json.dumps(record) + "\n") * n
        (folder / f"{name}.{end}").write_text(body)

    def run():
        make = discovery.new_documents if whole else discovery.new_lines
        writer = discovery.catalogue_writer(make(spark, str(folder)), out, str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
        found = spark.read.parquet(out)
        return sorted((r["name"], r["format"], r["examples"]) for r in found.collect())

    put("a", {"instruction": "q", "output": "a"}, 2)
    put("b", {"odd": 1}, 3)
    assert run() == [("a", "alpaca", 2), ("b", None, 3)]
    put("c", {"messages": []}, 4)
    assert run() == [("a", "alpaca", 2), ("b", None, 3), ("c", "sharegpt", 4)]


@pytest.mark.parametrize("cell", [1, 4, 16])
def test_monitor_of_one_hot_run(spark, tmp_path, cell):
    """One run holds most lines; batches overlap and come out of order; cells are whole, partial or repeated."""
    rng = random.Random(cell)
    runs = {"hot": series(rng, 400), "cold": series(rng, 9)}
    data = log_rows(runs)
    cuts = [data[150:330], data[:100] + data[140:200], data[90:160] + data[320:]]
    write_batches(tmp_path / "in", cuts)
    lines = stream(spark, tmp_path / "in", "run string, line_no bigint, line string")
    for limit in (0, 3):
        with conf(spark, **ROCKSDB):
            got = newest(drain(logs.monitor_stream(lines, 0.1, limit, cell=cell), spark, "update"), ["run"]).collect()
        for r in got:
            best, best_step, hit, stop, _ = model(runs[r["run"]], 0.1, limit)
            assert (r["target_hit"], r["stop_step"], r["best_loss"], r["best_step"]) == (hit, stop, best, best_step)
            assert r["line_no"] == len(runs[r["run"]]) - 1
    assert len(got) == 2


def test_summaries_compose():
    rng = random.Random(11)
    for _ in range(300):
        n, limit = rng.randint(0, 40), rng.randint(0, 4)
        lines = np.zeros(n, logs.LINE)
        lines["at"] = np.arange(n)
        lines["kind"] = [rng.choice([0, 1, 3, 3, 3, 7, 7, 8]) for _ in range(n)]
        lines["loss"] = [rng.choice([0.1, 0.2, 0.3]) for _ in range(n)]
        lines["total"] = [rng.randint(1, 9) for _ in range(n)]
        whole = logs.advance(logs.Monitor(), logs.summarise(lines, limit), limit)
        parts, start = logs.Monitor(), 0
        while start < n:
            end = rng.randint(start + 1, n)
            parts = logs.advance(parts, logs.summarise(lines[start:end], limit), limit)
            start = end
        single = logs.Monitor()
        for i in range(n):
            single = logs.advance(single, logs.summarise(lines[i : i + 1], limit), limit)
        assert whole == parts == single


def progress_rows(query):
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


def test_state_of_idle_runs_and_ended_answers_goes(spark, tmp_path):
    data = log_rows({f"r{i}": [0.5, 0.4] for i in range(8)})
    write_batches(tmp_path / "in", [data])
    lines = stream(spark, tmp_path / "in", "run string, line_no bigint, line string")
    tokens = [{"conv_id": i, "turn": 0, "seq": j, "token": "a", "last": j == 2} for i in range(6) for j in range(3)]
    write_batches(tmp_path / "tokens", [tokens])
    arriving = stream(spark, tmp_path / "tokens", "conv_id bigint, turn bigint, seq bigint, token string, last boolean")
    with conf(spark, **ROCKSDB):
        for name, made, folder, late in (
            ("runs", logs.monitor_stream(lines, 0.1, 3, idle_ms=1), "in", log_rows({"new": [0.5]})),
            ("answers", reasoning.visible_stream(arriving, forget_ms=1, idle_ms=1), "tokens", [{"conv_id": 99, "turn": 0, "seq": 0, "token": "b", "last": False}]),
        ):
            out = made.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("update" if name == "runs" else "append")
            keep = lambda batch, _: batch.collect()
            query = out.foreachBatch(keep).trigger(availableNow=True).start()
            query.awaitTermination(120)
            first = progress_rows(query)
            (tmp_path / folder / "900.json").write_text("".join(json.dumps(r) + "\n" for r in late))
            again = out.foreachBatch(keep).trigger(availableNow=True).start()
            again.awaitTermination(120)
            assert first >= 6 and progress_rows(again) <= 3, name


def test_reasoning_with_repeats_and_overlaps(spark, tmp_path):
    rng = random.Random(9)
    batches, want = [[], [], [], []], {}
    for conv in range(25):
        text = random_text(rng) or "x"
        cuts = [text[i : i + 2] for i in range(0, len(text), 2)]
        rows = [{"conv_id": conv, "turn": 1, "seq": i, "token": t, "last": i == len(cuts) - 1} for i, t in enumerate(cuts)]
        want[conv] = machine(text)
        for batch in batches[:-1]:
            a, b = sorted((rng.randint(0, len(rows)), rng.randint(0, len(rows))))
            batch += rows[a:b]
        batches[-1] += rows
    write_batches(tmp_path / "in", batches)
    tokens = stream(spark, tmp_path / "in", "conv_id bigint, turn bigint, seq bigint, token string, last boolean")
    with conf(spark, **ROCKSDB):
        rows = drain(reasoning.visible_stream(tokens), spark).orderBy("conv_id", "part").collect()
    got = dict.fromkeys(want, "")
    for r in rows:
        got[r["conv_id"]] += r["text"]
    assert got == want


def test_discovery_takes_no_more_batches_for_more_files(spark, tmp_path, monkeypatch):
    docs = [(i, f"text {i}", f"src{i % 2}") for i in range(48)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(live_queries, "FILE_ROWS", 1)
    monkeypatch.setattr(live_queries, "scratch", lambda _, name: str(tmp_path / name))
    found = live_queries.live_discovery(spark, str(tmp_path)).select("part", "examples").collect()
    assert sorted(map(tuple, found)) == sorted((f"{source}-{i}", 1) for i, _, source in docs)
    assert 1 < len(list((tmp_path / "found").glob("batch=*"))) <= live_queries.BATCHES


def test_monitor_query_parses_with_all_cores(spark, tmp_path, monkeypatch):
    """Every batch brings a file for each core, and a line is parsed once."""
    kinds = ["click", "signup", "view", "error", "purchase"]
    events = [(i, i % 3, kinds[i % 5], float(i % 200)) for i in range(400)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    monkeypatch.setattr(live_queries, "scratch", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(logs, "cells", lambda lines, *a, make=logs.cells: seen.append(lines) or make(lines, *a))
    assert live_queries.live_monitor(spark, str(tmp_path)).count() == 3
    cores = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "live-lines").glob("part-*"))) == 4 * cores
    lines = spark.createDataFrame([("r", 0, "{'loss': 0.5}")], "run string, line_no long, line string").repartition(1)
    logs.monitor_stream(lines, 0.1)
    assert seen[-1]._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1

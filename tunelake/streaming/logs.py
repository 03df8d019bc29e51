"""Live training logs.

Streams are rows (run, block, line_no, line). Parsing is stateless and the newest metrics are
a built-in aggregate, so the batch operators serve as they are; only the target-loss monitor
depends on line order and keeps state of its own. Its lines are cut into cells of neighbouring
line numbers, and whole cells are summarised by all tasks before they reach the state: what a
stretch of lines does to the monitor takes a few numbers, whatever state it starts from.
"""

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import logline
from ..functions.constants import PATIENCE_LIMIT
from ..operators import trainlog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Lines of a cell, and lines that a task holds while it sorts them into cells.
CELL = 1024
BUFFER = 200_000
#: Cells of a run that its state holds in memory at once.
HELD = 256
#: A fitting `idle_ms` of the monitor: a week.
IDLE_MS = 7 * 24 * 3600 * 1000

STATE = (
    "cell bigint, last_line bigint, steps bigint, total_steps bigint, best_loss double, "
    "best_step bigint, patience bigint, target_hit boolean, stop_step bigint, late_lines bigint"
)
PENDING = "whole boolean, content binary"
CELLS = "run string, cell bigint, n bigint, whole boolean, content binary"
OUTPUT = (
    "run string, line_no bigint, steps bigint, total_steps bigint, best_loss double, "
    "best_step bigint, patience bigint, target_hit boolean, early_stopped boolean, "
    "stop_step bigint, late_lines bigint"
)
#: A line without its text; `kind` adds up 1 for metrics, 2 for a loss, 4 for a hit, 8 for a total.
LINE = np.dtype([("at", "<i8"), ("kind", "u1"), ("loss", "<f8"), ("total", "<i8")])


def metrics_stream(lines: DataFrame) -> DataFrame:
    """Metrics rows of a log stream (append mode)."""
    return trainlog.metric_rows(lines)


def latest_stream(lines: DataFrame) -> DataFrame:
    """Newest metrics per run (update or complete mode)."""
    return trainlog.latest_metrics(lines)


@dataclass(frozen=True)
class Monitor:
    """State of the target-loss monitor after some lines."""

    steps: int = 0
    total_steps: int | None = None
    best_loss: float | None = None
    best_step: int | None = None
    patience: int = 0
    target_hit: bool = False
    stop_step: int | None = None


def summarise(lines: np.ndarray, limit: int) -> dict:
    """What a stretch of lines, in order, does to the monitor, whatever its state before.

    Before the first hit only misses count, and only if there was a hit earlier: the first
    limit + 1 of them are kept with their steps, one of which may be the stop. From the first
    hit on, nothing depends on what was before.
    """
    kind = lines["kind"]
    step = np.cumsum(kind & 1)
    seen = np.maximum.accumulate(np.where(kind & 8, np.arange(len(lines)), -1)) if len(lines) else np.empty(0, int)
    total = lambda i: int(lines["total"][seen[i]]) if seen[i] >= 0 else None
    judged = np.flatnonzero(kind & 2)
    hit = (kind[judged] & 4) > 0
    first = int(hit.argmax()) if hit.any() else len(judged)
    early = judged[:first][: limit + 1]
    out = {
        "steps": int(step[-1]) if len(lines) else 0, "total": total(-1) if len(lines) else None,
        "misses": first, "miss_steps": step[early].tolist(), "miss_totals": [total(i) for i in early.tolist()],
        "hit": first < len(judged),
    }
    if out["hit"]:
        rest, hits = judged[first:], hit[first:]
        number = np.arange(len(rest))
        patience = number - np.maximum.accumulate(np.where(hits, number, 0))
        over = np.flatnonzero(patience > limit)
        end = int(over[0]) if len(over) else len(rest) - 1
        good = rest[: end + 1][hits[: end + 1]]
        best = good[int(lines["loss"][good].argmin())]
        out |= {"best": float(lines["loss"][best]), "best_at": int(step[best]), "patience": int(patience[end])}
        out |= {"stop_at": int(step[rest[end]]) if len(over) else None, "stop_total": total(rest[end])}
    return out


def advance(state: Monitor, part: dict, limit: int) -> Monitor:
    """The state after a summarised stretch of lines."""
    if state.stop_step is not None:
        return state
    steps, patience = state.steps, state.patience
    newer = lambda total: state.total_steps if total is None else total
    if state.target_hit:
        last = limit - patience  # the miss, counted from 0, that is one too many
        if last < part["misses"]:
            stop = steps + part["miss_steps"][last]
            return replace(state, steps=stop, stop_step=stop, patience=limit + 1, total_steps=newer(part["miss_totals"][last]))
        patience += part["misses"]
    if part["hit"]:
        if state.best_loss is None or part["best"] < state.best_loss:
            state = replace(state, best_loss=part["best"], best_step=steps + part["best_at"])
        state, patience = replace(state, target_hit=True), part["patience"]
        if part["stop_at"] is not None:
            stop = steps + part["stop_at"]
            return replace(state, steps=stop, stop_step=stop, patience=patience, total_steps=newer(part["stop_total"]))
    return replace(state, steps=steps + part["steps"], patience=patience, total_steps=newer(part["total"]))


def _in_order(lines: np.ndarray) -> np.ndarray:
    """Lines by number, each number once (the first of several)."""
    order = np.argsort(lines["at"], kind="stable")
    lines = lines[order]
    return lines[np.concatenate([[True], lines["at"][1:] != lines["at"][:-1]])] if len(lines) else lines


def cells(lines: DataFrame, dense: bool, limit: int, cell: int = CELL) -> DataFrame:
    """(run, cell, n, whole, content): whole cells as summaries, others as their lines.

    Without dense numbers there are no whole cells.
    """
    schema = pa.schema([("run", pa.string()), ("cell", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("content", pa.binary())])

    def flush(held):
        table = pa.Table.from_batches(held).combine_chunks()
        runs = table.column("run").combine_chunks().dictionary_encode()
        flag = lambda name: table.column(name).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)
        rows = np.zeros(len(table), LINE)
        rows["at"] = table.column("line_no").to_numpy()
        total = table.column("total_steps")
        known = total.combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        rows["kind"] = flag("is_metrics") + 2 * flag("judged").astype(np.uint8) + 4 * flag("hit").astype(np.uint8) + 8 * known.astype(np.uint8)
        rows["loss"] = table.column("loss").combine_chunks().fill_null(0).to_numpy()
        rows["total"] = total.combine_chunks().fill_null(0).to_numpy()
        codes = runs.indices.to_numpy()
        order = np.lexsort((rows["loss"], rows["kind"], rows["at"], codes))  # of unequal lines of one number the same one counts always
        rows, codes = rows[order], codes[order]
        number = rows["at"] // cell
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (number[1:] != number[:-1])) + 1
        out = {name: [] for name in schema.names}
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
            own = _in_order(rows[start:end])
            whole = dense and len(own) == cell
            content = json.dumps(summarise(own, limit)).encode() if whole else own.tobytes()
            for name, value in zip(schema.names, (runs.dictionary[int(codes[start])].as_py(), int(number[start]), len(own), whole, content), strict=True):
                out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BUFFER:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return lines.mapInArrow(run, CELLS)


def monitor_processor(dense: bool, limit: int, cell: int = CELL, idle_ms: int | None = None):
    """Processor class of the target-loss monitor, over the rows of `cells`."""

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", STATE, idle_ms)
            self.pending = handle.getMapState("pending", "cell bigint", PENDING, idle_ms)

        def handleInputRows(self, key, rows, timer_values):
            known = self.state.get()
            # each call of the state is a message: cells are asked for once, and written if they still wait
            self.held, self.stored, self.changed, self.new = {}, set(), set(), known is None
            known = known or (0, -1, *asdict(Monitor()).values(), 0)
            at, last_line, late = known[0], known[1], known[-1]
            state = Monitor(*known[2:-1])
            if dense:
                late += self.take(rows, at, last_line)
                while (found := self.waiting(at)) and found[0]:
                    state = advance(state, json.loads(found[1]), limit)
                    if at in self.stored:
                        self.pending.removeKey((at,))
                    self.held.pop(at, None)
                    at += 1
                self.keep()
                # of the cell that is not whole yet, the lines up to the first gap
                begun = np.frombuffer(found[1], LINE) if found else np.empty(0, LINE)
                ready = begun[: int((begun["at"] == at * cell + np.arange(len(begun))).sum())]
                shown = advance(state, summarise(ready, limit), limit)
                last_line = at * cell + len(ready) - 1
            else:
                parts = [np.frombuffer(row["content"], LINE) for row in rows]
                lines = _in_order(np.concatenate(parts))
                late += int((lines["at"] <= last_line).sum())
                lines = lines[lines["at"] > last_line]
                state = shown = advance(state, summarise(lines, limit), limit)
                last_line = int(lines["at"][-1]) if len(lines) else last_line
            self.state.update((at, last_line, *asdict(state).values(), late))
            yield Row(
                run=key[0],
                line_no=last_line,
                steps=shown.steps,
                total_steps=shown.total_steps,
                best_loss=shown.best_loss,
                best_step=shown.best_step,
                patience=shown.patience,
                target_hit=shown.target_hit,
                early_stopped=shown.stop_step is not None,
                stop_step=shown.stop_step,
                late_lines=late,
            )

        def keep(self) -> None:
            """Write what waits and is new."""
            for number in self.changed.intersection(self.held):
                self.pending.updateValue((number,), self.held[number])

        def waiting(self, number: int):
            """(whole, content) of a cell that waits, if it does."""
            if number not in self.held and not self.new:
                found = self.pending.getValue((number,))
                if found is not None:
                    self.stored.add(number)
                    self.held[number] = (found[0], found[1])
            return self.held.get(number)

        def take(self, rows, at: int, last_line: int) -> int:
            """Add the cells of a batch to those that wait; how many of their lines were judged before."""
            late = 0
            for _, number, n, whole, content in rows:
                if number < at:
                    late += n
                    continue
                found = self.waiting(number)
                if found and found[0]:
                    continue
                if number == at and last_line >= at * cell:
                    repeated = at * cell + np.arange(n) if whole else np.frombuffer(content, LINE)["at"]
                    late += int((repeated <= last_line).sum())
                if found and not whole:
                    lines = _in_order(np.concatenate([np.frombuffer(found[1], LINE), np.frombuffer(content, LINE)]))
                    whole = len(lines) == cell
                    content = json.dumps(summarise(lines, limit)).encode() if whole else lines.tobytes()
                self.held[number] = (bool(whole), bytes(content))
                self.changed.add(number)
                if len(self.held) >= HELD:
                    self.keep()
                    self.held, self.changed, self.new = {}, set(), False
            return late

        def close(self) -> None:
            pass

    return Processor


def monitor_stream(
    lines: DataFrame, target: float, limit: int = PATIENCE_LIMIT, dense: bool = True, cell: int = CELL,
    idle_ms: int | None = None,
) -> DataFrame:
    """State and stop decision of each run after each micro-batch (update mode).

    With `dense` line numbers (0, 1, 2, …) early lines wait in state until the gap before them
    is filled, so the order of arrival does not matter; lines that come again are counted in
    `late_lines`. Otherwise lines are ordered within a batch, and one that comes after a later
    line was judged is counted there.

    A run's lines are shuffled by cell, so its summaries are made by many tasks; the state
    takes one row per cell and batch. A run that was idle for `idle_ms` leaves the state (None:
    never); a line that comes later begins a new one. Lines without run or number are left
    out. Needs the RocksDB state store. With `idle_ms`, Spark adds batches without data for its
    timers, so a query triggered by `availableNow` ends only with
    `spark.sql.streaming.noDataMicroBatches.enabled` set to false.
    """
    line, loss = F.col("line"), F.col("loss")
    # a line is parsed once: in one step with what is made of the loss it would be once for each use
    parsed = lines.filter("run IS NOT NULL AND line_no IS NOT NULL").select(
        "run",
        "line_no",
        logline.is_metrics(line).alias("is_metrics"),
        logline.parse_metrics(line)["loss"].alias("loss"),
        logline.total_steps(line).alias("total_steps"),
    )
    slim = parsed.select(
        "run",
        "line_no",
        "is_metrics",
        loss.isNotNull().alias("judged"),
        "loss",
        logline.within_target(loss, F.lit(float(target))).alias("hit"),
        "total_steps",
    )
    if not dense:
        slim = slim.filter(F.col("is_metrics") | F.col("total_steps").isNotNull())
    dealt = slim.repartition("run", F.floor(F.col("line_no") / cell))
    return cells(dealt, dense, limit, cell).groupBy("run").transformWithState(
        monitor_processor(dense, limit, cell, idle_ms)(), OUTPUT, "Update", "none" if idle_ms is None else "ProcessingTime"
    )

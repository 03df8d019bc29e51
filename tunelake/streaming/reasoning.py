"""Reasoning blocks in a live token stream.

Tasks join neighbouring tokens of an answer to chunks before they reach its state, so the
state takes a few texts per batch, with the places where their tokens end.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import BPE_NEWLINE, BPE_SPACE, THINK_CLOSE, THINK_OPEN

STATE = "held string, inside boolean, next_seq bigint, part bigint"
#: Neighbouring tokens from number `seq` on: their text, where in it each ends, and whether the last is the answer's.
CHUNKS = "conv_id bigint, turn bigint, seq bigint, text string, ends array<int>, last boolean"
PENDING = "text string, ends array<int>, last boolean"
#: Tokens that a task holds while it joins them.
BUFFER = 200_000
#: Fitting times to remember an answer that has ended, and to wait for the end of one.
FORGET_MS = 3600 * 1000
IDLE_MS = 24 * 3600 * 1000
OUTPUT = "conv_id bigint, turn bigint, part bigint, text string"
TAG = re.compile(f"{THINK_OPEN}|{THINK_CLOSE}")
REPAIR = str.maketrans({BPE_NEWLINE: "\n", BPE_SPACE: " "})


def _unfinished(text: str, tag: str) -> int:
    """Length of the longest end of the text that begins the tag without completing it."""
    return next((n for n in range(len(tag) - 1, 0, -1) if text.endswith(tag[:n])), 0)


def advance(held: str, inside: bool, new: str) -> tuple[str, str, bool]:
    """(visible text, text held back, inside a block) after new text arrived."""
    text, visible, at = held + new, [], 0
    for tag in TAG.finditer(text):
        opens = tag.group() == THINK_OPEN
        if opens != inside:
            if opens:
                visible.append(text[at : tag.start()])
            at, inside = tag.end(), opens
    rest = text[at:]
    cut = len(rest) - _unfinished(rest, THINK_CLOSE if inside else THINK_OPEN)
    if not inside:
        visible.append(rest[:cut])
    return "".join(visible).translate(REPAIR), rest[cut:], inside


def chunks(tokens: DataFrame) -> DataFrame:
    """Runs of neighbouring tokens of an answer, as found within a task."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("ends", pa.list_(pa.int32())), ("last", pa.bool_())])

    def flush(held):
        table = pa.Table.from_batches(held).sort_by([("conv_id", "ascending"), ("turn", "ascending"), ("seq", "ascending")])
        numbers = [table.column(c).to_numpy() for c in ("conv_id", "turn", "seq")]
        text, last = table.column("token").to_pylist(), table.column("last").to_pylist()
        other = np.concatenate([[True], (numbers[0][1:] != numbers[0][:-1]) | (numbers[1][1:] != numbers[1][:-1])])
        again = np.concatenate([[False], ~other[1:] & (numbers[2][1:] == numbers[2][:-1])])  # a repeated token counts once
        at = np.flatnonzero(~again)
        gap = np.concatenate([[True], other[at[1:]] | (numbers[2][at[1:]] != numbers[2][at[:-1]] + 1)])
        edges = [*np.flatnonzero(gap).tolist(), len(at)]
        out = {name: [] for name in schema.names}
        for start, end in zip(edges, edges[1:], strict=False):
            own = at[start:end].tolist()
            pieces = [text[i] or "" for i in own]
            row = (*(int(n[own[0]]) for n in numbers), "".join(pieces), np.cumsum([len(p) for p in pieces]).tolist(), bool(last[own[-1]]))
            for name, value in zip(schema.names, row, strict=True):
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

    return tokens.mapInArrow(run, CHUNKS)


def filter_processor(forget_ms: int | None = None, idle_ms: int | None = None):
    """Processor class of the reasoning filter, over the rows of `chunks`."""

    class ReasoningFilter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", STATE, idle_ms)
            self.pending = handle.getMapState("pending", "seq bigint", PENDING, idle_ms)
            self.closed = handle.getValueState("closed", "closed boolean", forget_ms)

        def handleInputRows(self, key, rows, timer_values):
            new = [x for chunk in rows for x in zip(chunk["seq"], chunk["text"], chunk["ends"], chunk["last"], strict=True)]
            if self.closed.exists():
                return
            held, inside, next_seq, part = self.state.get() or ("", False, 0, 0)
            waiting = sorted(k[0] for k in self.pending.keys()) if self.state.exists() else []
            parts, ended = [], False
            for seq, text, ends, last in sorted(new, key=lambda x: int(x[0])):
                # what waits and comes next goes first
                next_seq, ended = self.drain(waiting, parts, next_seq, ended)
                next_seq, ended = self.put(waiting, parts, next_seq, ended, int(seq), text, list(ends), bool(last))
            next_seq, ended = self.drain(waiting, parts, next_seq, ended)
            text, held, inside = advance(held, inside, "".join(parts))
            if ended:
                if not inside:
                    text += held.translate(REPAIR)
                self.state.clear()
                self.pending.clear()
                self.closed.update((True,))
            else:
                self.state.update((held, inside, next_seq, part + bool(text)))
            if text:
                yield pd.DataFrame({"conv_id": [key[0]], "turn": [key[1]], "part": [part], "text": [text]})

        def put(self, waiting, parts, next_seq, ended, seq, text, ends, last):
            """Take a chunk as far as it is new: at once if it comes next, else it waits."""
            known = next_seq - seq
            if known >= len(ends):
                return next_seq, ended
            if known < 0:
                if seq not in waiting or len(ends) > len(self.pending.getValue((seq,))[1]):
                    self.pending.updateValue((seq,), (text, ends, last))
                    waiting[:] = sorted({*waiting, seq})
                return next_seq, ended
            parts.append(text[ends[known - 1] :] if known else text)
            return seq + len(ends), last

        def drain(self, waiting, parts, next_seq, ended):
            while waiting and waiting[0] <= next_seq:
                seq = waiting.pop(0)
                text, ends, last = self.pending.getValue((seq,))
                self.pending.removeKey((seq,))
                next_seq, ended = self.put(waiting, parts, next_seq, ended, seq, text, list(ends), last)
            return next_seq, ended

        def close(self) -> None:
            pass

    return ReasoningFilter


def visible_stream(tokens: DataFrame, forget_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Visible text of a token stream (conv_id, turn, seq, token, last), in append mode.

    `seq` counts 0, 1, 2, … within an answer; tokens that come early wait for the gap to fill,
    tokens that come again are ignored. Text that may still become a tag is held back; the row
    marked `last` flushes it, unless a block is open. The pieces of an answer in `part` order
    are its visible text.

    An answer leaves the state with its last token; that it has ended is remembered for
    `forget_ms`, and one that stays without an end for `idle_ms` (None: for ever). Needs the
    RocksDB state store. With these times, Spark adds batches without data for its timers, so
    a query triggered by `availableNow` ends only with
    `spark.sql.streaming.noDataMicroBatches.enabled` set to false.
    """
    slim = tokens.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND seq IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("seq").cast("long"), F.col("token").cast("string"), F.col("last").cast("boolean")
    )
    timed = "none" if forget_ms is None and idle_ms is None else "ProcessingTime"
    return chunks(slim).groupBy("conv_id", "turn").transformWithStateInPandas(
        filter_processor(forget_ms, idle_ms)(), OUTPUT, "Append", timed
    )

"""Splittable scans of `.json` documents: arrays, single objects, or lines.

A document of any size is read in chunks, by as many tasks as it has file splits. Commas are
the record separator of the reader, so a chunk never begins inside an escape or a character;
whether it begins inside a string, and how deep in brackets, is not known to its task. Pass
one summarises each chunk for either case (a handful of numbers); running sums of these, over
one row per chunk, give every chunk's true state and the shape of its document. Pass two cuts
the chunks at the commas between elements (or at line ends); whole elements stay with their
chunk, and only those that cross chunks are put together from their parts.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import detect
from .files import _reader, plain_path

#: Bytes of a chunk, about; a longer stretch without a comma stays whole.
CHUNK = 1 << 20
_BOM = b"\xef\xbb\xbf"
_SPACE = b" \t\r\n"
_NONE = 1 << 40  # a depth that no chunk has
_LINE_END = re.compile(rb"\r\n|\r|\n")

#: Structural kinds of the bytes: quote, opening, closing, comma.
_KIND = np.zeros(256, np.int8)
_KIND[34], _KIND[[91, 123]], _KIND[[93, 125]], _KIND[44] = 1, 2, 3, 4
_STEP = np.array([0, 0, 1, -1, 0], np.int64)


def read_chunks(
    spark: SparkSession, path, pattern: str | None = "*.json", recursive: bool = False, size: int = CHUNK
) -> DataFrame:
    """Rows (file, block, chunk, text): the bytes of the files, in order of (block, chunk).

    `block` is the start of the file split and `chunk` counts within it. Every chunk but a
    file's first begins with a comma. A byte-order mark at the start is left out.
    """
    pieces = _reader(spark, pattern, recursive).option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"),
    )
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("text", pa.binary())])

    def pack(batches):
        place, number, held, length = None, 0, [], 0

        def chunk():
            text = b",".join(held)
            if place[1] or number:
                text = b"," + text
            elif text.startswith(_BOM):
                text = text[len(_BOM) :]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*place, number, text), schema.types, strict=True)], schema=schema)

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            files = batch.column("file").dictionary_encode()
            codes = files.indices.to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                if start == end:
                    continue
                here = (files.dictionary[int(codes[start])].as_py(), int(blocks[start]))
                if here != place:
                    if held:
                        yield chunk()
                    place, number, held, length = here, 0, [], 0
                part = batch.column("piece").slice(start, end - start)
                ends = np.cumsum(pc.binary_length(part).to_numpy() + 1)
                values, taken, done = part.to_pylist(), 0, 0
                while done < len(values):
                    upto = min(len(values), int(np.searchsorted(ends, taken + size - length)) + 1)
                    held += values[done:upto]
                    length += int(ends[upto - 1]) - taken
                    taken, done = int(ends[upto - 1]), upto
                    if length >= size:
                        yield chunk()
                        number, held, length = number + 1, [], 0
        if held:
            yield chunk()

    packed = pieces.mapInArrow(pack, "file string, block long, chunk long, text binary")
    return packed.withColumn("file", plain_path(F.col("file")))


def _structure(text: bytes):
    """Places and kinds of the structural bytes, and the parity of quotes after each."""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_KIND[data])
    kind = _KIND[data[at]]
    if b"\\" in text:
        slash = data == 92
        index = np.arange(len(data))
        run = index - np.maximum.accumulate(np.where(slash, -1, index))  # backslashes that end here
        escaped = (kind == 1) & (at > 0) & (run[at - 1] % 2 == 1)
        at, kind = at[~escaped], kind[~escaped]
    return at, kind, np.cumsum(kind == 1) & 1


def _depths(kind: np.ndarray, parity: np.ndarray, inside: int):
    """Depth after each structural byte, from 0 at the chunk's start, and which lie outside strings."""
    outside = (parity ^ inside) == 0
    return np.cumsum(np.where(outside, _STEP[kind], 0)), outside


_SUMMARY = ["delta", "least", "comma", "ends"]
_SUMMARY_TYPE = "file string, block long, chunk long, lead string, newline boolean, quotes long, " + ", ".join(
    f"{name}{s} long" for s in (0, 1) for name in _SUMMARY
)


def _summary(text: bytes) -> dict:
    at, kind, parity = _structure(text)
    out = {"quotes": int(parity[-1]) if len(at) else 0}
    blank = not text[int(at[-1]) + 1 :].strip(_SPACE) if len(at) else False
    for s in (0, 1):
        depth, outside = _depths(kind, parity, s)
        commas = depth[(kind == 4) & outside]
        out |= {
            f"delta{s}": int(depth[-1]) if len(at) else 0,
            f"least{s}": int(depth.min()) if len(at) else _NONE,
            f"comma{s}": int(commas.min()) if len(commas) else _NONE,
            # the least depth is first reached by the last structural byte, with blanks behind it
            f"ends{s}": int(blank and int(depth.argmin()) == len(depth) - 1),
        }
    return out


def summaries(chunks: DataFrame) -> DataFrame:
    """Per chunk what it does to the state, for a start outside (0) and inside (1) a string.

    `quotes` is the parity of its quotes; `delta`, `least` and `comma` are the change of
    depth, the least depth and the least depth at a comma, relative to the start.
    """
    names = ["file", "block", "chunk", "lead", "newline", "quotes", *[f"{n}{s}" for s in (0, 1) for n in _SUMMARY]]

    def run(batches):
        for batch in batches:
            rows = []
            for row in zip(*[batch.column(c) for c in ("file", "block", "chunk", "text")], strict=True):
                file, block, number, text = [x.as_py() for x in row]
                lead = text.lstrip(_SPACE)[:1].decode("ascii", "replace") if block == 0 and number == 0 else None
                rows.append({"file": file, "block": block, "chunk": number, "lead": lead,
                             "newline": b"\n" in text or b"\r" in text, **_summary(text)})
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=_arrow_schema())

    return chunks.mapInArrow(run, _SUMMARY_TYPE)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (field.split(" ") for field in _SUMMARY_TYPE.split(", "))])


def states(parts: DataFrame) -> DataFrame:
    """(file, block, chunk, inside, depth, shape, newline, comma, least, element) of every chunk.

    `shape` is what the document's outline says: array, object (a single one) or lines;
    `element` counts the chunks before in which an element or line ends. The windows hold one
    small row per chunk, so a file of a terabyte has a million of them.
    """
    file = Window.partitionBy("file")
    before = file.orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    chosen = lambda name: F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    rows = parts.withColumn("inside", sum_before("quotes") % 2)
    rows = rows.select("file", "block", "chunk", "lead", "newline", "quotes", "inside", *[chosen(n).alias(n) for n in _SUMMARY])
    rows = rows.withColumn("depth", sum_before("delta"))
    # one value that closes with the last significant byte of the document, and not before
    place = F.struct("block", "chunk")
    closes = F.col("depth") + F.col("least") <= 0
    clean = closes & (F.col("ends") == 1) & ((F.col("inside") + F.col("quotes")) % 2 == 0) & (F.col("depth") + F.col("delta") == 0)
    one = (
        (F.count_if(closes).over(file) == 1)
        & F.coalesce(F.max(F.when(clean, place)).over(file) == F.max(place).over(file), F.lit(False))
    )
    lead = F.max("lead").over(file)
    shape = F.when(one & (lead == "["), "array").when(one & (lead == "{"), "object").otherwise("lines")
    return _numbered(rows.withColumn("shape", shape))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add `element`, from depths and shapes."""
    first = (F.col("block") == 0) & (F.col("chunk") == 0)
    cut = F.when(F.col("shape") == "array", first | (F.col("depth") + F.col("comma") == 1) | (F.col("depth") + F.col("least") == 0)).when(
        F.col("shape") == "lines", first | F.col("newline")
    ).otherwise(F.lit(False))
    before = Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    element = F.coalesce(F.sum(cut.cast("long")).over(before), F.lit(0))
    return rows.select("file", "block", "chunk", "inside", "depth", "shape", "newline", "comma", "least", element.alias("element"))


def _ends(text: bytes, shape: str, inside: int, depth: int, first: bool) -> list[tuple[int, int]]:
    """Where the bytes lie that end an element or line, the first and the last of them.

    The beginning of an array, or of a document of lines, counts as one.
    """
    if shape == "array":
        at, kind, parity = _structure(text)
        level, outside = _depths(kind, parity, inside)
        level = level + depth
        ends = outside & (((kind == 4) & (level == 1)) | ((kind == 3) & (level == 0)))
        if first:
            ends[0] = True
        return [(p, p + 1) for p in at[ends][[0, -1]].tolist()] if ends.any() else []
    found = [(0, 0)] if first else []
    if shape == "lines":
        match = _LINE_END.search(text)
        if match:
            last = max(text.rfind(b"\r"), text.rfind(b"\n"))
            found += [match.span(), (last - text.endswith(b"\r\n", 0, last + 1), last + 1)]
    return found if shape == "lines" else []


_RUN_TYPE = "file string, shape string, block long, chunk long, element long, text binary"


def _cut(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of whole elements (element NULL) and of parts of elements that cross chunks."""
    schema = pa.schema([("file", pa.string()), ("shape", pa.string()), ("block", pa.int64()), ("chunk", pa.int64()), ("element", pa.int64()), ("text", pa.binary())])
    rows = chunks.join(state.select("file", "block", "chunk", "inside", "depth", "shape", "element"), ["file", "block", "chunk"])

    def run(batches):
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("file", "block", "chunk", "inside", "depth", "shape", "element", "text")], strict=True):
                file, block, number, inside, depth, shape, element, text = [x.as_py() for x in row]
                first = block == 0 and number == 0
                found = _ends(text, shape, inside, depth, first)
                out = []
                if not found:
                    out.append((element, text))
                else:
                    start, end = found[0], found[-1]
                    if not first:
                        out.append((element, text[: start[0]]))
                    if end > start:
                        out.append((None, text[start[1] : end[0]]))
                    if not (shape == "array" and text[end[0] : end[1]] == b"]"):
                        out.append((element + 1, text[end[1] :]))
                place = {"file": file, "shape": shape, "block": block, "chunk": number}
                yield pa.RecordBatch.from_pylist([place | {"element": e, "text": t} for e, t in out], schema=schema)

    return rows.mapInArrow(run, _RUN_TYPE)


def _joined(runs: DataFrame) -> DataFrame:
    """(file, shape, block, chunk, tail, text): stretches of whole elements, in document order.

    An element that crosses chunks stands at the chunk it begins in, behind its whole ones.
    """
    whole = runs.filter("element IS NULL").select("file", "shape", "block", "chunk", F.lit(0).alias("tail"), F.col("text").cast("string").alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("block", "chunk", "text")))
    crossing = runs.filter("element IS NOT NULL").groupBy("file", "shape", "element").agg(parts.alias("p"))
    return whole.unionByName(crossing.select(
        "file", "shape", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["chunk"].alias("chunk"), F.lit(1).alias("tail"),
        F.array_join(F.transform("p", lambda x: x["text"].cast("string")), "").alias("text"),
    ))


def _items(shape: Column, text: Column) -> Column:
    """The elements of a stretch; NULL if it is not what the outline promises."""
    return (
        F.when(shape == "array", detect.array_items(F.concat(F.lit("["), text, F.lit("]"))))
        .when(shape == "object", F.when(detect.single_object(text).isNotNull(), F.array(text)))
        .otherwise(F.split(text, r"\r\n|\r|\n"))
    )


def document_runs(
    spark: SparkSession, path, pattern: str | None = "*.json", recursive: bool = False, size: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """(outlined, fallback): rows (file, shape, block, chunk, tail, items) of stretches of elements.

    The first holds the documents by their outline, with items NULL where the text does not
    parse. The second, given the names of the files to read so, holds lines.
    """
    chunks = read_chunks(spark, path, pattern, recursive, size)
    state = states(summaries(chunks)).persist()  # one small row per chunk
    outlined = _joined(_cut(chunks, state))
    as_items = lambda rows: rows.select("file", "shape", "block", "chunk", "tail", _items(F.col("shape"), F.col("text")).alias("items"))

    def lines_of(files: DataFrame) -> DataFrame:
        again = state.join(files.select("file"), "file", "left_semi").withColumn("shape", F.lit("lines"))
        return as_items(_joined(_cut(chunks, _numbered(again))))

    return as_items(outlined), lines_of


def _broken() -> Column:
    """Of a file's stretches: one does not parse, or is empty among others (a comma too many)."""
    empty = F.count_if(F.size("items") == 0)
    return (F.count_if(F.col("items").isNull()) > 0) | ((F.max("shape") == "array") & (empty > 0) & (F.count(F.lit(1)) > 1))


def document_records(
    spark: SparkSession, path, pattern: str | None = "*.json", recursive: bool = False, size: int = CHUNK
) -> DataFrame:
    """Rows (file, shape, block, pos, record): the records of `.json` documents of any size.

    (block, pos) is the order within a file. A document that is neither one array nor one
    object counts as lines, blank ones included.
    """
    outlined, lines_of = document_runs(spark, path, pattern, recursive, size)
    broken = outlined.groupBy("file").agg(_broken().alias("broken")).filter("broken").persist()  # a row per such file
    runs = outlined.join(broken, "file", "left_anti").unionByName(lines_of(broken))
    rows = runs.select("file", "shape", "block", "chunk", "tail", F.posexplode_outer("items").alias("at", "record")).filter("at IS NOT NULL")
    pos = F.shiftleft("chunk", 33) + F.shiftleft(F.col("tail").cast("long"), 32) + F.col("at")
    return rows.select("file", "shape", "block", pos.alias("pos"), "record")


def document_heads(
    spark: SparkSession, path, pattern: str | None = "*.json", recursive: bool = False, size: int = CHUNK
) -> DataFrame:
    """(file, shape, record, examples): the first record and the number of records of each document.

    A single object counts as one example and has no first record. One pass; only documents
    that turn out not to parse are read again, as lines.
    """
    outlined, lines_of = document_runs(spark, path, pattern, recursive, size)

    def heads(runs: DataFrame) -> DataFrame:
        filled = F.when(F.col("shape") == "lines", F.filter("items", lambda x: x.rlike(r"\S"))).otherwise(F.col("items"))
        first = F.when(F.col("shape") != "object", F.get("items", F.lit(0)))
        return runs.groupBy("file").agg(
            F.max("shape").alias("shape"), F.min_by(first, F.struct("block", "chunk", "tail")).alias("record"),
            F.sum(F.size(filled)).cast("bigint").alias("examples"), _broken().alias("broken"),
        )

    found = heads(outlined).persist()  # one row per file
    again = heads(lines_of(found.filter("broken")))
    return found.filter("NOT broken").unionByName(again).drop("broken")

"""Packing by concatenation and cutting.

All documents stand in one line, partition after partition. The first pass encodes each
partition and notes where every document starts in it; a prefix sum over the partitions'
token totals then turns that into global offsets. The second pass cuts the line every
`window` tokens; a document over a border gives one record on each side. Only the last
sequence can be short, so padding is less than one window in all.
"""

import os
import re
import zlib
from array import array
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .common import by_bytes, stored, whole_text

WINDOW = 4096
END_ID = 2
#: Chunks, and distinct words, that a worker's tables keep.
TABLE_CHUNKS = 400_000
TABLE_WORDS = 600_000
#: Chunks of printable Latin-1 characters without an apostrophe (which can start a contraction).
_PLAIN = re.compile("[!-&(-~\xa1-\xac\xae-\xff]+")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
#: What sends a text's chunks through the tokenizer's own rules: other characters than blanks and plain ones.
_ODD = re.compile("[^ \t\n\r!-&(-~\xa1-\xac\xae-\xff]|<[|]")
_PLAIN_WORD = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS} \t\n\r]+")
_CONTROLS = "\x1c\x1d\x1e\x1f"
_CHUNK = re.compile(r"[^ \t\n\r]+")


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and never merges across it.

    Ids are little-endian integers of `dtype`, 16 bits where the vocabulary allows it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = ChunkTable(partial(self._run, self.plain), TABLE_WORDS)
        self.table = ChunkTable(self._codes, TABLE_CHUNKS)

    def _run(self, tokenizer, chunks: list[str]) -> list[bytes]:
        run = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        kind = {2: "H", 4: "I"}[self.dtype.itemsize]
        return [array(kind, e.ids).tobytes() for e in run(chunks, add_special_tokens=False)]

    def _codes(self, chunks: list[str]) -> list[bytes]:
        """Plain chunks are put in lower case and cut into words here, as the tokenizer's own
        normaliser and pattern would, so that its model sees each distinct word once."""
        words = [
            [c.lower()] if c.isalpha() and c.isascii() else _WORD.findall(c.lower()) if _PLAIN.fullmatch(c) else None
            for c in chunks
        ]
        words = [None if w is not None and "<|" in c else w for c, w in zip(chunks, words, strict=True)]
        self.words.learn(chain.from_iterable(filter(None, words)))
        odd = [c for c, w in zip(chunks, words, strict=True) if w is None]
        rest = iter(self._run(self.whole, odd) if odd else [])
        code = self.words.__getitem__
        return [next(rest) if w is None else b"".join(map(code, w)) for w in words]

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Ids of the texts, each with the end id. Texts of plain characters are cut into words at once."""
        end = np.array(end_id, self.dtype).tobytes()
        out = [end] * len(texts)
        odd = [i for i, text in enumerate(texts) if _ODD.search(text)]
        chunks = [_split(texts[i]) for i in odd]
        self.table.learn(chain.from_iterable(chunks))
        code = self.table.__getitem__
        for i, c in zip(odd, chunks, strict=True):
            out[i] = b"".join(map(code, c)) + end
        plain = sorted(set(range(len(texts))) - set(odd))
        words = [_PLAIN_WORD.findall(texts[i].lower()) for i in plain]
        self.words.learn(chain.from_iterable(words))
        code = self.words.__getitem__
        for i, w in zip(plain, words, strict=True):
            out[i] = b"".join(map(code, w)) + end
        return out


def _split(text: str) -> list[str]:
    """Chunks between white space. Some control characters are white space to Python only."""
    return _CHUNK.findall(text) if any(c in text for c in _CONTROLS) else text.split()


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_documents(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """part, before, doc_id, doc_tokens, ids: encoded once and written to the shared folder.

    `part` is the partition, `before` the tokens of earlier documents in it, `ids` the ids as
    little-endian integers (of 32 bits, or 16 where the vocabulary fits).
    """
    schema = pa.schema(
        [("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches):
        model, part, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches, "text"):
            ids = model.encode(batch.column("text").to_pylist(), end_id)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // model.dtype.itemsize
            starts = before + np.cumsum(lengths) - lengths
            before += int(lengths.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), part, np.int32)),
                    pa.array(starts),
                    batch.column("doc_id"),
                    pa.array(lengths),
                    pa.array(ids, pa.binary()),
                ],
                schema=schema,
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    encoded = texts.mapInArrow(run, "part int, before long, doc_id long, doc_tokens long, ids binary")
    return stored(encoded, "packing-ids")


def with_offsets(encoded: DataFrame) -> DataFrame:
    """Adds `at`, the document's place in the line of all tokens.

    The window runs over one row per partition, not over documents. The bases are written out
    so that Spark knows their size and broadcasts them only below its threshold.
    """
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    return encoded.join(stored(bases, "packing-bases"), "part").withColumn("at", F.col("base") + F.col("before"))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian 32-bit), ids_crc32,
    doc_tokens, sequence_id, offset.

    Null texts count as empty and give the end id alone. Rows are packed one by one, also
    those with null or repeated doc_ids; other columns are ignored; an empty table gives no
    rows. Sequences are numbered from 0 and, but for the last, full.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
            ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
        ]
    )

    def cut(batches):
        for batch in by_bytes(batches, "ids"):
            out = []
            for doc_id, n, ids, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    piece = ids[4 * start : 4 * (start + length)]
                    out.append((doc_id, start, length, piece, zlib.crc32(piece), n, sequence, offset))
                    start += length
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    encoded = with_offsets(encode_documents(docs, path, end_id))
    return encoded.select("doc_id", "doc_tokens", "ids", "at").mapInArrow(
        cut,
        "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )

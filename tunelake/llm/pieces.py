"""SentencePiece encoding and decoding by a distinct-chunk table.

In a model whose pieces hold the white-space marker only at their front, and no newline, no
merge crosses from a word into the next marker or over a newline. A text is cut there, each
distinct marked word is segmented (and decoded again) once per table, and ids and texts are
joined back by position.
Models without that property are run on whole texts.
"""

import hashlib
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .common import by_bytes, whole_text

MARK = "▁"
#: Chunks that a worker's table keeps.
TABLE_CHUNKS = 200_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
#: Stands before a chunk, so that the library puts its leading marker there and not on the chunk.
_CARRIER = "\n"


class PieceEncoder:
    """Encoder and decoder of one model file; `split` tells whether texts may be cut."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = self.model.eos_id()
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.lead = len(self.model.encode(_CARRIER))
        plain = "a  \ufb01\u00bd e\u0301 \uff21 "
        self.split = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces) and (
            self.model.normalize(plain) == MARK + plain.replace(" ", MARK)
        )
        self.table = ChunkTable(self._codes, TABLE_CHUNKS)

    def _codes(self, chunks: list[str]) -> list[tuple[str, str, int]]:
        """Of each chunk its ids in decimal with a space after each, its decoded text, and how many."""
        coded = self.model.encode([_CARRIER + c for c in chunks], num_threads=1)
        texts = self.model.decode(coded, num_threads=1)
        return [
            ("".join([f"{x} " for x in i[self.lead :]]), t[len(_CARRIER) :], len(i) - self.lead)
            for i, t in zip(coded, texts, strict=True)
        ]

    def round_trip(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """Of each text: ids with the end id in decimal joined by spaces, the decoded text, the number of ids."""
        if not self.split:
            coded = [[*i, self.end] for i in self.model.encode(texts, num_threads=1)]
            decoded = self.model.decode(coded, num_threads=1) if coded else []
            return [(" ".join(map(str, i)), t, len(i)) for i, t in zip(coded, decoded, strict=True)]
        chunks = [marked_words(text) for text in texts]
        self.table.learn(chain.from_iterable(chunks))
        out = []
        for c in chunks:
            ids, decoded, counts = zip(*map(self.table.__getitem__, c), strict=True) if c else ((), (), ())
            # the first marker is the library's own and is not decoded
            out.append((f"{''.join(ids)}{self.end}", "".join(decoded)[1:], sum(counts) + 1))
        return out


def marked_words(text: str) -> list[str]:
    """The text with its white-space markers, cut before each run of markers and around newlines."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return _CHUNK.findall(MARK + text.replace(" ", MARK))
    return [MARK + word for word in text.split(" ")]


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder, kept between batches and tasks."""
    return PieceEncoder(path)


def _rows(path: str, schema: pa.Schema, cells):
    def run(batches):
        model = encoder(path)
        for batch in by_bytes(batches, "text"):
            trips = model.round_trip(batch.column("text").to_pylist())
            columns = [pa.array(c, f.type) for c, f in zip(cells(trips), list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=schema)

    return run


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int, end id last) of every text; null texts count as empty.

    One row per input row, whatever its doc_id; other columns are ignored. An empty text gives
    the end id alone.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def cells(trips):
        return [[list(map(int, ids.split())) for ids, _, _ in trips]]

    return _texts(docs).mapInArrow(_rows(path, schema, cells), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from rows of doc_id and ids; null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        model = encoder(path).model
        for batch in by_bytes(batches, "ids"):
            ids = [i or [] for i in batch.column("ids").to_pylist()]
            texts = pa.array(model.decode(ids, num_threads=1) if ids else [], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], schema=schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def cells(trips):
        return [n for _, _, n in trips], [sha(ids) for ids, _, _ in trips], [sha(text) for _, text, _ in trips]

    return _texts(docs).mapInArrow(
        _rows(path, schema, cells), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

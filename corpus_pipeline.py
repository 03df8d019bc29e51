"""Corpus pipeline: toxic documents go, then copies, near copies and repeated passages; what is
left is packed into training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm import exact_dedup, packing, passages, simhash, toxicity
from tunelake.llm.common import only_rows, stored

#: Bytes of a repeated passage, about fifty short words.
PASSAGE_BYTES = 200
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from the labels of the folder."""
    detector = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, detector)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space aside) the one with the smallest doc_id."""
    return only_rows(docs, exact_dedup.exact_groups(docs).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by SimHash fingerprints of few different bits the one with the smallest doc_id.

    Shingles are of four words and four bits may differ. Documents without words are alike.
    A null doc_id never stays beside another id; of a group without any id all stay.
    """
    groups = simhash.near_groups(docs, words=simhash.SHINGLE, distance=simhash.DISTANCE)
    return only_rows(docs, groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one, or earlier in the same one.

    Characters cut in two are dropped and n_chars is counted again. A document of which
    nothing is left stays, with an empty text.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # other columns travel under names that clash with none of the result's
    names = {c: f"_carried_{i}" for i, c in enumerate(others)}
    rows = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()])
    cut = passages.remove_passages(rows, PASSAGE_BYTES, first=True, as_text=True, carry=tuple(names.values()))
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long"), **{c: F.col(n) for c, n in names.items()}}
    return cut.select([columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_passages),
    ("packing", pack),
]

#: The learned and the byte-wise stages have no SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The dealt operators as named queries over the driver tables."""

from pyspark.sql import functions as F

from . import (
    exact_dedup,
    extraction,
    kneser,
    negatives,
    neighbours,
    packing,
    passages,
    pieces,
    quality,
    simhash,
    spelling,
    toxicity,
    warc,
)

QUERIES = {}
ORACLES = {}


def _named(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@_named("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    groups = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_named("op2_suffix_array_dedup")
def op2(spark, sf_dir):
    return passages.passage_digests(_read(spark, sf_dir, "documents"))


@_named("op3_exact_dedup", exact_dedup.ORACLE)
def op3(spark, sf_dir):
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents")).drop("row_key")


@_named("op4_nearest_neighbours")
def op4(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@_named("op5_lm_scoring")
def op5(spark, sf_dir):
    return kneser.score_documents(_read(spark, sf_dir, "documents"))


@_named("op6_toxicity")
def op6(spark, sf_dir):
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_named("op7_sentencepiece")
def op7(spark, sf_dir):
    return pieces.piece_digests(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


@_named("op8_packing")
def op8(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")).drop("ids")


@_named("op9_warc", warc.ORACLE)
def op9(spark, sf_dir):
    return warc.round_trip(_read(spark, sf_dir, "pages"))


@_named("op10_html_extraction")
def op10(spark, sf_dir):
    return extraction.extract(_read(spark, sf_dir, "pages"))


@_named("op11_quality_classifier")
def op11(spark, sf_dir):
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@_named("op12_spelling_variants")
def op12(spark, sf_dir):
    return spelling.variants(_read(spark, sf_dir, "documents"))


@_named("op13_hard_negatives", negatives.ORACLE)
def op13(spark, sf_dir):
    return negatives.mine(_read(spark, sf_dir, "embeddings"))

"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet to the folder that driver and executors share, and read again
as the next stage's documents.  All but the last return the columns of ``documents``, so a
document's decision takes effect by its row being there or not.

Nulls, empty tables and clashing columns are handled as the operators' docstrings say: a
null text is rejected by the first stage, a document with a null id is never named a copy.
Rows repeated with one id stay or go together until they are packed, each in its own place.
Ties go to the smaller id (copies), to the first language in order, and to the hash of the
seed and id (mixing).  Very long texts are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxpanel.llm import exact_dedup, langid, mixing, packing, simhash
from fluxpanel.llm.queries import MIX_WEIGHTS, mix_levels, word_bpe
from fluxpanel.llm.util import small_batches, stored, sweep, written

#: A document goes if no language has this share of its posterior.
LEAST_SCORE = 0.5
#: Sources and languages are mixed to these weights within this share of all tokens.
MIX = {"fraction": 0.9, "seed": 42}


def _columns(docs: DataFrame, of: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in of.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told with confidence; those without a letter go."""
    small_batches(spark)
    model = langid.fit(docs)
    scored = langid.predict(docs, model, out=("__lang_pred", "__lang_score"))
    return _columns(scored.where((F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__lang_score") >= LEAST_SCORE)), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 similar shingles of five words join, keep the one with the smallest id.

    Candidates have SimHashes within two bits, found by blocks and pivot distances as in op3, or
    six MinHashes in common in one of 32 bands: 0.99994 of such pairs at the threshold, of which
    SimHashes alone would miss most.  Whole texts are compared after both.
    """
    small_batches(spark)
    return simhash.drop_near_copies(docs, radius=2, bands=32, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the budget of their leaf takes, each once."""
    return mixing.taken(docs, mix_levels(), MIX_WEIGHTS, **MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    small_batches(spark)
    return packing.pack(docs, word_bpe)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained scores, fingerprints, budgets and packing have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = written()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, before, docs)  # what the stage wrote on its way
    return docs

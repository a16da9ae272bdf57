"""A corpus pipeline of five stages over ``documents``, each a table in the shared folder.

Toxic documents go; of exact copies the one with the largest doc_id stays, of near-duplicates (five-word
shingles, a similarity of 0.8 or more) the one with the smallest; sources are mixed to their target
weights; what is left is packed into sequences. SQL can't express the stages, so their results are tested
against brute force.

Defined results: null and empty texts are documents without words, which exact de-duplication makes one
and the mix takes nothing of; rows that repeat doc_id and text are copies; rows of one doc_id with other
texts, or without an id, are told apart; very long texts pass whole. Extra columns, whatever their names,
pass all stages but the last. An empty table gives an empty table after each stage. Ties go as each
operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from listwright.llm import exact_dedup, mixing, near_copies, packing, toxicity
from listwright.llm.common import table, written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
#: Rows of a batch of texts that goes to Python and back: texts are long, and a batch is held on both sides.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")

#: Words that packing's workers remember: they live on beside the other stages' memory.
REMEMBERED = 300_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set(*BATCH)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set(*BATCH)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set(*BATCH)
    return near_copies.keep_smallest(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or cut as the mix takes them; ``n_chars`` follows the text."""
    spark.conf.set(*BATCH)
    mixed = mixing.apply_mix(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else mixed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set(*BATCH)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), remembered=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}

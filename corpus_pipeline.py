"""From raw documents to token ids: each stage reads what the one before has written, and all of it.

All stages but the last return the columns of documents as they are, whatever extra columns there are and whatever
their names, and texts of any length are read whole. An empty table passes all stages and gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import bpe, exact_dedup, minhash, mixing, toxicity
from keyloom.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a model of the labelled ones scores under 0.5.

    Null and empty texts have the model's prior, the share of toxic training texts, as score; repeated rows are decided
    alike; a score of exactly 0.5 is toxic. The model is trained on labelled rows of these docs.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same bytes of text, the one with the smallest doc_id.

    Null and empty texts are equal, so that one document without text stays; rows without doc_id go after all others; of
    rows repeated with one doc_id and text one stays.
    """
    return exact_dedup.exact_dedup(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by like sets of five-word shingles, the one with the smallest doc_id.

    Null, empty and blank texts are linked with nothing and stay, as do rows without doc_id; links at exactly 75 % hold;
    rows repeated with one doc_id stay or go together.
    """
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Texts without words are never taken; a null source is a source of its own; rows repeated with one doc_id count each
    and are taken alike; ties of finish time go by source, place and doc_id.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of each row, token ids of its whole text, and digests of the ids and of the text decoded from them.

    Null and empty texts have no tokens; repeated rows have equal results; other columns are left out.
    """
    return bpe.encode_table(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("bpe", encode),
]

#: SQL can't express the trained scorer or the merges; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage's output is written to the shared folder and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""A training-data pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's rows as Parquet to the shared folder and reads them back for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfwork.llm import bpe, langid, linededup, mixing, neardup
from kerfwork.llm.common import crc_bucket, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least margin of the predicted language of a kept document: its share of word
#: marginals, scaled so that an even share among the learned labels is 0 and all is 1.
LEAST_MARGIN = 0.25


def least_share(labels: int) -> float:
    """The share of word marginals that ``LEAST_MARGIN`` means among so many labels."""
    return (1 + LEAST_MARGIN * (labels - 1)) / labels if labels else 0.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no main language; ``lang``
    becomes the prediction. The model learns as in the query of the operator."""
    learn = docs.where(F.coalesce(crc_bucket(F.col("doc_id")) != 0, F.lit(False))).select("text", "lang")
    model = langid.fit(learn)
    found = langid.predict(docs, model, *COLUMNS)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_share(len(model.labels) if model else 0)))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines in 10 documents or more only the first occurrence stays."""
    return linededup.drop_repeated_lines(docs.select(COLUMNS), min_docs=10, keep_first=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles of 0.8 or
    more) the lowest doc_id stays."""
    return neardup.keep_one(docs.select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    return mixing.mix(docs.select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian uint32 bytes) and counts, with hashes of the ids and of
    the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_ids(docs, path, public_tokenizers.PATTERN, ["doc_id"])


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing_stage), ("encode", encode)]

#: The language model of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

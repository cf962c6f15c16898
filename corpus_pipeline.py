"""A training corpus from documents: toxic texts out, near copies out, personal data masked, sources mixed, pieces encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strongroom.llm import mixing, pii, sentencepiece_scan, simhash, toxicity
from strongroom.llm._common import documents, ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go; learnt from all labels of docs."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become [EMAIL], [IP], [CARD] or [PHONE]."""
    return pii.mask(docs, pii.train(pii.labelled_table(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the source's weight asks for."""
    return mixing.repeat(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of each row."""
    return sentencepiece_scan.encoded_and_back(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: A classifier, XXH64 and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's folder goes once the next is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs

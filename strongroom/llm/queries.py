"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strongroom.llm._common import documents
from strongroom.llm import langid, licenses, merkle, mixing, mpeg, pii, quotes, sentencepiece_scan, toxicity
from strongroom.llm.simhash import near_duplicates


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encoded_and_back(documents(spark, sf_dir))


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.stored_and_read(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, toxicity.held_out_labels(labels, 3, 1))
    held_out = (toxicity.crc_of("doc_id", 3) == 1).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op1_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited(documents(spark, sf_dir), whole=True)


def op1_merkle_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text's edit is: the numbers of the sections that the other's tree doesn't have."""
    rows = merkle.edited(documents(spark, sf_dir), whole=True)
    here, there = F.col("fingerprint"), F.col("edited_fingerprint")
    return rows.select("doc_id", merkle.changed_sections(here, there).alias("replaced"), merkle.changed_sections(there, here).alias("new"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(toxicity.crc_of("doc_id", 5) != 0))
    held_out = (toxicity.crc_of("doc_id", 5) == 0).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    crf = pii.train(pii.labelled_table(spark))
    base = F.filter("spans", lambda s: ~s["added"])
    of_kind = [F.expr(f"cast(size(filter(spans, s -> not s.added and s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return pii.find(documents(spark, sf_dir), crf).select("doc_id", *of_kind, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_merkle": op1_merkle,
    "op1_merkle_whole": op1_merkle_whole,
    "op2_langid": op2_langid,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quotes": op5_quotes,
    "op6_licenses": op6_licenses,
    "op7_mpeg": op7_mpeg,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_merkle": merkle.ORACLE,
    "op5_quotes": quotes.ORACLE,
    "op6_licenses": licenses.ORACLE,
    "op8_mixing": mixing.ORACLE,
}

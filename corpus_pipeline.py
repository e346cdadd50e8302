"""A training-data pipeline over `documents`: each stage applies one corpus operator to all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns the columns of `documents`, the last one
also the tokens. Rows without an id pass the near-duplicate stage as they are; of rows with
one id one stays, whatever their number. Null and empty texts have no language and go at the
first stage, very long ones are taken whole by every stage, ties are those of the operators,
an empty table stays one, and columns beside those of `documents` are dropped.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import decontamination, language, line_dedup, sentencepiece_codec, simhash
from cohortlab.llm.common import table
from cohortlab.session import shared_dir, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays when one language has at least this share of it.
LEAST_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that has half of them, go."""
    model = language.learn(docs.where(~language.held_out()))
    out = language.identify(docs.select(*COLUMNS), model)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumnRenamed("kept_text", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with linked fingerprints the one with the least id stays."""
    groups = simhash.near_duplicates(docs.select("doc_id", "text"), words=3, radius=3)
    others = staged(groups.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    kept = docs.select(*COLUMNS).join(others, "doc_id", "left_anti")
    # repeated rows of one id are copies too; only their texts are shuffled, one of each kept map-side
    ids = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = staged(ids.where("n > 1").select("doc_id"), "repeated")
    single = kept.join(repeated, "doc_id", "left_anti")
    one = F.min_by(F.struct(*COLUMNS), F.struct(F.xxhash64("text"), *COLUMNS))
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(one.alias("row")).select("row.*")
    return single.select(*COLUMNS).unionByName(again)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item go."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontamination.contamination(docs.select("doc_id", "text"), items)
    hit = found.where(F.size("hits") > 0).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and whether decoding gives the text back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_codec.round_trip(docs.select(*COLUMNS), model)
    n_tokens = F.floor(F.octet_length("ids") / 4).alias("n_tokens")
    return out.select(*COLUMNS, "ids", n_tokens, (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("language", known_language),
    ("line_dedup", drop_lines),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/corpus_pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL can't say the language model, the fingerprint search or the tokenizer.
ORACLE_SQL = None

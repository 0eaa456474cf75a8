"""From raw documents to token ids in five stages; each is written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hammerlake.llm import bpe, languages, repeats, simhash, templates
from hammerlake.llm._util import checkpoint_dir
from hammerlake.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model is fitted on these documents themselves."""
    return languages.keep_known(docs, languages.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings; what is left of a character whose bytes were cut goes too."""
    return repeats.strip_repeats(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return templates.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, as digests."""
    return bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("languages", known_language), ("near duplicates", one_of_each), ("repeats", without_repeats), ("leaks", without_leaks), ("tokens", as_tokens)]

#: The stages use hashes, EM and merges that SQL can't express; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, for the ``documents`` table in ``sf_dir``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

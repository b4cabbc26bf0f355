"""The corpus pipeline: documents to a deduplicated, decontaminated, mixed and sharded training set.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet in the shared folder and read again as the next stage's docs. All but the last return
the columns of documents; the last adds ``slot`` and ``shard``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontam, langid, mixing, neardup, sharding
from lectern.llm.common import shared_dir, table

#: Words of a shingle for near-duplicates.
SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is not rejected, by dictionaries learned from their own labels. Texts that are null or have no letters are rejected; equal texts share their fate."""
    return langid.identify(docs, "text", langid.fit_on(docs)).filter("not rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of a five-word Jaccard similarity of 0.8 or more: that with the least doc_id.

    Candidates come from SimHash by ball hashing (llm/neardup.py), by fingerprints of 512 bits: 64 bits within 3, as in operator 3, miss almost all pairs at 0.8. Each is verified on
    its whole sets. All texts without words are one group. Of equal rows one stays; null doc_ids go only in favour of a row that has one.
    """
    return neardup.keep_one(docs, "doc_id", "text", SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark. Null texts have no words and stay; without benchmark items all stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in their sources' target weights: a row for each pass over a document, cut to the words it holds. Texts without words are in no pass; null is a source of its own."""
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard of each. Equal doc_ids meet in one shard; a null one counts as the empty string."""
    return sharding.assign_shards(docs, "doc_id")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]

#: Compression, ball hashing and suffix search are not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after another; all but the last are written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{n}_{name}")
            docs = spark.read.parquet(f"{folder}/{n}_{name}")
    return docs

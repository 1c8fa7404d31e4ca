"""From documents to packed training batches: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontamination, language, packing, pii, simhash
from corpusmill.llm.common import Scratch, read_table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: no letters, or a narrow margin between the two best languages."""
    return language.identify_language(docs).filter("not rejected").select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each SimHash component."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth or more."""
    return decontamination.find_contamination(docs, read_table(spark, sf_dir, "benchmark")).filter("not contaminated").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each piece of personal data."""
    return pii.redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document that is left."""
    return packing.pack(docs)


STAGES = [("language", keep_known_languages), ("near_duplicates", keep_one_of_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact), ("packing", pack)]

#: SQL can express neither compression, nor fingerprints by XXH64, nor the choice of boundaries: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents; what a stage returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
    return docs

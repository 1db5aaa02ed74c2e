"""Cleans a corpus and encodes it: five stages, each on all that the one before kept.

Null texts count as empty, and pass all stages but as copies of each other; empty tables pass as such. Rows that repeat doc_id and text are copies.
Documents without doc_id come after all others. Very long texts are taken whole. Extra columns are kept by all stages but the last, whatever their names but
``_wl_``. doc_id must be an integer or cast to one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import bpe, decontam, linededup, neardup, simhash, toxicity
from webloom.llm.common import fresh_dir, table
from webloom.sources.shared import discard


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, rejects go; without labels of both kinds none does, but where most labels are 1."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts linked by SimHash fingerprints (operator 10) or by a similarity of 0.8 or more in five-word shingles, the document of the smallest doc_id stays, of ties the one of the least digest."""
    return simhash.keep_one(docs, neardup.groups(docs, also=simhash.groups(docs)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated units are cut from all texts but the first that has them; n_chars follows."""
    return linededup.apply(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number and hashes of its tokens."""
    return bpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("neardup", keep_one_of_copies), ("linededup", cut_repeats), ("decontam", drop_leaks), ("bpe", encode)]

#: Fingerprints, the classifier and the encoding have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again."""
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            discard(spark, done)  # its successor is written
        done = path
    return STAGES[-1][1](spark, docs, sf_dir)

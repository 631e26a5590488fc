"""A corpus pipeline over `documents`: language ID, exact dedup, near duplicates, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared
folder and read again as the next stage's docs. All but the last return the columns of documents. A doc_id
can repeat after the mix, once for each pass over a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinlab.llm import bpe, common, exact_dedup, langid, mixing, ngram_join


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; where lang was null it is the prediction.

    Null, empty and letterless texts go; where nothing teaches a model lang stays. Ties go to the first language by
    name; repeated rows repeat; an empty table stays empty; further columns stay, whatever their names."""
    return langid.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space.

    Null and white texts are one group; of equals the longest stays, then the least doc_id (null last), then one by a
    hash of the row; an empty table stays empty; further columns stay."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by shingle similarities of 0.8 or more.

    Texts without words are alike; the least doc_id of a class stays (null last), of repeated rows one; an empty
    table stays empty; further columns stay."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: whole documents repeat, stay or go as their source owes words.

    Documents without words are in no mix; null sources are one source; ties of the permutation go by doc_id and size;
    repeated rows are documents of their own; an empty table stays empty; further columns stay."""
    return mixing.mixed_documents(docs, whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and lang with the length and digests of the ids and of their decoded text.

    Null and empty texts have no ids; repeated rows repeat; an empty table gives no rows; further columns are not
    read."""
    return bpe.digest_documents(docs, keep=("source", "lang"))


STAGES = [
    ("language_id", language_id),
    ("drop_copies", drop_copies),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

ORACLE_SQL = None  # n-gram model scores and BPE are beyond SQL; tests/llm compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs

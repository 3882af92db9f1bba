"""Corpus pipeline: toxic documents go, one of each group of near duplicates stays, personal data is masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hustings.llm import common, jaccard, packing, pii, queries, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels table, doesn't reject.

    Null and empty texts have no hits and stay; texts of any length are judged whole; repeated rows and rows without an
    id are judged each. Without labels of both kinds nothing is rejected; an empty table stays empty.
    """
    common.tidy(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, the one with the least id.

    Texts without words, null ones too, are components of their own and stay, as do rows without an id. Of rows with
    one id the one with the least text stays. An empty table stays empty.
    """
    common.tidy(spark)
    return jaccard.keep_one(docs, jaccard.link(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars of changed texts counted anew; null and empty texts stay."""
    common.tidy(spark)
    return pii.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a null or empty text is its end token alone."""
    common.tidy(spark)
    return packing.pack(docs, queries.byte_bpe())


#: Each first has the executors' garbage collected, so the memory that the stage before it took is given back.
STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", keep_one_of_each), ("pii", mask_personal_data), ("packing", pack)]

#: The stages learn and tokenize, which SQL can't express; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; each is written to the shared folder, read by the next and then deleted."""
    docs, shelf = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.Shelf()
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        shelf.close()
        shelf.take(docs)
    return docs

"""A training corpus from the documents: toxic ones go, copies and near copies go, sources are mixed to target weights, and the mix is packed.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), and its rows are written as Parquet and read again
as the next one's docs. All stages but the last return the columns of docs, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, mixing, near_join, packing, toxicity
from graphloom.llm.common import doc_key, key_seed, quoted, stored, table
from graphloom.llm.language_id import held_out

#: Whole columns of docs in one struct, so that no name clashes with a stage's own.
DOC = "doc"


def _whole(docs: DataFrame):
    return F.struct(*quoted(docs)).alias(DOC)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the grammar learns from labelled rows of docs that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out(0, 5))
    terms, weights = toxicity.learn(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select("text", _whole(docs)), terms, weights, (DOC,)).where("score < 0.5").select(f"{DOC}.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return exact_dedup.exact_dedup(docs, carry=True).where("kept").select(f"{DOC}.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 or more join, the document with the smallest doc_id."""
    seed = key_seed(docs)
    kept = near_join.near_join(docs.select("doc_id", "text"), seed).where("kept").select("key")
    return docs.select(doc_key(seed).alias("key"), _whole(docs)).join(kept, "key").dropDuplicates(["key"]).select(f"{DOC}.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.copies(docs)
    return mixed.select(DOC, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(f"{DOC}.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: The toxicity model can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, near duplicates, mixing, packing, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechlake.llm.common import shared_folder
from speechlake.llm.minhash import drop_near_duplicates
from speechlake.llm.mixing import mixed_documents
from speechlake.llm.packing import packed_documents
from speechlake.llm.quality import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep, unchanged; short ones are judged by their votes alone.

    Null and empty texts go; repeated rows are judged each; an empty table stays empty, as in every stage.
    """
    return good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Texts without a word and rows without doc_id all stay; repeated rows of a doc_id become one.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to the sources' targets: a document is there as often as the mix takes it, 0 to 3 times.

    A null source is a source; texts without a word have size 0 and are taken as often as others of their source.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place; a repeated row is packed each time, an empty text as its end."""
    return packed_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: BagMinHash and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

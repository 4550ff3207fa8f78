"""A corpus pipeline made of the operators in paceline.llm.

Documents without a recognised language go, then all but one of each group of near copies, then those that hold a
benchmark item; what is left is interleaved by source and turned into token shards. Every stage but the last
returns the columns of ``documents``; the order of the mix is the order of its files, which the last stage follows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.chosen_path import one_of_each
from paceline.llm.common import table
from paceline.llm.gru_language import learn_languages, remainder, with_language
from paceline.llm.pfair_mix import interleave, output_names
from paceline.llm.repair import document_index, encode_shards
from paceline.llm.templates import without_leaks
from paceline.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the others teach; texts without letters, or like no language, go."""
    return with_language(docs, learn_languages(docs, remainder() != 1))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: written files hold it from first to last."""
    _, slot, offset = output_names(docs)
    return interleave(docs).orderBy(slot, offset, "doc_id").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the order of the files that ``docs`` was read from (of ``doc_id`` if it was not), and the place
    of each document in them."""
    try:
        name = F.col("_metadata.file_name")
        part = F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long")
        ordered = docs.select("doc_id", "text", part.alias("part"), name.alias("file"), F.col("_metadata.row_index").alias("row"))
        order = ["part", "file", "row"]
    except AnalysisException as error:
        if not (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise
        ordered, order = docs, ["doc_id"]
    path = scratch_path(spark, "token-shards")
    encode_shards(ordered, order=order).write.option("compression", "zstd").parquet(path)
    return document_index(spark, path)


STAGES = [
    ("language", language),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token ids", token_ids),
]

#: The first stage learns a network, which SQL can't express; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

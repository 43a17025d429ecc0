"""From raw documents to packed sequences: identified, deduplicated, without repeats and benchmark passages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of ``documents``; where a text is cut, n_chars follows it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewatch.llm.decontam import decontaminate
from tablewatch.llm.langid import keep_identified, train
from tablewatch.llm.minhash import near_duplicates
from tablewatch.llm.packing import pack_documents
from tablewatch.llm.queries import PIECES, WORD_BPE
from tablewatch.llm.session import written
from tablewatch.llm.suffix import remove_repeats


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose language is not clear, go; repeated rows are judged alike.

    If no row tells a language, all stay. An empty table stays empty; further columns are kept, whatever their names.
    """
    return keep_identified(docs, train(docs, public_tokenizers.path(PIECES)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (similarity 0.8) that with the smallest doc_id stays; rows of one doc_id stay or go together.

    Null and empty texts, and rows without a doc_id, are linked with nothing and stay. An empty table stays empty; further
    columns are kept, whatever their names.
    """
    name = "gone"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte strings that a document with a smaller doc_id has are cut; documents of which nothing is left go.

    Null and empty texts stay, rows without a doc_id lose nothing, rows of one doc_id take nothing from each other. An empty
    table stays empty; further columns are kept, whatever their names.
    """
    return _measured(remove_repeats(docs, length=50))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows are cut; documents half of which is such spans go.

    Rows are judged one by one, so repeated doc_ids and rows without one are too; null and empty texts stay. An empty table
    stays empty; further columns are kept, whatever their names.
    """
    return _measured(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens.

    Null and empty texts are the end id alone, repeated rows and rows without a doc_id are packed like others; pieces of one length
    may swap their places. An empty table gives no rows; further columns are not read.
    """
    return pack_documents(docs, public_tokenizers.path(WORD_BPE), end_id=0, capacity=2048)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The first stage learns a model, so there is no SQL for what comes out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

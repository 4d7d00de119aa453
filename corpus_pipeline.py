"""The corpus pipeline: language ID, quality, exact de-duplication, near
duplicates, packing.

Every stage takes the documents that the stage before it kept and returns the
columns of ``documents``; the last one returns the packed pieces.  ``run``
writes each stage to the shared folder and reads it back for the next.

All stages: rows, not ids, are judged, so a repeated id loses no other row, and rows with a null id
are documents like any other.  Extra columns may have any name and are passed on.  An empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import exactdedup, jaccard, langid, packing, quality
from riskloom.llm.common import numbered, read, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; models are learned from ``lang``.

    A null text and one without letters go, as do texts above their language's threshold; a null
    ``lang`` teaches nothing and does not matter otherwise.  Repeated rows stay or go together."""
    model = langid.fit_documents(docs, F.lit(False))
    rows, own = numbered(docs)
    found = langid.predict(rows, model, own["doc_id"], own["text"], keep=rows.columns)
    return found.where("NOT rejected").select(F.col("doc_id").alias(own["doc_id"]), *[c for c in rows.columns if c != own["doc_id"]]).select(rows.columns).toDF(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, does not reject.

    A null text is scored as an empty one.  Without labels of both classes the score is constant."""
    trees = quality.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    rows, own = numbered(docs)
    found = quality.predict(rows, trees, own["doc_id"], own["text"], keep=rows.columns)
    return found.where("predicted = 1").select(F.col("doc_id").alias(own["doc_id"]), *[c for c in rows.columns if c != own["doc_id"]]).select(rows.columns).toDF(*docs.columns)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of every group of equal texts, one if several have it; a null id is
    larger than any other, null texts equal empty ones."""
    return exactdedup.keep_first(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of linked documents: the smallest id's, one if several have it; a null id is larger
    than any other.  Null texts and texts without words are linked with nothing and stay."""
    rows, own = numbered(docs)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    groups = jaccard.jaccard_groups(rows, "row", own["text"]).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    copied = groups.where("`group` <> row").select("group").distinct()
    members = rows.select("row", F.col(own["doc_id"]).alias("id")).join(groups.join(copied, "group", "left_semi"), "row")
    stays = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("stays"))
    gone = members.join(stays, "group").where("row <> stays").select("row")
    return rows.join(gone, "row", "left_anti").drop("row").toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens.  A null or empty text is its closing id."""
    coder = packing.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, coder)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("quality", good_quality), ("exact_dedup", no_copies), ("near_duplicates", no_near_copies), ("packing", packed)]

#: Language models, boosted trees and tokenisation have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

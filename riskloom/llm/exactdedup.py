"""Exact de-duplication by content sort (DataFrame operations only).

The normalised texts are range-partitioned with splitters that Spark samples
and each partition is sorted externally, so equal texts are neighbours; a window over the
sorted run compares neighbours in full and keeps the smallest id of each run.
Splitters are made of a text's first ``HEAD`` characters and its 64-bit hash, so the sample that the
driver sees has short rows and texts that begin alike still spread; inside a
partition whole texts are sorted and compared.

A text with very many copies would make one run that no range splitter can cut.
A first pass counts 64-bit text hashes (16 bytes a row, combined before the
shuffle).  Texts whose hash has more rows than a quarter of a partition's mean
get a salt from their id as a second sort key; their partial runs (at most a few
per salt) are then merged by full text.  There are at most ``4 * partitions``
such hashes, whatever the input, so broadcasting them is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WHITE, numbered, parallelism, stored


HEAD = 24      # characters of a splitter; whole texts are compared all the same


def normalised(col):
    return F.regexp_replace(F.coalesce(col, F.lit("")), WHITE + "+", " ")


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> tuple[DataFrame, Window, Window]:
    """Rows dealt by content, the window of a run of equal texts, and its order."""
    spark = docs.sparkSession
    parts = parallelism(spark)
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"k_{c}") for c in carried])
    norm = normalised(F.col("_text"))
    counts = stored(own.select(norm.alias("norm")).groupBy(F.xxhash64("norm").alias("_h")).agg(F.count("*").alias("n")))
    # a run longer than a quarter of the mean partition is salted
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(1, total // (4 * parts))
    large = counts.where(F.col("n") > limit).select("_h", F.ceil(F.col("n") / limit).alias("_salts"))
    # fewer than 4 * parts hashes are large: the broadcast is bounded
    runs = (own.withColumn("_norm", norm).withColumn("_h", F.xxhash64("_norm")).withColumn("_head", F.left("_norm", F.lit(HEAD)))
            .join(F.broadcast(large), "_h", "left")
            .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_salts")), F.lit(0))))
    if not carried:
        runs = runs.drop("_text")
    else:
        runs = runs.drop("_norm")
    runs = runs.repartitionByRange(parts, "_head", "_h", "_salt")
    if carried:
        runs = runs.withColumn("_norm", norm)
    run = Window.partitionBy("_head", "_h", "_salt", "_norm")
    return runs, run, run.orderBy(F.col("_id").asc_nulls_last())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty, and empty texts are copies of each other.  The
    smallest id of a group stays; a null id is larger than any other, so a
    group keeps ``null`` only if it has no other id.  Of rows that repeat an
    id and text one is kept.  Extra columns are ignored; an empty table gives
    an empty result.
    """
    runs, run, order = _sorted_runs(docs, id_col, text_col, [])
    large = F.col("_salts").isNotNull()
    marked = stored(runs.withColumn("place", F.row_number().over(order)).withColumn("low", F.first("_id").over(order)).withColumn("n", F.count("*").over(run))
                    .select(F.col("_id").alias("doc_id"), "low", "n", "place", F.col("_salt").alias("salt"), F.sha2("_norm", 256).alias("text_sha256"),
                            F.when(large & (F.col("place") == 1), F.col("_norm")).alias("rep_text"), large.alias("is_large")))
    # the partial runs of each salted text, merged by full text
    merged = (marked.where("is_large AND place = 1").groupBy("rep_text")
              .agg(F.first("text_sha256").alias("text_sha256"), F.min("low").alias("all_low"), F.sum("n").alias("all_n"),
                   F.min_by("salt", F.struct(F.col("low").isNull(), F.col("low"), F.col("salt"))).alias("all_salt"))
              .drop("rep_text"))
    small = marked.where("NOT is_large").select(
        "doc_id", F.col("low").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256")
    # fewer than 4 * partitions hashes were salted: the broadcast is bounded
    salted = marked.where("is_large").join(F.broadcast(merged), "text_sha256").select(
        "doc_id", F.col("all_low").alias("keep_id"), F.col("all_n").alias("group_size"),
        ((F.col("place") == 1) & (F.col("salt") == F.col("all_salt"))).alias("kept"), "text_sha256")
    return small.unionByName(salted)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns, whatever their names.

    Null texts are copies of empty ones; of equal texts the smallest id stays, a null id only if the
    group has no other, and one row if several have that id.  An empty table gives no rows."""
    rows, own = numbered(docs)
    cols = rows.columns
    runs, _, order = _sorted_runs(rows, own[id_col], own[text_col], cols)
    first = runs.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    # salted texts still have one row per salt
    again = Window.partitionBy("_norm").orderBy(F.col("_id").asc_nulls_last(), "_salt")
    merged = first.where("_salts IS NOT NULL").withColumn("_place", F.row_number().over(again)).where("_place = 1")
    both = first.where("_salts IS NULL").unionByName(merged)
    return both.select(*[f"k_{c}" for c in cols]).toDF(*docs.columns)

"""Encoding and scaling fitted on training rows (EN-1 .. EN-4, JN-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import global_index


def fit_labels(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """EN-1: dictionary (column, value, code) -- sorted distinct strings -> 0..k-1.
    Codes come from the balanced index over the distinct (column, value) pairs."""
    vals = None
    for c in cols:
        v = train.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).where("value IS NOT NULL")
        vals = v if vals is None else vals.unionByName(v)
    vals = vals.distinct()
    idx = global_index(vals, ["column", "value"], "gidx")
    first = idx.groupBy("column").agg(F.min("gidx").alias("base"))
    return idx.join(F.broadcast(first), "column").select("column", "value", (F.col("gidx") - F.col("base")).alias("code"))


def apply_labels(df: DataFrame, dictionary: DataFrame, cols: Sequence[str]) -> DataFrame:
    """EN-2 / JN-8: replace each categorical by its code; unseen -> 0.
    The dictionary has one row per category (cardinality-bounded); AQE picks
    broadcast or shuffle from its measured size."""
    out = df
    for c in cols:
        dc = dictionary.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.join(dc, out[c].cast("string") == dc[f"_v_{c}"], "left") \
                 .withColumn(c, F.coalesce(F.col(f"_c_{c}"), F.lit(0)).cast("long")).drop(f"_v_{c}", f"_c_{c}")
    return out


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """EN-3: one row of train means and population stds."""
    return train.agg(*[F.avg(F.col(c).cast("double")).alias(f"{c}__mean") for c in cols],
                     *[F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std") for c in cols])


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    """EN-3: ``(x - mean) / std`` with std 0 -> 1 (one-row broadcast)."""
    out = df.crossJoin(F.broadcast(scaler))
    for c in cols:
        sd = F.col(f"{c}__std")
        out = out.withColumn(c, (F.col(c).cast("double") - F.col(f"{c}__mean")) /
                             F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd))
    return out.drop(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols])

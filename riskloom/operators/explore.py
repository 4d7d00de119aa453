"""Exploration aggregates (AG-5 .. AG-7, AG-9 .. AG-15, AG-23, SO-15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import quantiles


def risk_by(df: DataFrame, key: str, min_count: int = 0, top: int | None = None, label: str = "fraud_label",
            amount: str = "claim_amount") -> DataFrame:
    """AG-9 / AG-10 / AG-11: label rate, volume and amount per key; HAVING
    count >= ``min_count``; optionally the top n by rate (key breaks ties)."""
    g = df.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("fraud_rate"),
                            F.count(F.lit(1)).alias("n_claims"), F.sum(amount).alias("total_amount"))
    g = g.where(F.col("n_claims") >= min_count)
    if top:
        g = g.orderBy(F.col("fraud_rate").desc(), F.col(key)).limit(top)
    return g


def label_counts(df: DataFrame, label: str = "fraud_label") -> DataFrame:
    """AG-12."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "fraud_label") -> DataFrame:
    """AG-23: balanced weights N / (2 * N_c) per class (small table; join it to get a weight column)."""
    c = label_counts(df, label)
    tot = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(tot)).select(label, "n", (F.col("total") / (F.lit(2.0) * F.col("n"))).alias("weight"))


def class_histogram(df: DataFrame, col: str, bins: int = 20, label: str = "fraud_label") -> DataFrame:
    """AG-14: per-class density histogram over the common [min, max] range
    (equal-width bins, last bin closed); density = count / (n_class * width)."""
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    x = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(st))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("lo")) / width), F.lit(bins - 1)))
    g = x.groupBy(label, b.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    nc = df.where(F.col(col).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    w = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / bins)
    return g.join(nc, label).select(label, "bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"), "n",
                                    (F.col("n") / (F.col("n_class") * w)).alias("density"))


def class_boxplot(df: DataFrame, col: str, label: str = "fraud_label") -> DataFrame:
    """AG-15: five-number summary per class (exact linear quantiles)."""
    v = df.select(label, F.col(col).cast("double").alias(col))
    return quantiles(v, col, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, [label])


def entity_stats_with_distinct(df: DataFrame, key: str, other: str, prefix: str, amount: str = "claim_amount",
                               flag: str | None = None) -> DataFrame:
    """AG-5 / AG-6: count, sum, mean, max, exact distinct counterparts and a flag rate."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_claims"), F.sum(amount).alias(f"{prefix}_total"),
            F.avg(amount).alias(f"{prefix}_mean"), F.max(amount).alias(f"{prefix}_max"),
            F.count_distinct(other).alias(f"{prefix}_distinct_{other}")]
    if flag:
        aggs.append(F.avg(F.col(flag).cast("double")).alias(f"{prefix}_{flag}_rate"))
    return df.groupBy(key).agg(*aggs)


def role_counts(df: DataFrame, roles: Sequence[str], counted: DataFrame | None = None) -> DataFrame:
    """AG-7: per row, how many rows share its value of each role column (null -> 0).
    A group-by count joined back (AQE sizes the join), not a per-key window.
    ``counted``: the same rows with fewer joins behind them; their values are few beside the rows, and broadcast."""
    out = df
    for r in roles:
        c = (df if counted is None else counted).where(F.col(r).isNotNull()).groupBy(r).agg(F.count(F.lit(1)).alias(f"{r}_count"))
        out = out.join(c if counted is None else F.broadcast(c), r, "left").withColumn(f"{r}_count", F.coalesce(F.col(f"{r}_count"), F.lit(0)))
    return out


def table_fingerprint(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """SO-15 re-aimed: order-insensitive fingerprint -- row count and sum of the
    first 32 bits of the md5 of every row's key (one aggregation)."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("long").alias("hash_sum"))

"""WN-1 temporal split and AG-16 split rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.ordering import global_index, materialize


def temporal_split(df: DataFrame, date_col: str, key_col: str, fracs: Sequence[float] = (0.60, 0.80),
                   names: Sequence[str] = ("train", "val", "test"), out_col: str = "split") -> DataFrame:
    """Order by (date, key); the first ``int(f0*n)`` rows are ``names[0]``, up to
    ``int(f1*n)`` ``names[1]``, the rest ``names[2]``.

    No global sort of the data:
      * per-date counts (a partial aggregate, one row per calendar day) get
        running totals on that small table, so each date knows its first position;
      * a date that lies wholly on one side of every cut is labelled from its
        date row alone (the stored day table is broadcast);
      * only the rows of the (at most two) dates that straddle a cut get an
        exact position, via the range-partitioned index -- balanced even if
        such a date holds a third of all rows.

    The day table and the straddling rows are stored, so readers of the result
    need no shuffle and ``df`` is read in place.
    """
    f0, f1 = float(fracs[0]), float(fracs[1])
    # One row per calendar day: the day table is bounded by the date range, not
    # by the data, so its running totals use a plain window on that small table.
    days = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("_d_n"))
    wd = Window.orderBy(date_col)
    days = days.select(
        date_col, "_d_n",
        (F.sum("_d_n").over(wd.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_d_n"))
        .alias("_first"),
        F.sum("_d_n").over(wd.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    days = days.withColumn("_c1", F.floor(F.lit(f0) * F.col("_n"))) \
        .withColumn("_c2", F.floor(F.lit(f1) * F.col("_n"))) \
        .withColumn("_last", F.col("_first") + F.col("_d_n") - 1)

    def label(pos):
        return (F.when(pos < F.col("_c1"), F.lit(names[0]))
                 .when(pos < F.col("_c2"), F.lit(names[1]))
                 .otherwise(F.lit(names[2])))

    # a date is whole when its first and last positions get the same label
    days = days.withColumn("_day_label",
                           F.when(label(F.col("_first")) == label(F.col("_last")), label(F.col("_first"))))
    days = materialize(days)
    day_info = days.select(date_col, "_first", "_c1", "_c2", "_day_label")

    tagged = df.join(F.broadcast(day_info), date_col, "left")
    whole = tagged.where(F.col("_day_label").isNotNull()) \
                  .withColumn(out_col, F.col("_day_label"))

    straddle = tagged.where(F.col("_day_label").isNull())
    # rows of straddling dates before this date, among straddling dates only (<= 2 rows table)
    sdays = days.where(F.col("_day_label").isNull()).select(date_col, "_d_n")
    wsd = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, -1)
    sdays = sdays.select(date_col, F.coalesce(F.sum("_d_n").over(wsd), F.lit(0)).alias("_sb"))
    idx = global_index(straddle, [F.col(date_col), F.col(key_col)], "_i") \
        .join(F.broadcast(sdays), date_col) \
        .withColumn("_pos", F.col("_first") + F.col("_i") - F.col("_sb"))
    straddle = idx.withColumn(out_col, label(F.col("_pos")))

    keep = df.columns + [out_col]
    return whole.select(*keep).unionByName(materialize(straddle.select(*keep)))


def split_rates(df: DataFrame, label_col: str = "fraud_label", split_col: str = "split") -> DataFrame:
    """AG-16: rows and label rate per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_claims"),
                                     F.avg(F.col(label_col).cast("double")).alias("fraud_rate"))

"""Exact order-dependent computations without a global window.

A single ``Window.orderBy`` would pull a whole group into one task, and the exact
``percentile`` aggregate merges a full value->count map in one task.  The
primitive here is a two-level prefix sum, the same at every size:

1. range-partition rows by (group, order) -- the partition number is an
   order-preserving bucket id, sampling keeps buckets balanced, and adaptive
   execution merges small ones;
2. bucket totals per group: one row per (group, bucket) that occurs, prefix
   summed by a window per group;
3. running sums inside each bucket: a window per (group, bucket), so no task
   holds more than one bucket.

Everything else -- exact quantiles, k-th order statistics, row positions,
ROC/PR curves, KS statistics, lags and rolling frames -- is built on top.  Inputs
should be compressed first (e.g. ``groupBy(value).count()``) so repeated values
cost one row.  The bucket table grows with the number of groups, so it is joined
on (group, bucket) without a hint: the rows are already dealt by these keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.session import derived_path

_BUCKET = "_rl_bucket"
_KEY = "_rl_key"


def materialize(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Cut lineage where a result fans out to several consumers.

    The result is written once as a Parquet table under the shared folder
    named by ``spark.checkpoint.dir`` and read back: it survives executor loss,
    later plans start from a file scan with column pruning and filter pushdown,
    and the upstream is computed exactly once.  ``session.drop_derived_tables``
    deletes these tables; it also runs when the driver's Python ends.  ``rows_per_file``
    (0: no bound) cuts large files, so that more tasks than wrote the table can read it.
    """
    path = derived_path(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.parquet(path)


def _columns(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _key(group_cols: Sequence[str]) -> Column:
    """The group as one non-null value: null groups are groups like any other."""
    return F.struct(*group_cols) if group_cols else F.struct(F.lit(0).alias("all"))


def _bucketed(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], n_buckets: int | None) -> DataFrame:
    """Rows with their group key and bucket.  Range bounds come from sampling, and
    a sample drawn again may give other bounds; the bucket ids are therefore
    stored once, so every branch sees the same assignment."""
    by = [*_columns(group_cols), *order_cols]
    dealt = df.repartitionByRange(n_buckets, *by) if n_buckets else df.repartitionByRange(*by)
    return materialize(dealt.withColumn(_BUCKET, F.spark_partition_id())).withColumn(_KEY, _key(group_cols))


def _bucket_totals(part: DataFrame, sum_cols: Sequence[str], last: Column | None = None) -> DataFrame:
    """Per (group, bucket): totals, the sums of all buckets before, and the group's sums."""
    aggs = [F.sum(c).alias(f"_tot_{c}") for c in sum_cols]
    tot = part.groupBy(_KEY, _BUCKET).agg(*aggs, *([last] if last is not None else []))
    w = Window.partitionBy(_KEY).orderBy(_BUCKET)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return tot.select("*", *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
                      *[F.sum(f"_tot_{c}").over(whole).alias(f"_all_{c}") for c in sum_cols])


def running_totals(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                   sum_cols: Sequence[str], prefix: str = "cum_", n_buckets: int | None = None,
                   totals: str | None = None) -> DataFrame:
    """Add inclusive running sums ``{prefix}{c}`` of ``sum_cols`` in ``order_cols`` order per group,
    and with ``totals`` the group's sums ``{totals}{c}``.

    ``order_cols`` must order rows totally within a group (ties would make the
    running sum depend on the physical order).
    """
    order = _columns(order_cols)
    part = _bucketed(df, group_cols, order, n_buckets)
    buckets = _bucket_totals(part, sum_cols).drop(*[f"_tot_{c}" for c in sum_cols])
    w = Window.partitionBy(_KEY, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = part.select("*", *[F.sum(c).over(w).alias(f"_in_{c}") for c in sum_cols])
    out = within.join(buckets, [_KEY, _BUCKET])
    return out.select(*df.columns, *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(f"{prefix}{c}") for c in sum_cols],
                      *[F.col(f"_all_{c}").alias(f"{totals}{c}") for c in sum_cols if totals])


def global_index(df: DataFrame, order_cols: Sequence[Column | str], name: str = "idx",
                 n_buckets: int | None = None) -> DataFrame:
    """0-based position of every row in ``order_cols`` order (must be a total order)."""
    one = "_rl_one"
    out = running_totals(df.withColumn(one, F.lit(1).cast("long")), [], order_cols, [one], n_buckets=n_buckets)
    return out.withColumn(name, F.col(f"cum_{one}") - 1).drop(one, f"cum_{one}")


def _value_ranks(df: DataFrame, value_col: str, group_cols: Sequence[str], n_buckets: int | None) -> DataFrame:
    """One row per (group, distinct non-null value): rank of its first copy
    ``_first`` and of the one after its last ``_end``, and the group's size ``n``."""
    vc = materialize(df.where(F.col(value_col).isNotNull()).groupBy(*group_cols, F.col(value_col).alias("_v"))
                     .agg(F.count(F.lit(1)).alias("_c")))
    rt = running_totals(vc, group_cols, ["_v"], ["_c"], prefix="_cum", n_buckets=n_buckets, totals="_all")
    return rt.select(*group_cols, "_v", (F.col("_cum_c") - F.col("_c")).alias("_first"), F.col("_cum_c").alias("_end"), F.col("_all_c").alias("n"))


def _at(rank: Column, value: Column) -> Column:
    """The value that covers ``rank`` (one row of a group does)."""
    return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_end")), value))


def _per_group(df: DataFrame, group_cols: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def quantiles(df: DataFrame, value_col: str, probs: dict[str, float], group_cols: Sequence[str] = (),
              n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy/pandas default, SQL
    ``quantile_cont``) per group, one double column per entry of ``probs``:
    ``lo + (hi - lo) * frac`` between the neighbouring order statistics.

    Without ``group_cols`` there is always one row (nulls if the column has no
    values); groups without values have no row.  One aggregation with
    map-side combining reads all ranks.
    """
    rows = _value_ranks(df, value_col, group_cols, n_buckets)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("n") - 1).cast("double") * F.lit(float(p))
        value = F.col("_v").cast("double")
        aggs += [_at(F.floor(pos), value).alias(f"_lo_{name}"), _at(F.ceil(pos), value).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_fr_{name}")]
    got = _per_group(rows, group_cols, aggs)
    return got.select(*group_cols, *[(F.col(f"_lo_{p}") + (F.col(f"_hi_{p}") - F.col(f"_lo_{p}")) * F.col(f"_fr_{p}")).alias(p) for p in probs])


def kth_values(df: DataFrame, value_col: str, ranks: dict[str, Column], group_cols: Sequence[str] = (),
               n_buckets: int | None = None) -> DataFrame:
    """k-th order statistics with k given as an expression of the group size ``n``.

    Example: ``{"q1": F.floor(F.col("n") / 4)}`` is ``sorted(x)[len(x)//4]``.
    Returns group_cols, ``n`` and one column per rank, of the value's own type.
    Without ``group_cols`` there is always one row (``n`` 0 and nulls if the column has no values).
    """
    rows = _value_ranks(df, value_col, group_cols, n_buckets)
    aggs = [F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n")]
    aggs += [_at(expr.cast("long"), F.col("_v")).alias(name) for name, expr in ranks.items()]
    return _per_group(rows, group_cols, aggs)


def rolling_rows(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], value_col: str,
                 k: int, n_buckets: int | None = None) -> DataFrame:
    """Trailing ``k``-row frame statistics per group in (order_cols) order:
    ``roll_n`` (rows in frame), ``roll_mean``, ``roll_std`` (sample).

    Rows are range-bucketed by (group, order); every bucket also receives the
    ``k - 1`` rows before its first one (a halo), so a window over (group,
    bucket) sees complete frames while each task holds one bucket.  Each bucket
    asks for its halo by position, so the halo has at most ``k - 1`` rows per bucket.
    """
    one, idx = "_rl_one", "_rl_idx"
    part = _bucketed(df.withColumn(one, F.lit(1).cast("long")), group_cols, _columns(order_cols), n_buckets)
    buckets = _bucket_totals(part, [one])
    w = Window.partitionBy(_KEY, _BUCKET).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = part.withColumn("_in", F.sum(one).over(w)).join(buckets, [_KEY, _BUCKET]) \
        .withColumn(idx, F.col(f"_off_{one}") + F.col("_in") - 1) \
        .withColumn("_to_end", F.col(f"_tot_{one}") - F.col("_in"))
    rows = rows.select(*part.columns, idx, "_to_end")
    # positions that a bucket needs from the buckets before it
    first = F.col(f"_off_{one}")
    asked = buckets.where(first > 0).select(_KEY, F.col(_BUCKET).alias("_target"), F.explode(F.sequence(F.greatest(first - (k - 1), F.lit(0).cast("long")), first - 1)).alias(idx)) \
        if k > 1 else buckets.where(F.lit(False)).select(_KEY, F.col(_BUCKET).alias("_target"), first.alias(idx))
    halo = rows.where(F.col("_to_end") < k - 1).join(asked, [_KEY, idx]).withColumn(_BUCKET, F.col("_target")).withColumn("_halo", F.lit(True))
    both = rows.withColumn("_halo", F.lit(False)).unionByName(halo.select(*rows.columns, "_halo"))
    frame = Window.partitionBy(_KEY, _BUCKET).orderBy(idx).rowsBetween(-(k - 1), 0)
    out = both.select("*", F.count(value_col).over(frame).alias("roll_n"), F.avg(value_col).over(frame).alias("roll_mean"),
                      F.stddev_samp(value_col).over(frame).alias("roll_std"))
    return out.where(~F.col("_halo")).select(*df.columns, "roll_n", "roll_mean", "roll_std")


def with_previous(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], cols: Sequence[str],
                  prefix: str = "prev_", n_buckets: int | None = None) -> DataFrame:
    """``lag`` without a per-group window: inside (group, bucket) by a window, and a
    bucket's first row gets the last row of the group's bucket before it.  A hot
    group is spread over many tasks."""
    part = _bucketed(df, group_cols, _columns(order_cols), n_buckets)
    tail = F.max_by(F.struct(*cols), F.struct(*order_cols)).alias("_tail")
    buckets = _bucket_totals(part, [], tail).select(_KEY, _BUCKET, F.lag("_tail").over(Window.partitionBy(_KEY).orderBy(_BUCKET)).alias("_before"))
    w = Window.partitionBy(_KEY, _BUCKET).orderBy(*order_cols)
    rows = part.withColumn("_lag", F.lag(F.struct(*cols)).over(w)).join(buckets, [_KEY, _BUCKET])
    return rows.withColumn("_prev", F.coalesce("_lag", "_before")).select(*df.columns, *[F.col("_prev")[c].alias(prefix + c) for c in cols])


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str], k: int,
                    salts: int = 16, rank_col: str = "rank") -> DataFrame:
    """Top ``k`` rows per group in ``order_cols`` order (a total order within
    the group), without handing a hot group to one task: rows are first cut
    to the top ``k`` per (group, salt) -- the salt is a hash of the row --
    then ranked again per group on at most ``salts * k`` survivors."""
    group_cols = list(group_cols)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    salted = df.withColumn("_rl_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "_rl_salt").orderBy(*order)
    first = salted.withColumn("_rl_r", F.row_number().over(w1)).where(F.col("_rl_r") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return first.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k) \
                .drop("_rl_salt", "_rl_r")

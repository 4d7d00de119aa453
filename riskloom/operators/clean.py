"""Cleaning and row-level feature operators (PR-1 .. PR-25)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.ordering import quantiles


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """PR-1: one row per key, the first by ``order`` (deterministic).

    Implemented as ``min(struct(order..., rest...))`` per key: a partial +
    final aggregate, so a key holding a third of all rows is collapsed on the
    map side instead of landing whole in one task (a ``row_number`` window
    would buffer it).
    """
    keys = list(keys)
    order = list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order + rest])


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PR-2: fill numeric nulls with the column median (exact, linear interpolation).

    The medians come from the distributed exact-quantile operator (always one
    row: a column without values stays null), then a one-row broadcast + ``coalesce``.
    """
    out = df
    for c in cols:
        med = quantiles(df, c, {"m": 0.5}).select(F.col("m").alias(f"_med_{c}"))
        out = out.crossJoin(F.broadcast(med)) \
                 .withColumn(c, F.coalesce(F.col(c), F.col(f"_med_{c}").cast(df.schema[c].dataType))) \
                 .drop(f"_med_{c}")
    return out


def impute_mode(df: DataFrame, cols: Sequence[str], default: str = "Unknown") -> DataFrame:
    """PR-3: fill categorical nulls with the most frequent value (smallest on ties),
    or ``default`` when the column has no values.

    ``groupBy(value).count`` is a partial aggregate; the winner is one
    ``max_by`` over the (distinct-values sized) counts, broadcast as one row.
    """
    out = df
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        # highest count first, then smallest value: maximise (n, -rank(value)) via struct ordering
        mode = counts.agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col(c).alias("v"))).alias("m")) \
                     .select(F.col("m.v").alias(f"_mode_{c}"))
        out = out.crossJoin(F.broadcast(mode)) \
                 .withColumn(c, F.coalesce(F.col(c), F.col(f"_mode_{c}"), F.lit(default))) \
                 .drop(f"_mode_{c}")
    return out


def to_num(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """PR-5: numeric coercion, bad or absent -> ``default``."""
    if name not in df.columns:
        return F.lit(default).cast("double")
    return F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(default))


def nonnull_count(df: DataFrame, prefix: str, n: int) -> Column:
    """PR-6: non-null values among the columns ``{prefix}1`` .. ``{prefix}n`` that exist."""
    cols = [c for c in (f"{prefix}{i}" for i in range(1, n + 1)) if c in df.columns]
    if not cols:
        return F.lit(0)
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))


def day_diff(end: Column, start: Column) -> Column:
    """PR-7: day difference, null -> 0, clipped at 0."""
    return F.greatest(F.coalesce(F.datediff(end, start), F.lit(0)), F.lit(0))


def stay_days(stay: Column, duration: Column) -> Column:
    """PR-8: admission stay when positive, else the claim duration."""
    return F.when(stay > 0, stay).otherwise(duration)


def flag_in(col: Column, values: Sequence) -> Column:
    """PR-10: 1 when the value is in the set, else 0 (null -> 0)."""
    return F.coalesce(col.isin(*values), F.lit(False)).cast("int")


def chronic_count(df: DataFrame, prefix: str = "ChronicCond_") -> Column:
    """PR-11: number of family columns equal to 1 (after numeric coercion)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    if not cols:
        return F.lit(0)
    return sum((F.coalesce(F.col(c).cast("string").try_cast("double") == 1, F.lit(False)).cast("int")
                for c in cols), F.lit(0))


def same_physician(a: Column, b: Column) -> Column:
    """PR-13: attending equals operating, two nulls counting as equal."""
    return a.eqNullSafe(b).cast("int")


def ratio_to_avg(x: Column, avg: Column) -> Column:
    """PR-14/PR-15: ``x / (avg + 1)``."""
    return x / (avg + F.lit(1.0))


def calendar_features(date: Column, prefix: str = "claim_") -> list[Column]:
    """PR-16/PR-25: month, weekday with Monday = 0, day of month."""
    return [F.month(date).alias(f"{prefix}month"),
            F.weekday(date).alias(f"{prefix}dayofweek"),
            F.dayofmonth(date).alias(f"{prefix}day")]


def finite_or_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PR-18: +-inf and NaN -> null -> 0 over the listed columns."""
    fixes = {}
    for c in cols:
        x = F.col(c).cast("double")
        fixes[c] = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0)).otherwise(x)
    return df.withColumns(fixes)


# Claim validity bounds (PR-20) -- fixed values of the request schema.
CLAIM_RULES = (
    ("claim_id", "non_empty", None, None),
    ("claim_amount", "range", 0.0, 10_000_000.0),
    ("num_procedures", "range", 0, 100),
    ("days_in_hospital", "range", 0, 365),
    ("age", "range", 0, 150),
)


def validate_claims(df: DataFrame, rules=CLAIM_RULES) -> DataFrame:
    """PR-20: per-row list of rule violations as ``errors array<string>`` (+ ``is_valid``).

    Rules on absent columns are skipped (resolved against the schema at plan time).
    """
    checks = []
    for col, kind, lo, hi in rules:
        if col not in df.columns:
            continue
        c = F.col(col)
        if kind == "non_empty":
            bad = c.isNull() | (F.length(F.trim(c.cast("string"))) == 0)
            checks.append(F.when(bad, F.lit(f"{col}: must be non-empty")))
        else:
            bad = c.isNull() | (c < F.lit(lo)) | (c > F.lit(hi))
            checks.append(F.when(bad, F.lit(f"{col}: must be within [{lo}, {hi}]")))
    errors = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def cap_batch(df: DataFrame, n: int = 1000) -> DataFrame:
    """PR-21: the request-batch cap; a batch larger than ``n`` is rejected as a whole.

    Returns ``df`` with ``batch_ok`` so the caller can split accepted and
    rejected batches without dropping rows silently.
    """
    size = df.agg(F.count(F.lit(1)).alias("_batch_n"))
    return df.crossJoin(F.broadcast(size)).withColumn("batch_ok", F.col("_batch_n") <= n).drop("_batch_n")


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """PR-22: missing attributes get defaults; absent columns are added as literals."""
    out = df
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v))
    return out


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PR-23: select the trained feature order; absent -> 0.0."""
    return df.select(*keep, *[(F.col(n).cast("double") if n in df.columns else F.lit(0.0)).alias(n)
                              for n in names])


def map_schema(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PR-24: rename columns between two claim layouts (absent names ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PR-17: drop ids/dates/codes, ignoring names that are absent."""
    return df.drop(*[c for c in cols if c in df.columns])


def with_nulls(col: str, key: Column, every: int) -> Column:
    """Deterministic dirt for tests/queries: null when ``pmod(key, every) = 0``."""
    return F.when(F.pmod(key, F.lit(every)) == 0, F.lit(None)).otherwise(F.col(col))


DOUBLE = T.DoubleType()

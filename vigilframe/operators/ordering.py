"""Order-dependent columns that never need one task per group.

Ranks, running sums, neighbour values and quantiles depend on the order of all rows
of a group, and one group may hold a third of the table. Every helper here therefore
deals rows into ranges of the real order columns, works inside (group, range), and
carries the small per-range totals on. The ranges are Spark's own, so every type and
NULL, NaN and infinity lie as the sort puts them. Inputs whose tables are small take
the plain per-group window instead, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import BUCKET_TARGET_BYTES, SINGLE_TASK_BYTES, input_bytes, materialize

BUCKET = "__bucket"
MIN_BUCKETS = 8
# Beyond this many, buckets grow instead (1 GB each at 100 TB): the ranges are found from a sample per bucket.
MANY_BUCKETS = 100_000
# Per-key tables of counted size up to this go to every executor.
SMALL_ROWS = 1_000_000
SALTS = 64


def order_hash(seed: object, *cols: str | Column) -> Column:
    """Seeded pseudo-random order key, stable across runs and engines."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def auto_buckets(df: DataFrame, keyed: bool) -> int:
    """1 for inputs small enough for a plain window, else a bucket count by table size."""
    size = input_bytes(df)
    if size is None:
        return 256
    if size <= (BUCKET_TARGET_BYTES if keyed else min(SINGLE_TASK_BYTES, BUCKET_TARGET_BYTES)):
        return 1
    return min(max(2 * math.ceil(size / BUCKET_TARGET_BYTES), MIN_BUCKETS), MANY_BUCKETS)


def settle(df: DataFrame, keyed: bool, buckets: int | None = None) -> DataFrame:
    """Write a derived table down before a bucketed helper reads it several times."""
    n = buckets if buckets is not None else auto_buckets(df, keyed)
    return materialize(df, "settled") if n > 1 else df


def _parse(order: Sequence[str]) -> list[tuple[str, bool]]:
    """``"col"`` or ``"-col"`` to (name, ascending)."""
    return [(o[1:], False) if o.startswith("-") else (o, True) for o in order]


def order_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in _parse(order)]


def with_bucket(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Add a bucket number that is monotone in the order, and settle the table.

    Buckets are ranges of the whole order tuple, so a heavy first column is split by the next ones. Rows that tie in
    all order columns share a bucket.
    """
    dealt = df.repartitionByRange(n, *order_columns(order))
    return materialize(dealt.withColumn(BUCKET, F.spark_partition_id().cast("long")), "ranges")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches NULL keys and keeps the left key columns."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def _plan(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int | None):
    n = buckets if buckets is not None else auto_buckets(df, bool(keys))
    if n <= 1:
        return df, list(keys) or [F.lit(0)], False
    return with_bucket(df, order, n), [*keys, BUCKET], True


def _over_buckets(keys: Sequence[str]):
    """Window over the per-bucket totals (at most a few thousand rows per key)."""
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    size_name: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """0-based position of each row inside its group, and optionally the group size."""
    work, local, split = _plan(df, keys, order, buckets)
    rank = F.row_number().over(Window.partitionBy(*local).orderBy(*order_columns(order))) - 1
    ranked = work.withColumn(name, rank.cast("long"))
    if not split:
        return ranked.withColumn(size_name, F.count(F.lit(1)).over(Window.partitionBy(*local))) if size_name else ranked
    totals = work.groupBy(*local).agg(F.count(F.lit(1)).alias("__n"))
    before = _over_buckets(keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *local,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        *([F.sum("__n").over(_over_buckets(keys)).alias(size_name)] if size_name else []),
    )
    out = _null_safe(ranked, offsets, local).withColumn(name, F.col(name) + F.col("__offset"))
    return out.drop(BUCKET, "__offset")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], buckets: int | None = None
) -> DataFrame:
    """Inclusive running sums ``{new column: summed column}`` in order."""
    work, local, split = _plan(df, keys, order, buckets)
    w = Window.partitionBy(*local).orderBy(*order_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = work.withColumns({new: F.sum(col).over(w) for new, col in sums.items()})
    if not split:
        return out
    totals = work.groupBy(*local).agg(*[F.sum(col).alias(f"__t_{new}") for new, col in sums.items()])
    before = _over_buckets(keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *local, *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__o_{new}") for new in sums]
    )
    out = _null_safe(out, offsets, local)
    return out.withColumns({new: F.col(new) + F.col(f"__o_{new}") for new in sums}).drop(
        BUCKET, *[f"__o_{new}" for new in sums]
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, name: str, buckets: int | None = None
) -> DataFrame:
    """Value of the preceding row, across bucket borders."""
    work, local, split = _plan(df, keys, order, buckets)
    w = Window.partitionBy(*local).orderBy(*order_columns(order))
    if not split:
        return work.withColumn(name, F.lag(col).over(w))
    out = work.withColumn(name, F.lag(F.struct(F.col(col).alias("v"))).over(w))
    last = work.groupBy(*local).agg(_last_of(F.struct(F.col(col).alias("v")), order).alias("__last"))
    carry = last.select(*local, F.lag("__last").over(_over_buckets(keys).orderBy(BUCKET)).alias("__carry"))
    out = _null_safe(out, carry, local)
    return out.withColumn(name, F.coalesce(F.col(name), F.col("__carry"))["v"]).drop(BUCKET, "__carry")


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, name: str, buckets: int | None = None
) -> DataFrame:
    """Latest non-null value at or before each row (forward fill)."""
    work, local, split = _plan(df, keys, order, buckets)
    w = Window.partitionBy(*local).orderBy(*order_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = work.withColumn(name, F.last(col, ignorenulls=True).over(w))
    if not split:
        return out
    known = work.where(F.col(col).isNotNull())
    tail = known.groupBy(*local).agg(_last_of(F.col(col), order).alias("__last"))
    spine = work.groupBy(*local).agg(F.count(F.lit(1)).alias("__rows"))
    before = _over_buckets(keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = _null_safe(spine, tail, local).select(
        *local, F.last("__last", ignorenulls=True).over(before).alias("__carry")
    )
    out = _null_safe(out, carry, local)
    return out.withColumn(name, F.coalesce(F.col(name), F.col("__carry"))).drop(BUCKET, "__carry")


def _last_of(value: Column, order: Sequence[str]) -> Column:
    """Value of the row that comes last in an order of one direction."""
    parsed = _parse(order)
    key = F.struct(*[F.col(c) for c, _ in parsed])
    if all(asc for _, asc in parsed):
        return F.max_by(value, key)
    if not any(asc for _, asc in parsed):
        return F.min_by(value, key)
    raise ValueError("mixed sort directions are not supported here")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: dict[str, float],
    buckets: int | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key; NULL values are ignored.

    Small inputs use the built-in aggregate. Large ones collapse to distinct values and
    pick the two order statistics by running counts, so no task holds a whole group.
    """
    v = F.col(value) if isinstance(value, str) else value
    n = buckets if buckets is not None else auto_buckets(df, True)
    if n <= 1:
        names = list(probs)
        grouped = df.groupBy(*keys).agg(F.percentile(v, [float(probs[k]) for k in names]).alias("__q"))
        return grouped.select(*keys, *[F.col("__q")[i].alias(k) for i, k in enumerate(names)])
    counts = (
        df.select(*keys, v.cast("double").alias("__v"))
        .where(F.col("__v").isNotNull())
        .groupBy(*keys, "__v")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    picked = counted_quantiles(settle(counts, True, n), keys, "__v", "__c", probs, buckets=n)
    if keys:  # a key without a value keeps its row
        picked = _null_safe(df.select(*keys).distinct(), picked, keys)
    return picked


def counted_quantiles(
    counts: DataFrame, keys: Sequence[str], value: str, count: str, probs: dict[str, float], buckets: int | None = None
) -> DataFrame:
    """The same quantiles from different values and how often each stands."""
    cum = running_sums(counts, keys, [value], {"__upto": count}, buckets=buckets)
    totals = counts.groupBy(*keys).agg(F.sum(count).alias("__n"))
    joined = _null_safe(cum, totals, keys) if keys else cum.join(F.broadcast(totals))
    start = F.col("__upto") - F.col(count)
    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("__n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((start <= rank) & (rank < F.col("__upto")), F.col(value))).alias(f"{name}__{side}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"{name}__frac"))
    picked = joined.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"{k}__lo") + (F.col(f"{k}__hi") - F.col(f"{k}__lo")) * F.col(f"{k}__frac")).alias(k)
            for k in probs
        ],
    )


def wide_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    probs: dict[str, float],
    buckets: int | None = None,
) -> DataFrame:
    """Quantiles of several values per key in one pass, as columns ``<value>_<prob name>``."""
    n = buckets if buckets is not None else auto_buckets(df, True)
    if n <= 1:
        names = list(probs)
        ps = [float(probs[k]) for k in names]
        grouped = df.groupBy(*keys).agg(*[F.percentile(v, ps).alias(f"__q_{k}") for k, v in values.items()])
        return grouped.select(
            *keys, *[F.col(f"__q_{k}")[i].alias(f"{k}_{q}") for k in values for i, q in enumerate(names)]
        )
    items = F.array(*[F.struct(F.lit(k).alias("__name"), v.cast("double").alias("__value")) for k, v in values.items()])
    long = df.select(*keys, F.inline(items))
    q = quantiles(long, [*keys, "__name"], "__value", probs, buckets=n)
    return q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__name") == k, F.col(p))).alias(f"{k}_{p}") for k in values for p in probs]
    )


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, name: str = "rank"
) -> DataFrame:
    """First k rows per key; the row limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order_columns(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Public name of the null-safe equi-join."""
    return _null_safe(left, right, keys, how)


def match_small(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join rows to a per-key table so that no key's rows meet in one task.

    Where the rows are few, Spark chooses. Else the per-key table is written and counted: it goes to every executor if
    it is small, and otherwise it is repeated under salts that the rows are dealt over.
    """
    if auto_buckets(left, True) <= 1:
        return _null_safe(left, right, keys, how)
    right = materialize(right, "per-key")
    if right.count() <= SMALL_ROWS:
        return _null_safe(left, F.broadcast(right), keys, how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return _null_safe(salted, spread, [*keys, "__salt"], how).drop("__salt")

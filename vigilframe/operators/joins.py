"""As-of, interval and dimension joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.config import is_small, materialize
from vigilframe.functions import fixed
from vigilframe.functions.text import column_key
from vigilframe.operators.ordering import last_known


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ts: str,
    right_order: str,
    columns: Sequence[str],
    buckets: int | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before it, one output row per left row.

    Both sides go into one ordered stream and the right payload is carried forward, so
    there is one shuffle on (key, time bucket) and no range join.
    """
    lcols = [c for c in left.columns if c not in (key, ts)]
    lhs = left.select(
        key, ts, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[right_order].dataType).alias("__ord"),
        F.struct(*lcols).alias("__left"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("__right"),
    )
    rhs = right.select(
        key, ts, F.lit(0).alias("__side"), F.col(right_order).alias("__ord"),
        F.lit(None).cast(lhs.schema["__left"].dataType).alias("__left"), F.struct(*columns).alias("__right"),
    )
    merged = lhs.unionByName(rhs)
    carried = last_known(merged, [key], [ts, "__side", "__ord"], "__right", "__found", buckets=buckets)
    return carried.where(F.col("__side") == 1).select(key, ts, "__left.*", *[F.col(f"__found.{c}").alias(c) for c in columns])


# Sizes of dyadic cells: a cell of level n is 2^n units wide.
LEVELS = 48


def dyadic_cells(first: Column, last: Column) -> Column:
    """The fewest aligned cells (level, cell) that together are the units ``first`` to ``last``: at most two of a level."""
    cells = []
    for n in range(LEVELS):
        width = 1 << n
        low, high = F.floor((first + (width - 1)) / F.lit(width)), F.floor((last + 1) / F.lit(width))
        cell = lambda c, n=n: F.struct(F.lit(n).alias("level"), c.cast("long").alias("cell"))
        cells.append(F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), cell(low)))
        cells.append(F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), cell(high - 1)))
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


def interval_join(
    records: DataFrame,
    schedule: DataFrame,
    key: str,
    ts: str,
    start: str,
    end: str,
    how: str = "left",
    bucket_width: float | None = None,
) -> DataFrame:
    """Records with the intervals of their entity that hold them, closed-open.

    A small schedule joins on the entity with the range as residual. Of a large one each interval becomes a few cells of
    doubling width (``bucket_width`` is the narrowest, by default the median length), so an interval costs the logarithm
    of its length. A record looks up one cell of each width that the schedule uses, and meets an interval in one of them.
    """
    inside = (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))
    sched = schedule.withColumnRenamed(key, "__key")
    if bucket_width is None and is_small(schedule):
        # the optimizer's estimate proves this side small
        return records.join(F.broadcast(sched), (F.col(key) == F.col("__key")) & inside, how).drop("__key")
    if bucket_width is None:
        length = schedule.where(F.col(start) < F.col(end)).agg(F.percentile_approx(F.col(end) - F.col(start), 0.5)).first()[0]
        bucket_width = float(length or 1.0)
    unit = lambda c: F.floor(c / F.lit(float(bucket_width))).cast("long")
    cells = sched.where(F.col(start) < F.col(end)).withColumn("__c", F.explode(dyadic_cells(unit(F.col(start)), unit(F.col(end)))))
    cells = materialize(cells.select("*", F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")).drop("__c"), "cells")
    used = [r[0] for r in cells.select("__level").distinct().collect()]  # at most LEVELS
    numbered = records.withColumn("__row", F.monotonically_increasing_id())
    numbered = numbered if how == "inner" else materialize(numbered, "records")
    probe = numbered.withColumn("__probe", F.explode(F.array(*[F.lit(n) for n in used]).cast("array<int>")))
    at = F.floor(unit(F.col(ts)) / F.pow(F.lit(2.0), F.col("__probe"))).cast("long")
    cond = (F.col(key) == F.col("__key")) & (F.col("__probe") == F.col("__level")) & (at == F.col("__cell")) & inside
    met = probe.join(cells, cond).drop("__key", "__level", "__cell", "__probe")
    if how == "inner":
        return met.drop("__row")
    found = met.select(F.col("__row").alias("__met"), *[c for c in schedule.columns if c != key])
    return numbered.join(found, F.col("__row") == F.col("__met"), how).drop("__row", "__met")


def registry(spark: SparkSession) -> DataFrame:
    """The fixed entity dimension with its display order."""
    rows = [(i, *r) for i, r in enumerate(fixed.REGISTRY_ROWS)]
    return spark.createDataFrame(
        rows,
        "uav_order int, uav_id string, dataset_name string, dataset_display string, dataset_role string, "
        "source_type string, simulation_role string, source_note string, aliases array<string>",
    )


def alias_table(spark: SparkSession) -> DataFrame:
    rows = {}
    for uav, name, display, *_, aliases in fixed.REGISTRY_ROWS:
        for a in (name, display, uav, *aliases):
            rows[column_key(a)] = name
    return spark.createDataFrame(sorted(rows.items()), "alias string, canonical string")


def attach_entity(df: DataFrame, key: str) -> DataFrame:
    """Registry columns by entity id; the dimension is a handful of fixed rows."""
    dim = registry(df.sparkSession).drop("aliases").withColumnRenamed("uav_id", "__uav")
    return df.join(F.broadcast(dim), F.col(key) == F.col("__uav"), "left").drop("__uav")


def canonical_dataset(df: DataFrame, column: str, name: str = "canonical_name") -> DataFrame:
    """Dataset name by exact name or normalised alias, else the trimmed text."""
    alias = F.regexp_replace(F.lower(F.trim(column)), "[^a-z0-9]", "")
    dim = alias_table(df.sparkSession)
    out = df.withColumn("alias", alias).join(F.broadcast(dim), "alias", "left")
    return out.withColumn(name, F.coalesce("canonical", F.trim(F.col(column)))).drop("alias", "canonical")


def entity_order(key: str):
    """Rank of an entity in the fixed order, unknown ones last."""
    out = F.lit(len(fixed.REGISTRY_ROWS))
    for i, row in enumerate(fixed.REGISTRY_ROWS):
        out = F.when(F.col(key) == row[0], i).otherwise(out)
    return out


def phase_order(key: str):
    out = F.lit(len(fixed.PHASE_ORDER))
    for i, p in enumerate(fixed.PHASE_ORDER):
        out = F.when(F.col(key) == p, i).otherwise(out)
    return out

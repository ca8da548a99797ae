"""Consolidation of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.operators.ordering import match_keys


def consolidate(
    frames: Mapping[str, DataFrame], key: str, mapping: Mapping[str, Sequence[tuple[str, str]]]
) -> DataFrame:
    """One row per key over all sources; each output takes its first present source column."""
    spine = reduce(DataFrame.unionByName, [f.select(key) for f in frames.values()]).distinct()
    out = spine
    for name, f in frames.items():
        used = sorted({c for srcs in mapping.values() for n, c in srcs if n == name})
        if used:
            out = match_keys(out, f.select(key, *[F.col(c).alias(f"{name}__{c}") for c in used]), [key])
    return out.select(
        key, *[F.coalesce(*[F.col(f"{n}__{c}") for n, c in srcs]).alias(col) for col, srcs in mapping.items()]
    )


def homogeneous_vs_heterogeneous(
    homo: DataFrame, hetero: DataFrame, method: str, metric: str, order: str
) -> DataFrame:
    """Mean and std over groups against the single mixed run, drop and drop ratio."""
    h = homo.groupBy(method).agg(
        F.count(metric).alias("group_count"),
        F.avg(metric).alias("homogeneous_mean"),
        F.stddev_pop(metric).alias("homogeneous_std"),
    )
    x = hetero.where(F.col(metric).isNotNull()).groupBy(method).agg(F.min_by(metric, order).alias("heterogeneous"))
    drop = F.col("homogeneous_mean") - F.col("heterogeneous")
    return match_keys(h, x, [method]).withColumns(
        {"drop": drop, "drop_ratio": F.when(F.col("homogeneous_mean") != 0, drop / F.col("homogeneous_mean"))}
    )


def prefer_success(frames: Sequence[DataFrame], key: str, status: str) -> DataFrame:
    """Latest successful result per key, else the latest one."""
    tagged = reduce(DataFrame.unionByName, [f.withColumn("__seq", F.lit(i)) for i, f in enumerate(frames)])
    rest = [c for c in tagged.columns if c not in (key, "__seq")]
    rank = F.struct((F.col(status) == "success").alias("ok"), (F.coalesce(status, F.lit("")) != "").alias("any"), "__seq")
    return tagged.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(key, "r.*")


def weighted_rollup(
    df: DataFrame, key: str, metrics: Mapping[str, str], sums: Sequence[str] = ()
) -> DataFrame:
    """Weighted means where any weight is positive, plain means otherwise; sums ignore NULL."""
    cols: list[Column] = [F.sum(c).alias(c) for c in sums]
    for m, w in metrics.items():
        ok = F.col(m).isNotNull() & (F.col(w) > 0)
        weight = F.sum(F.when(ok, F.col(w)))
        value = F.sum(F.when(ok, F.col(m) * F.col(w)))
        cols.append(F.when(weight > 0, value / weight).otherwise(F.avg(m)).alias(m))
    return df.groupBy(key).agg(*cols)


def dominant_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key, ties to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.col(value), F.struct((-F.col("n")).alias("n"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias(f"dominant_{value}"))


def best_experiment(df: DataFrame, name: str, status: str, order: str, metrics: Sequence[str]) -> DataFrame:
    """Largest metric value over all experiments that did not fail; the first one wins ties."""
    items = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value"))
          for i, m in enumerate(metrics)]
    )
    long = df.where(F.coalesce(F.lower(F.trim(status)), F.lit("success")) != "failed").select(name, order, F.inline(items))
    key = F.struct("metric_value", (-F.col(order)).alias("o"), (-F.col("i")).alias("i"))
    best = F.max_by(F.struct(name, "metric_name", "metric_value"), key)
    return long.where(F.col("metric_value").isNotNull()).agg(best.alias("b")).select("b.*")


def flatten_columns(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, dotted name) of every leaf of a nested schema."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += flatten_columns(f.dataType, path)
        else:
            out.append((path, path.replace("`", "")))
    return out


def flatten_structs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(p).alias(n) for p, n in flatten_columns(df.schema)])


def result_rows(reports: DataFrame, method: str, paths: Mapping[str, str]) -> DataFrame:
    """Result-table rows from nested reports; absent fields are NULL."""
    leaves = {n: p for p, n in flatten_columns(reports.schema)}
    return reports.select(
        method, *[(F.col(leaves[p]) if p in leaves else F.lit(None).cast("double")).alias(n) for n, p in paths.items()]
    )

"""Counts and summaries of prepared tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def label_counts(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Declared classes first (zero when absent), the others after them by name."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{label} string, class_order int")
    full = counts.join(F.broadcast(spine), label, "full_outer")
    return full.select(label, F.coalesce("n", F.lit(0)).alias("n"), "class_order").orderBy(
        F.col("class_order").asc_nulls_last(), label
    )


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame) -> DataFrame:
    """NULL or blank cells per column, only columns that have any; one pass."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cond = c.isNull()
        if isinstance(f.dataType, T.StringType):
            cond = cond | (F.trim(c) == "")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cond = cond | F.isnan(c)
        aggs.append(F.count_if(cond).alias(f.name))
    row = df.agg(*aggs)
    items = F.array(
        *[F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").alias("missing")) for f in df.schema.fields]
    )
    return row.select(F.inline(items)).where(F.col("missing") > 0)


def processing_summary(df: DataFrame, label: str, benign: str = "benign") -> DataFrame:
    """Benign and attack counts and missing cells as (section, name, n)."""
    counts = value_counts(df, label).select(
        F.when(F.col(label) == benign, "benign_samples").otherwise("attack_samples").alias("section"),
        F.col(label).alias("name"),
        "n",
    )
    missing = missing_counts(df).select(F.lit("missing").alias("section"), F.col("column_name").alias("name"),
                                        F.col("missing").alias("n"))
    return counts.unionByName(missing)


def merge_summary(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts by each dimension as (dimension, value, n), from one grouping-sets pass."""
    sets = [[d] for d in dims]
    g = df.groupingSets(sets, *dims).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        here = F.col(f"g_{d}") == 0
        name = F.when(here, F.lit(d)).otherwise(name)
        value = F.when(here, F.col(d).cast("string")).otherwise(value)
    return g.select(name.alias("dimension"), value.alias("value"), "n")


def split_summary(
    df: DataFrame, split: str, labels: str, group: str, is_ood: str, windows: DataFrame | None = None
) -> DataFrame:
    """Records, label, OOD-label and group distribution per split as (split, kind, value, n).

    ``windows`` (one row per window with the split and group columns) adds window and window-group counts.
    """
    base = df.select(split, F.col(labels).alias("labels"), F.col(group).cast("string").alias("g"), F.col(is_ood).alias("o"))
    items = F.flatten(
        F.array(
            F.array(F.struct(F.lit("records").alias("kind"), F.lit("all").alias("value"))),
            F.array(F.struct(F.lit("group").alias("kind"), F.coalesce("g", F.lit("__ungrouped__")).alias("value"))),
            F.transform("labels", lambda x: F.struct(F.lit("label").alias("kind"), x.alias("value"))),
            F.when(
                F.col("o"), F.transform("labels", lambda x: F.struct(F.lit("ood_label").alias("kind"), x.alias("value")))
            ).otherwise(F.expr("cast(array() as array<struct<kind:string,value:string>>)")),
        )
    )
    out = base.select(split, F.inline(items)).groupBy(split, "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    if windows is None:
        return out
    kinds = F.array(
        F.struct(F.lit("windows").alias("kind"), F.lit("all").alias("value")),
        F.struct(F.lit("window_group").alias("kind"), F.coalesce(F.col(group).cast("string"), F.lit("__ungrouped__")).alias("value")),
    )
    counted = windows.select(split, F.inline(kinds)).groupBy(split, "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(counted)


def group_statistics(df: DataFrame, group: str, label: str, id_classes: Sequence[str]) -> DataFrame:
    """Records, ID and OOD records and the labels present, per group.

    Distinct (group, label) pairs come first, so the label lists stay small.
    """
    pairs = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(label).isin(list(id_classes))
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col(label)))), ",")
    return pairs.groupBy(group).agg(
        F.sum("n").alias("records"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("id_records"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("ood_records"),
        F.count(label).alias("unique_labels"),
        names(known).alias("id_labels"),
        names(~known).alias("ood_labels"),
    )


def label_universe(df: DataFrame, labels: str, ood: Sequence[str], given: Sequence[str] | None = None) -> DataFrame:
    """Class list with stable index: the given one, or all labels but the OOD ones."""
    spark = df.sparkSession
    if given:
        return spark.createDataFrame([(c, i) for i, c in enumerate(given)], "label string, class_idx int")
    from vigilframe.operators.ordering import position

    found = df.select(F.explode(labels).alias("label")).distinct()
    if ood:
        found = found.where(~F.col("label").isin(list(ood)))
    return position(found, [], ["label"], "class_idx").select("label", F.col("class_idx").cast("int"))

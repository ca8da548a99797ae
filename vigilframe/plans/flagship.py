"""Scaled features, count windows, labels and a per-group summary in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.operators import scaling as Z
from vigilframe.operators import windows as W


def window_report(
    records: DataFrame, group: str, order: list[str], label: str, features: list[str], size: int, stride: int,
    benign: str, ood: str,
) -> DataFrame:
    """Per group: windows, mixed and alerting windows and their mean and peak scaled level."""
    scaled = Z.apply_global_scaler(records, Z.fit_global_scaler(records, features), features)
    long = W.count_windows(scaled, group, order, size, stride)
    level = sum((F.col(f) for f in features), F.lit(0.0)) / len(features)
    per_window = long.groupBy(group, "window_idx").agg(
        F.avg(level).alias("score"),
        W.has_mixed_labels(label).alias("mixed"),
        F.max((F.col(label) == ood).cast("int")).alias("ood"),
        F.max((F.col(label) != benign).cast("int")).alias("attack"),
    )
    return per_window.groupBy(group).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if("mixed").alias("mixed_windows"),
        F.sum("ood").alias("ood_windows"),
        F.sum("attack").alias("attack_windows"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.max("score"), 6).alias("peak_score"),
    )

"""Feature cleaning, medians and global or per-group standard scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.text import finite
from vigilframe.operators.ordering import match_small, wide_quantiles

SMALL_GROUP = "fallback_to_global_due_to_small_group_size"


def feature_medians(df: DataFrame, features: Sequence[str], fill: float = 0.0) -> dict[str, float]:
    """Exact training medians; one value per feature comes back to the driver."""
    row = wide_quantiles(df, [], {c: finite(F.col(c)) for c in features}, {"m": 0.5}).first()
    values = {c: None if row is None else row[f"{c}_m"] for c in features}
    return {c: fill if v is None else float(v) for c, v in values.items()}


def extract_features(df: DataFrame, features: Sequence[str], fills: dict[str, float]) -> DataFrame:
    """Finite doubles with the median in place of anything missing."""
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(float(fills[c]))) for c in features})


def _moments(features: Sequence[str]):
    return [a for c in features for a in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))]


def fit_global_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One-row table of means and population standard deviations."""
    return df.agg(F.count(F.lit(1)).alias("n"), *_moments(features))


def fit_group_scaler(df: DataFrame, group: str, features: Sequence[str], min_records: int) -> DataFrame:
    """Scaler row per group and the global row (group NULL, level 1).

    A group below ``min_records`` keeps its row with the fallback reason.
    """
    rolled = df.groupingSets([[group], []], group).agg(
        F.grouping(group).alias("level"), F.count(F.lit(1)).alias("n"), *_moments(features)
    )
    reason = F.when((F.col("level") == 0) & (F.col("n") < min_records), F.lit(SMALL_GROUP))
    return rolled.withColumn("fallback_reason", reason)


def scaler_long(scaler: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Scaler model as (group, feature, mean, std, n)."""
    items = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"))
            for c in features
        ]
    )
    return scaler.select(group, "level", "n", "fallback_reason", F.inline(items))


def apply_global_scaler(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    row = scaler.first()
    cols = {}
    for c in features:
        std = row[f"{c}__std"] or 0.0
        cols[c] = (F.col(c) - float(row[f"{c}__mean"] or 0.0)) / (float(std) if std > 0 else 1.0)
    return df.withColumns(cols)


def apply_group_scaler(df: DataFrame, scaler: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Group scaler where one was fitted, the global one elsewhere, with the source used."""
    names = [f"{c}__{s}" for c in features for s in ("mean", "std")]
    top = scaler.where(F.col("level") == 1).select(*names).first()
    own = scaler.where((F.col("level") == 0) & F.col("fallback_reason").isNull()).select(
        group, F.lit(True).alias("__own"), *names
    )
    joined = match_small(df, own, [group])
    cols = {}
    for c in features:
        mean = F.coalesce(F.col(f"{c}__mean"), F.lit(float(top[f"{c}__mean"] or 0.0)))
        std = F.coalesce(F.col(f"{c}__std"), F.lit(float(top[f"{c}__std"] or 0.0)))
        cols[c] = (F.col(c) - mean) / F.when(std > 0, std).otherwise(1.0)
    source = F.when(F.col("__own"), F.lit("group")).otherwise(F.lit("global"))
    return joined.withColumns({**cols, "scaler_source": source}).drop("__own", *names)


def scaling_summary(scaler: DataFrame, group: str) -> DataFrame:
    return scaler.where(F.col("level") == 0).select(
        F.col(group).cast("string").alias("group_id"),
        "n",
        F.col("fallback_reason").isNotNull().alias("fallback"),
        F.coalesce("fallback_reason", F.lit("group_scaler")).alias("reason"),
    )

"""Streaming jobs over a normalised record stream."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.operators.monitor import input_drift
from vigilframe.operators.ordering import match_small, wide_quantiles
from vigilframe.streaming import processors as P


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(df: DataFrame) -> None:
    """Arbitrary keyed state needs the RocksDB store; other providers are replaced for this session."""
    conf = df.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _keyed(stream: DataFrame, key: Column):
    use_rocksdb(stream)
    return stream.withColumn("key", key).select("key", *P.FIELDS).groupBy("key")


def count_windows(stream: DataFrame, key: Column, size: int, stride: int) -> DataFrame:
    return _keyed(stream, key).transformWithStateInPandas(P.IndexWindows(size, stride), P.WINDOW_SCHEMA, "Append", "None")


def adaptive_windows(stream: DataFrame, key: Column, size: int, stride: int, low: int, high: int) -> DataFrame:
    return _keyed(stream, key).transformWithStateInPandas(
        P.IndexWindows(size, stride, (low, high)), P.WINDOW_SCHEMA, "Append", "None"
    )


def time_windows(stream: DataFrame, key: Column, length_us: int, size: int) -> DataFrame:
    """Window rows (kind ``window``) and late records (kind ``late``)."""
    return _keyed(stream, key).transformWithStateInPandas(P.TimeWindows(length_us, size), P.WINDOW_SCHEMA, "Append", "None")


def epoch_windows(stream: DataFrame, ts: str, key: str, length: str, hop: str, delay: str) -> DataFrame:
    """Epoch-aligned overlapping windows that close on the watermark."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, length, hop), key)
        .agg(F.count(F.lit(1)).alias("records"), F.avg("value").alias("mean_value"))
        .select(key, F.unix_micros("window.start").alias("start_us"), "records", "mean_value")
    )


def warmup_thresholds(
    windows: DataFrame, mode: str = "normalized", q: float = 0.95, static: float = 1.5, idle_ms: int | None = None
) -> DataFrame:
    """``windows``: key, window_idx, raw_score, calibrated, benign. Keys idle for ``idle_ms`` are forgotten; the stream then
    needs a trigger that recurs, as Spark goes on with empty batches in that time mode and ``availableNow`` never ends."""
    use_rocksdb(windows)
    return windows.groupBy("key").transformWithStateInPandas(
        P.WarmupThresholds(mode, q, static, idle_ms=idle_ms), P.WARMUP_SCHEMA, "Append", "ProcessingTime" if idle_ms else "None"
    )


def warmup_thresholds_batch(
    windows: DataFrame, mode: str = "normalized", q: float = 0.95, static: float = 1.5, eps: float = 1e-6
) -> DataFrame:
    """The same state machine over a finished table, as aggregates and joins.

    A group is collecting until its first non-benign window; the frozen statistics are
    quantiles of the windows before it. A score equal to the threshold to nine places is not above it.
    """
    first = windows.groupBy("key").agg(F.min(F.when(~F.col("benign"), F.col("window_idx"))).alias("__freeze"))
    d = match_small(windows, first, ["key"])
    early = d.where(F.col("window_idx") < F.col("__freeze"))
    stats = wide_quantiles(
        early, ["key"], {"s": F.col("raw_score")}, {"q25": 0.25, "q50": 0.5, "q75": 0.75, "top": q}
    )
    out = match_small(d, stats, ["key"])
    collecting = F.col("__freeze").isNull() | (F.col("window_idx") < F.col("__freeze"))
    known = F.col("s_q50").isNotNull()
    iqr = F.greatest(F.col("s_q75") - F.col("s_q25"), F.lit(eps))
    live = F.when(known, (F.col("raw_score") - F.col("s_q50")) / iqr).otherwise(F.col("calibrated"))
    if mode == "raw":
        score, thr = F.col("raw_score"), F.col("s_top")
        source = F.when(known, "warmup_raw_quantile").otherwise("no_benign_warmup")
    else:
        score, thr = live, F.lit(float(static))
        source = F.when(known, "normalized_static").otherwise("normalized_static_no_warmup")
    return out.select(
        "key",
        "window_idx",
        "raw_score",
        F.when(~collecting, score).alias("score"),
        F.when(~collecting, thr).alias("threshold"),
        F.when(collecting, "warmup_collecting").otherwise(source).alias("threshold_source"),
        collecting.alias("collecting"),
        F.coalesce(~collecting & (F.round(score, 9) > F.round(thr, 9)), F.lit(False)).alias("is_ood"),
    )


def online_detection(
    stream: DataFrame, key: Column, size: int, stride: int, benign: str, ood: str,
    scorer: Callable[[np.ndarray], float], known_cut: float, static: float = 1.5,
) -> DataFrame:
    return _keyed(stream, key).transformWithStateInPandas(
        P.OnlineDetector(size, stride, benign, ood, scorer, known_cut, static), P.DETECTION_SCHEMA, "Append", "None"
    )


def ground_truth(windows: DataFrame, keys: list[str], benign: str, ood: str) -> DataFrame:
    """Truth of each window from its packed records; out-of-distribution records count apart from other attacks."""
    attack = lambda r: r["label"] != benign
    labels = F.array_sort(F.array_distinct(F.transform("records", lambda r: r["label"])))
    return windows.select(
        *keys,
        F.array_join(labels, ",").alias("labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("records", attack), lambda r: r["label"]))), ",").alias("attack_types"),
        F.size(F.filter("records", lambda r: ~attack(r))).alias("benign_records"),
        F.size(F.filter("records", lambda r: attack(r) & (r["label"] != ood))).alias("attack_records"),
        F.size(F.filter("records", lambda r: r["label"] == ood)).alias("ood_records"),
        F.exists("records", lambda r: r["label"] != benign).alias("attack_active"),
        F.exists("records", lambda r: r["label"] == ood).alias("is_ood"),
        F.transform(
            "records", lambda r: F.struct(r["record_id"].alias("record_id"), r["label"].alias("label"), attack(r).alias("attack_active"), (r["label"] == ood).alias("is_ood"))
        ).alias("truth_records"),
    )


def continuous_drift(stream: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Serving-input statistics for update mode."""
    return input_drift(stream, group, features)

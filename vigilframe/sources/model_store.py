"""Fitted models as plain Parquet tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.operators.calibrate import Calibration
from vigilframe.operators.scoring import PrototypeModel


def save_calibration(spark: SparkSession, cal: Calibration, path: str) -> None:
    rows = [
        (n, cal.fusion, cal.q, cal.threshold, cal.directions.get(n, 1.0), cal.medians[n], cal.iqrs[n], cal.weights[n],
         cal.score_thresholds[n])
        for n in cal.names
    ]
    spark.createDataFrame(
        rows,
        "score string, fusion string, q double, threshold double, direction double, median double, iqr double, "
        "weight double, score_threshold double",
    ).coalesce(1).write.mode("overwrite").parquet(path)


def load_calibration(spark: SparkSession, path: str, overrides: dict | None = None) -> Calibration:
    """Given values win over stored ones, stored ones over defaults."""
    rows = spark.read.parquet(path).collect()  # one row per score
    o = overrides or {}
    first = rows[0]
    return Calibration(
        tuple(r["score"] for r in rows),
        o.get("fusion", first["fusion"] or "correlation_aware"),
        o.get("q", first["q"] if first["q"] is not None else 0.95),
        {r["score"]: r["direction"] if r["direction"] is not None else 1.0 for r in rows},
        {r["score"]: r["median"] for r in rows},
        {r["score"]: r["iqr"] for r in rows},
        {r["score"]: r["weight"] for r in rows},
        {r["score"]: r["score_threshold"] for r in rows},
        o.get("threshold", first["threshold"]),
    )


def save_prototypes(spark: SparkSession, model: PrototypeModel, path: str) -> None:
    kinds = [("prototype", str(c), v.tolist()) for c, v in zip(model.classes, model.prototypes)]
    if model.precision is not None:
        kinds += [("precision", f"{i:06d}", r.tolist()) for i, r in enumerate(model.precision)]
    rows = [(k, i, n, v, model.scale) for i, (k, n, v) in enumerate(kinds)]
    spark.createDataFrame(rows, "kind string, ord int, name string, vec array<double>, scale double").coalesce(
        1
    ).write.mode("overwrite").parquet(path)


def load_prototypes(spark: SparkSession, path: str) -> PrototypeModel:
    rows = spark.read.parquet(path).orderBy("ord").collect()  # classes + dimensions rows
    protos = [r for r in rows if r["kind"] == "prototype"]
    prec = [r["vec"] for r in rows if r["kind"] == "precision"]
    classes = [int(r["name"]) if r["name"].lstrip("-").isdigit() else r["name"] for r in protos]
    return PrototypeModel(
        classes, np.asarray([r["vec"] for r in protos]), np.asarray(prec) if prec else None, protos[0]["scale"]
    )


def save_table(df: DataFrame, path: str) -> None:
    """Threshold, scaler and bank tables are DataFrames already."""
    df.write.mode("overwrite").parquet(path)


def threshold_with_precedence(df: DataFrame, default: float) -> DataFrame:
    """Artifact value, then the nested configuration value, then the default."""
    return df.withColumn("threshold", F.coalesce("artifact_threshold", "config.threshold", F.lit(float(default))))

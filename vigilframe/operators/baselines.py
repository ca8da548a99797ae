"""Multi-label tabular baselines and the isolation-forest score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import MaxAbsScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.scores import sigmoid
from vigilframe.operators.ordering import order_hash, position

BASELINES = ("linear_svm", "random_forest", "boosted_trees", "mlp")


# Sizes of a full fit; any of them can be given as ``settings``.
SETTINGS = {
    "linear_svm": {"maxIter": 200, "regParam": 5e-4},
    "random_forest": {"numTrees": 200, "maxDepth": 30},
    "boosted_trees": {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"},
    "mlp": {"hidden": (128, 64), "maxIter": 300},
}
# Smaller fits for quick looks; the registered queries use them.
LIGHT = {
    "linear_svm": {"maxIter": 20},
    "random_forest": {"numTrees": 20, "maxDepth": 6},
    "boosted_trees": {"maxIter": 10, "maxDepth": 4, "stepSize": 0.1},
    "mlp": {"hidden": (32,), "maxIter": 60},
}


def _classifier(name: str, label: str, width: int, seed: int, settings: dict):
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": f"{label}_hat"}
    if name == "linear_svm":
        return LinearSVC(rawPredictionCol=f"{label}_raw", weightCol=f"{label}_weight", **common, **settings)
    tree = {**common, "rawPredictionCol": f"{label}_raw", "probabilityCol": f"{label}_prob"}
    if name == "random_forest":
        return RandomForestClassifier(seed=seed, **tree, **settings)
    if name == "boosted_trees":
        model = GBTClassifier(seed=seed, **common, **settings)
        return model.setRawPredictionCol(f"{label}_raw").setProbabilityCol(f"{label}_prob")
    if name == "mlp":
        rest = {k: v for k, v in settings.items() if k != "hidden"}
        return MultilayerPerceptronClassifier(layers=[width, *settings["hidden"], 2], seed=seed, **tree, **rest)
    raise ValueError(f"unknown baseline: {name}")


class MultiLabelModel:
    """One binary Spark ML model per label; a label with one value keeps that value.

    Features are scaled by their largest absolute value; the linear machine weighs both values of a label alike.
    ``settings`` replace single entries of SETTINGS.
    """

    def __init__(self, name: str, seed: int = 42, settings: dict | None = None):
        self.name, self.seed = name, seed
        self.settings = {**SETTINGS[name], **(settings or {})}
        self.models: list = []

    def fit(self, df: DataFrame, vector: str, labels: str, n_labels: int) -> MultiLabelModel:
        y = [F.col(labels)[i].cast("double").alias(f"y{i}") for i in range(n_labels)]
        raw = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("raw"), *y)
        self.scaler = MaxAbsScaler(inputCol="raw", outputCol="features").fit(raw)
        data = self.scaler.transform(raw).cache()
        means = data.agg(F.max(F.size(vector_to_array("features"))).alias("d"), *[F.avg(f"y{i}").alias(f"y{i}") for i in range(n_labels)]).first()
        self.models = []
        for i in range(n_labels):
            share = means[f"y{i}"]
            if share in (0.0, 1.0):
                self.models.append(float(share))
            else:
                weight = F.when(F.col(f"y{i}") > 0.5, 0.5 / share).otherwise(0.5 / (1 - share))
                model = _classifier(self.name, f"y{i}", means["d"], self.seed, self.settings)
                self.models.append(model.fit(data.withColumn(f"y{i}_weight", weight)))
        data.unpersist()
        return self

    def predict(self, df: DataFrame, vector: str) -> DataFrame:
        """Adds ``probs``: one probability per label."""
        out = self.scaler.transform(df.withColumn("raw", array_to_vector(F.col(vector).cast("array<double>"))))
        probs = []
        for i, m in enumerate(self.models):
            if isinstance(m, float):
                probs.append(F.lit(m))
                continue
            out = m.transform(out)
            if self.name == "linear_svm":
                probs.append(sigmoid(vector_to_array(f"y{i}_raw")[1]))
            else:
                probs.append(vector_to_array(f"y{i}_prob")[1])
        return out.withColumn("probs", F.array(*probs)).select(*df.columns, "probs")


# --- isolation forest --------------------------------------------------------------------
SUBSAMPLE = 256


def _c(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, seed: int) -> dict[str, list]:
    """One isolation tree as flat arrays."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    feat, cut, left, right, depth = [], [], [], [], []

    def node(idx: np.ndarray, level: int) -> int:
        me = len(feat)
        for a in (feat, cut, left, right, depth):
            a.append(0)
        sub = x[idx]
        spread = sub.max(axis=0) - sub.min(axis=0)
        usable = np.flatnonzero(spread > 0)
        if level >= limit or len(idx) <= 1 or len(usable) == 0:
            feat[me], depth[me] = -1, level + _c(len(idx))
            return me
        f = int(rng.choice(usable))
        c = float(rng.uniform(sub[:, f].min(), sub[:, f].max()))
        feat[me], cut[me] = f, c
        below = sub[:, f] < c
        left[me] = node(idx[below], level + 1)
        right[me] = node(idx[~below], level + 1)
        return me

    node(np.arange(len(x)), 0)
    return {"feat": feat, "cut": [float(v) for v in cut], "left": left, "right": right, "depth": [float(v) for v in depth]}


def tree_depths(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    while True:
        f = tree["feat"][at]
        live = f >= 0
        if not live.any():
            return tree["depth"][at]
        rows = np.flatnonzero(live)
        below = x[rows, f[rows]] < tree["cut"][at[rows]]
        at[rows] = np.where(below, tree["left"][at[rows]], tree["right"][at[rows]])


def isolation_forest(
    train: DataFrame, ident: str, vector: str, trees: int = 200, seed: int = 42, subsample: int = SUBSAMPLE
) -> list[dict]:
    """Trees grown in parallel, each on ``subsample`` rows drawn from the whole table.

    Rows are put in a seeded hash order; tree t takes the ``subsample`` rows from place t * subsample on, wrapping where
    the table is smaller. Only the grown trees reach the driver.
    """
    rows = train.select(order_hash(seed, ident).alias("h"), F.col(vector).cast("array<double>").alias("x"))
    ranked = position(rows, [], ["h"], "r", size_name="m")
    span = F.least(F.col("m"), F.lit(subsample))
    wraps = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.col("r") - t * subsample, F.col("m")) < span
    )
    own = F.floor(F.col("r") / subsample).cast("int")
    tree_ids = F.when(F.col("m") < trees * subsample, wraps).when(own < trees, F.array(own))
    placed = ranked.where(F.col("r") < trees * subsample).withColumn("tree", F.explode(tree_ids))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        t = int(pdf["tree"].iloc[0])
        grown = grow_tree(np.stack(pdf["x"].to_numpy()), seed * 100003 + t)
        return pd.DataFrame({"tree": [t], "n": [len(pdf)], **{k: [v] for k, v in grown.items()}})

    out = placed.select("tree", "r", "x").groupBy("tree").applyInPandas(
        build, "tree int, n int, feat array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"
    )
    return [r.asDict() for r in out.orderBy("tree").collect()]


def isolation_scores(df: DataFrame, ids: Sequence[str], vector: str, forest: list[dict]) -> DataFrame:
    """Anomaly score in (0, 1]; larger is more isolated."""
    arrays = [{k: np.asarray(t[k]) for k in ("feat", "cut", "left", "right", "depth")} for t in forest]
    norm = _c(max(t["n"] for t in forest)) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(arrays)
    keep = df.select(*ids, F.col(vector).cast("array<double>").alias("__x"))
    fields = ", ".join(f"`{c}` {keep.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) == 0:
                continue
            x = np.stack(b["__x"].to_numpy()).astype(np.float64)
            mean = np.mean([tree_depths(t, x) for t in shared.value], axis=0)
            frame = b[list(ids)].copy()
            frame["isolation_score"] = 2 ** (-mean / norm)
            yield frame

    return keep.mapInPandas(run, fields + ", isolation_score double")

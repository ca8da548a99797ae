"""JSON record files round trip, and scores of rows with null ids."""

import json

import numpy as np
from pyspark.sql import functions as F

from vigilframe.config import shared_dir
from vigilframe.operators import scoring as G
from vigilframe.sources import readers as S


def test_json_round_trip(spark):
    path = shared_dir(spark, "json") + "/x.json"
    S.save_records(spark.range(100).withColumn("v", F.col("id") * 2), path)
    assert sorted(map(tuple, S.load_records(spark, path).select("id", "v").collect())) == [(i, 2 * i) for i in range(100)]


def test_documents_of_every_kind(spark, tmp_path):
    for name, doc in {"a": [{"x": 1}, {"x": 2}], "b": {"records": [{"x": 3}]}, "c": {"data": [{"x": 4}]}, "d": {"items": [{"x": 5}]}, "e": {"x": 6}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    assert sorted(r["x"] for r in S.load_records(spark, str(tmp_path), fmt="json").collect()) == [1, 2, 3, 4, 5, 6]


def test_unlabelled_windows_keep_their_scores(spark):
    rows = [(i if i % 2 else None, f"w{i}", [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "label int, window_id string, v array<double>")
    model = G.PrototypeModel(classes=["a"], prototypes=np.array([[1.0, 0.0]]), scale=1.0, precision=None)
    bank = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],)], "b array<double>")
    assert G.raw_scores(df, ["label", "window_id"], "v", model, bank, "b").count() == 40
